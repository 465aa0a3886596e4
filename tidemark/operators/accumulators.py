"""Aggregates of one's own: create, add, merge and result, summed up in each task before the shuffle and merged after it."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accumulators travel with their code, so Python workers needn't be able to import this package.
register_pickle_by_value(sys.modules[__name__])

#: Rows that a task sorts by key at once, so that a key's values are added in few calls.
SORTED = 262_144
#: Keys that a task holds states of before it gives them on; a key may then have several states of one task.
HELD = 100_000


class Accumulator(Protocol):
    """What a user writes. States are pickled between tasks, so they should stay small; merge must not depend on order."""

    def create(self) -> Any: ...

    def add(self, state: Any, values: np.ndarray) -> Any:
        """A state with a batch's values of one key, nulls left out."""

    def merge(self, a: Any, b: Any) -> Any: ...

    def result(self, state: Any) -> float | None: ...


class LargestMean:
    """Mean of a key's `number` largest values."""

    def __init__(self, number: int):
        self.number = number

    def create(self) -> list[float]:
        return []

    def add(self, state: list[float], values: np.ndarray) -> list[float]:
        return self.merge(state, values.tolist())

    def merge(self, a: list[float], b: list[float]) -> list[float]:
        return sorted([*a, *b], reverse=True)[: self.number]

    def result(self, state: list[float]) -> float | None:
        return sum(state) / len(state) if state else None


def accumulate(df: DataFrame, key: str, value: str, own: Accumulator, name: str) -> DataFrame:
    """key and the accumulator's result (double) over its values.

    Each task adds up its rows by key, many Arrow batches at once, so of a hot key one state a task is shuffled, not its
    rows; the states of a key are merged one by one. Null keys are one key; a key without values has the result of an empty state.
    """
    kind = df.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Any, Any] = {}
        id_type = None

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), id_type), pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], names=["key", "state"])

        def add(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts)
            keys = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
            values, codes = table.column(1).to_numpy(), keys.indices.to_numpy(zero_copy_only=False)
            there = ~np.isnan(values)
            values, codes = values[there], codes[there]
            order = np.argsort(codes, kind="stable")
            values, at = values[order], np.searchsorted(codes[order], np.arange(len(keys.dictionary) + 1)).tolist()
            for code, k in enumerate(keys.dictionary.to_pylist()):
                held[k] = own.add(held[k] if k in held else own.create(), values[at[code] : at[code + 1]])

        parts: list[pa.RecordBatch] = []
        for batch in batches:
            id_type = batch.column(0).type
            parts.append(batch)
            if sum(p.num_rows for p in parts) >= SORTED:
                add(parts)
                parts = []
                if len(held) > HELD:
                    yield give()
                    held.clear()
        if parts:
            add(parts)
        if held:
            yield give()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, id_type, met = None, None, None, False
        for batch in batches:
            id_type, keys, out = batch.column(0).type, [], []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if met and k == now:
                    state = own.merge(state, pickle.loads(s))
                    continue
                if met:
                    keys.append(now), out.append(own.result(state))
                now, state, met = k, pickle.loads(s), True
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, id_type), pa.array(out, pa.float64())], names=[key, name])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([now], id_type), pa.array([own.result(state)], pa.float64())], names=[key, name])

    states = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).mapInArrow(partial, f"key {kind}, state binary")
    return states.repartition("key").sortWithinPartitions("key").mapInArrow(merged, f"`{key}` {kind}, `{name}` double")
