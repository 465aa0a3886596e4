"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle.

Pass one fills two Bloom filters, of hashes met and of hashes met again. Pass two tests every row against the second:
a row that it doesn't hold is unique and passes straight through, the others are grouped by the SHA-256 of their text.
False positives only add rows to that shuffle. Groups that hold more than a thousandth of all rows (a thousand of them
at most) meet their rows by broadcast, so no task gets a whole hot group.

Defined cases: a null text counts as empty, and all empty texts are one group; null ids lose against any id; rows that
repeat with the same id and text count as members of their group, and the stage keeps one of them; an empty table gives
an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import build_filter, checkpoint, filter_bits, in_filter

#: Groups of at least this many rows, and of a thousandth of all rows, are joined by broadcast.
HOT_ROWS = 1024


def _sha(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _hash_key(sha) -> F.Column:
    return F.xxhash64(sha)


def _repeated(hashed: DataFrame):
    """Column function of a sha: may it occur more than once in `hashed`?"""
    n = hashed.count()
    packed = build_filter(hashed.select(_hash_key(F.col("__sha")).alias("__h")), filter_bits(n), True)
    return in_filter(hashed.sparkSession, packed), n


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; of equal texts the largest doc_id stays."""
    hashed = checkpoint(docs.select("doc_id", _sha(F.col("text")).alias("__sha")))
    maybe, n = _repeated(hashed)
    flag = maybe(_hash_key(F.col("__sha")))
    suspects = hashed.filter(flag)
    groups = checkpoint(suspects.groupBy(F.col("__sha").alias("__key")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    hot = groups.filter(F.col("group_size") >= max(HOT_ROWS, n // 1000))
    by_key = F.col("__sha") == F.col("__key")
    met = suspects.join(F.broadcast(hot), by_key, "left")
    large = met.filter(F.col("__key").isNotNull())
    small = met.filter(F.col("__key").isNull()).select("doc_id", "__sha").join(groups.filter(F.col("group_size") < max(HOT_ROWS, n // 1000)), by_key)
    single = hashed.filter(~flag).select("doc_id", "__sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    cols = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("__sha").alias("text_sha256")]
    return single.select(*cols).unionByName(large.select(*cols)).unionByName(small.select(*cols))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns, which are held in one struct meanwhile, so none of their names can
    clash. Which rows go is decided on ids and hashes; of the texts, only those of rows that may go, or that repeat with
    their id, are shuffled."""
    marked = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("id"), _sha(F.col("row.text")).alias("__sha"))
    hashed = checkpoint(marked.select("id", "__sha"))
    maybe, _ = _repeated(hashed)
    suspects = hashed.filter(maybe(_hash_key(F.col("__sha")))).groupBy("__sha", "id").agg(F.count(F.lit(1)).alias("n"))
    keepers = suspects.groupBy(F.col("__sha").alias("key")).agg(F.max("id").alias("keep"))
    # Joined by hash and id together, so the rows of a hot group lie in many tasks.
    kept = suspects.join(keepers, (F.col("__sha") == F.col("key")) & F.col("id").eqNullSafe(F.col("keep")), "left")
    found = checkpoint(kept.select(F.col("id").alias("met"), F.col("__sha").alias("key"), F.col("key").isNotNull().alias("stays"), "n").filter("n > 1 OR NOT stays"))
    n = found.count()
    if not n:
        return docs
    routed = in_filter(docs.sparkSession, build_filter(found.select(F.xxhash64("met", "key").alias("h")), filter_bits(n), False))
    flag, same = routed(F.xxhash64("id", "__sha")), (F.col("__sha") == F.col("key")) & F.col("id").eqNullSafe(F.col("met"))
    tried = marked.filter(flag).join(found, same, "left")
    once = tried.filter("key IS NULL").select("row")
    twice = tried.filter("key IS NOT NULL AND stays").dropDuplicates(["__sha"]).select("row")
    return marked.filter(~flag).select("row").unionByName(once).unionByName(twice).select("row.*")
