"""Registered queries on the test tables, each beside its SQL.

`events` play the trades and quotes (purchase: trade, view: quote or rate change; user_id: ticker, currency or account;
value: price), `lineitem` the wide trade log, `part` the instruments, `customer` the accounts, `orders` the orders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.functions import expressions as X
from tidemark.operators import accumulators, joins, quality, windows
from tidemark.sources import io, keyed, tier
from tidemark.streaming import refresh, rejects, revise, run, stateful

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Events with ts as an instant; the session's zone is UTC."""
    df = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return df if kind is None else df.filter(F.col("event_type") == kind)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


_HOUR = 3_600_000

# windows

_CLOSED = "window_end <= (SELECT max(ts) - INTERVAL 5 SECOND FROM events)"
_HOURLY = "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM events GROUP BY ALL"


@query(f"SELECT * FROM ({_HOURLY}) WHERE {_CLOSED}")
def tumbling_count_stream(spark, sf_dir):
    plan = windows.tumbling(event_stream(spark, sf_dir), ["user_id"], "ts", "1 hour", [F.count(F.lit(1)).alias("n")], "5 seconds")
    return ntz(run.run_to_parquet(plan, "tumbling"), "window_start", "window_end")


@query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, event_type, count(*) AS trades, round(sum(value), 2) AS volume FROM events GROUP BY ALL")
def tumbling_volume_batch(spark, sf_dir):
    out = windows.tumbling(events(spark, sf_dir), ["event_type"], "ts", "1 minute", [F.count(F.lit(1)).alias("trades"), F.round(F.sum("value"), 2).alias("volume")])
    return ntz(out, "window_start", "window_end").orderBy("window_start", "event_type")


@query(_HOURLY)
def late_revised_counts(spark, sf_dir):
    """Windows stay open for the allowed lateness: updates of a count replace its row in a keyed table."""
    plan = windows.tumbling(event_stream(spark, sf_dir), ["user_id"], "ts", "1 hour", [F.count(F.lit(1)).alias("n")], "65 seconds")
    schema = StructType(list(plan.schema)).add("seq", LongType())
    revised = keyed.KeyedTable(spark, run.scratch(spark, "revised"), schema, ["user_id", "window_start"], buckets=4)
    run.run_batches(plan, lambda batch, i: revised.merge(batch.withColumn("seq", F.lit(i).cast("bigint")), i), "revised", "update")
    return ntz(revised.read().drop("seq"), "window_start", "window_end")


_PARTS = "SELECT *, least(3, CAST(4 * (epoch_us(ts) // 1000 - lo) // (hi - lo + 1) AS BIGINT) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END) AS part FROM events, (SELECT min(epoch_us(ts) // 1000) AS lo, max(epoch_us(ts) // 1000) AS hi FROM events)"


def in_parts(rows: DataFrame, late: Column | None = None, every: DataFrame | None = None, count: int = 4) -> DataFrame:
    """Rows with the number of the part, of four (or `count`) by time (of all rows, or of `every`), in which they arrive; late ones come a
    part later."""
    lo, hi = (rows if every is None else every).agg(F.unix_millis(F.min("ts")), F.unix_millis(F.max("ts"))).first()
    own = F.floor(count * (F.unix_millis("ts") - F.lit(lo)) / F.lit(1 if lo is None else hi - lo + 1))
    return rows.withColumn("part", own if late is None else F.least(F.lit(count - 1), own + F.when(late, 1).otherwise(0)))


def in_batches(spark, sf_dir, name: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming plan over events gives when they come in four parts by time, each a restart from the checkpoint: state
    goes on from batch to batch."""
    state, out = run.scratch(spark, f"{name}-state"), run.scratch(spark, f"{name}-out")
    run.feed(in_parts(events(spark, sf_dir)), "part", 4, f"{name}-in", lambda stream: run.run_to_parquet(plan(stream), name, checkpoint=state, out=out))
    return spark.read.parquet(out)


@query(f"SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, count(DISTINCT part) AS revisions FROM ({_PARTS}) GROUP BY ALL")
def late_revisions(spark, sf_dir):
    """A tenth of the events arrives a part late, within the allowed lateness: counts are revised, and how often is counted."""
    return _revisions(spark, sf_dir, "400 days")


def _revisions(spark, sf_dir, lateness: str) -> DataFrame:
    schema = "user_id bigint, window_start timestamp, window_end timestamp, n bigint, revisions bigint"
    out = keyed.KeyedTable(spark, run.scratch(spark, "revisions"), spark.createDataFrame([], schema).schema, ["user_id", "window_start", "window_end"], "aggregate", buckets=4, rules={"n": "max", "revisions": "sum"})
    state = run.scratch(spark, "revisions-state")

    def once(stream: DataFrame) -> None:
        plan = windows.tumbling(stream, ["user_id"], "ts", "1 hour", [F.count(F.lit(1)).alias("n")], lateness)
        run.run_batches(plan, lambda batch, i: out.merge(batch.withColumn("revisions", F.lit(1).cast("bigint")), i), "revisions", "update", state)

    run.feed(in_parts(events(spark, sf_dir).select("event_id", "user_id", "ts"), F.col("event_id") % 10 == 3).drop("event_id"), "part", 4, "revisions-in", once)
    return ntz(out.read(), "window_start", "window_end")


@query(f"""WITH p AS ({_PARTS}), m AS (SELECT b, (SELECT max(ts) FROM p WHERE part < b) - INTERVAL 3 DAY AS mark FROM range(4) r(b))
      SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n, count(DISTINCT part) AS revisions
      FROM p JOIN m ON b = part WHERE mark IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > date_trunc('millisecond', mark) GROUP BY ALL""")
def late_revisions_bounded(spark, sf_dir):
    """The same with a lateness of three days: windows that the watermark has passed end, and rows that come later are too
    late to revise them."""
    return _revisions(spark, sf_dir, "3 days")


@query("WITH s AS (SELECT * FROM events WHERE event_type = 'purchase' OR event_type = 'signup' AND ts <= (SELECT min(ts) + INTERVAL 1 DAY FROM events)), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM s GROUP BY ALL) SELECT * FROM w WHERE window_end <= (SELECT max(ts) - INTERVAL 5 SECOND FROM events WHERE event_type = 'purchase')")
def idle_source_counts(spark, sf_dir):
    """Two sources with watermarks of their own, one of which falls idle after a day: the other one closes the windows."""
    first = events(spark, sf_dir).agg(F.min("ts")).first()[0]
    stream = event_stream(spark, sf_dir).select("event_type", "ts")
    busy = stream.filter("event_type = 'purchase'").withWatermark("ts", "5 seconds")
    idle = stream.filter((F.col("event_type") == "signup") & (F.col("ts") <= F.lit(first) + F.expr("interval 1 day"))).withWatermark("ts", "5 seconds")
    plan = windows.tumbling(busy.unionByName(idle), [], "ts", "1 hour", [F.count(F.lit(1)).alias("n")])
    return ntz(run.run_to_parquet(plan, "idle", policy="max"), "window_start", "window_end")


@query("""WITH a AS (SELECT *, hash_key FROM (SELECT *, (event_id * 7919) % 1000003 AS hash_key FROM events)),
      p AS (SELECT *, max(ts) OVER (ORDER BY hash_key, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
      SELECT event_id, user_id, epoch_us(seen) // 1000 - 86400000 AS watermark_at_arrival_ms, epoch_us(seen) // 1000 - 86400000 - epoch_us(ts) // 1000 AS lateness_ms
      FROM p WHERE epoch_us(ts) // 1000 < epoch_us(seen) // 1000 - 86400000""")
def late_rows(spark, sf_dir):
    """Late rows of events that arrive out of order, a day of delay allowed."""
    shuffled = events(spark, sf_dir).withColumn("arrival", F.struct(((F.col("event_id") * 7919) % 1000003).alias("k"), "event_id"))
    found = windows.late_rows(shuffled, "ts", "arrival", 86_400_000)
    return found.select("event_id", "user_id", "watermark_at_arrival_ms", "lateness_ms")


@query("""WITH a AS (SELECT *, (event_id * 7919) % 1000003 AS k FROM events),
      p AS (SELECT *, max(ts) OVER (ORDER BY k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
      SELECT count(*) FILTER (epoch_us(ts) // 1000 < epoch_us(seen) // 1000 - 86400000) AS late, count(*) AS total FROM p""")
def late_coverage(spark, sf_dir):
    """How many events come more than a day late."""
    shuffled = events(spark, sf_dir).withColumn("arrival", F.struct(((F.col("event_id") * 7919) % 1000003).alias("k"), "event_id"))
    late = windows.late_rows(shuffled, "ts", "arrival", 86_400_000).agg(F.count(F.lit(1)).alias("late"))
    return late.join(shuffled.agg(F.count(F.lit(1)).alias("total")))  # one row each


@query("SELECT event_id, user_id, concat(user_id, '#', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS tag FROM events")
def running_count(spark, sf_dir):
    counted = windows.running_count(events(spark, sf_dir), "user_id", ["ts", "event_id"])
    return counted.select("event_id", "user_id", F.concat_ws("#", "user_id", "n").alias("tag"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def running_count_stream(spark, sf_dir):
    plan = lambda stream: stateful.running_count_stream(stream.select("event_id", "user_id", "ts"), "user_id", "ts")
    return in_batches(spark, sf_dir, "running", plan).select("event_id", "user_id", "n")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def arrival_count_stream(spark, sf_dir):
    """Counts by two-second windows of arrival, over two batches each a restart; how events split into windows depends on
    the clock, their sums don't."""
    state, out, rows = run.scratch(spark, "arrival-state"), run.scratch(spark, "arrival-out"), in_parts(events(spark, sf_dir).select("event_id", "user_id", "ts"))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.floor(F.col("part") / 2)).count().collect()}
    left = [sizes.get(0, 0), sizes.get(1, 0)]
    total = sum(left)
    full = lambda done: (done.agg(F.sum("n")).first()[0] or 0) == total
    once = lambda stream: run.run_for(stateful.arrival_count_stream(stream, "user_id", 2000), "arrival", left.pop(0), out, state, None if left else full)
    run.feed(rows.withColumn("part", F.floor(F.col("part") / 2)), "part", 2, "arrival-in", once)
    return spark.read.parquet(out).groupBy(F.col("key").alias("user_id")).agg(F.sum("n").alias("n"))


@query("SELECT user_id, 'COUNT' AS ticker, 'REPORT' AS side, count(*) AS quantity, CAST(0 AS DOUBLE) AS price, epoch_ms(time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND) AS trade_time FROM events GROUP BY user_id, time_bucket(INTERVAL 10 SECOND, ts)")
def count_report(spark, sf_dir):
    return windows.count_report(events(spark, sf_dir), "user_id", "10 seconds", "ts").drop("event_id")


# joins

_PAIRS = "FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL {0} HOUR AND a.ts + INTERVAL {1} HOUR"


def _trades_quotes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    trades = df.filter("event_type = 'purchase'").select(F.col("event_id").alias("trade_id"), "user_id", F.col("ts").alias("trade_ts"), F.col("value").alias("price"))
    quotes = df.filter("event_type = 'view'").select(F.col("event_id").alias("quote_id"), "user_id", F.col("ts").alias("quote_ts"), F.col("value").alias("quote"))
    return trades, quotes


def _lag(df: DataFrame) -> DataFrame:
    return df.select("trade_id", "quote_id", "user_id", (F.unix_millis("trade_ts") - F.unix_millis("quote_ts")).alias("lag_ms"))


_LAG = "SELECT a.event_id AS trade_id, b.event_id AS quote_id, a.user_id, epoch_us(a.ts) // 1000 - epoch_us(b.ts) // 1000 AS lag_ms "


@query(_LAG + _PAIRS.format(1, 1))
def interval_join_batch(spark, sf_dir):
    trades, quotes = _trades_quotes(events(spark, sf_dir))
    return _lag(joins.bucketed_interval_join(trades, quotes, ["user_id"], "trade_ts", "quote_ts", 3600, 3600))


@query(_LAG + _PAIRS.format(1, 1))
def interval_join_stream(spark, sf_dir):
    def plan(stream: DataFrame) -> DataFrame:
        trades, quotes = _trades_quotes(stream)
        return joins.interval_join(trades.withWatermark("trade_ts", "5 seconds"), quotes.withWatermark("quote_ts", "5 seconds"), ["user_id"], "trade_ts", "quote_ts", "-1 hours", "1 hours")

    return _lag(in_batches(spark, sf_dir, "interval", plan))


@query("SELECT a.event_id AS trade_id, max_by(b.event_id, (b.ts, b.event_id)) AS quote_id, round(max_by(b.value, (b.ts, b.event_id)), 4) AS quote " + _PAIRS.format(1, 0) + " GROUP BY a.event_id")
def prevailing_quote(spark, sf_dir):
    trades, quotes = _trades_quotes(events(spark, sf_dir))
    pairs = joins.bucketed_interval_join(trades, quotes, ["user_id"], "trade_ts", "quote_ts", 3600, 0)
    best = pairs.groupBy("trade_id").agg(F.max_by(F.struct("quote_id", "quote"), F.struct("quote_ts", "quote_id")).alias("q"))
    return best.select("trade_id", "q.quote_id", F.round("q.quote", 4).alias("quote"))


@query("""WITH t AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS w, count(*) AS trades FROM events WHERE event_type = 'purchase' GROUP BY ALL),
      q AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS w, count(*) AS quotes FROM events WHERE event_type = 'view' GROUP BY ALL)
      SELECT user_id, w AS window_start, w + INTERVAL 1 DAY AS window_end, trades, quotes FROM t JOIN q USING (user_id, w)""")
def window_join_counts(spark, sf_dir):
    trades, quotes = _trades_quotes(events(spark, sf_dir))
    return ntz(joins.window_join(trades, quotes, ["user_id"], "trade_ts", "quote_ts", "1 day", ("trades", "quotes")), "window_start", "window_end")


_ASOF = "FROM (SELECT * FROM events WHERE event_type = 'purchase') t ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON t.user_id = v.user_id AND t.ts >= v.ts"


def _asof(spark, sf_dir, max_age=None) -> DataFrame:
    """As-of join of trades and rates; keys are split by day."""
    trades, rates = _trades_quotes(events(spark, sf_dir))
    return joins.asof_join(trades, rates.withColumnRenamed("quote", "rate"), ["user_id"], "trade_ts", "quote_ts", ["quote_id", "rate"], max_age, F.to_date("__ts"))


@query("SELECT t.event_id AS trade_id, v.event_id AS quote_id, round(v.value, 4) AS rate, floor(coalesce(t.value * v.value, 0) * 100 + 0.5) / 100 AS notional_usd " + _ASOF)
def asof_rate(spark, sf_dir):
    return _asof(spark, sf_dir).select("trade_id", "quote_id", F.round("rate", 4).alias("rate"), X.half_up(X.notional_usd(F.lit(1), F.col("price"), F.col("rate")), 2).alias("notional_usd"))


@query("SELECT t.event_id AS trade_id, CASE WHEN t.ts - INTERVAL 6 HOUR <= v.ts THEN round(v.value, 4) END AS rate " + _ASOF)
def asof_rate_retained(spark, sf_dir):
    """Rates go stale after six hours."""
    return _asof(spark, sf_dir, "6 hours").select("trade_id", F.round("rate", 4).alias("rate"))


@query("SELECT t.event_id AS trade_id, t.user_id, round(v.value, 4) AS rate " + _ASOF + " WHERE t.ts <= (SELECT max(ts) - INTERVAL 5 SECOND FROM events)")
def asof_rate_stream(spark, sf_dir):
    """As-of join with state: trades that the watermark has passed."""
    def plan(stream: DataFrame) -> DataFrame:
        trades = stream.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
        return stateful.asof_stream(trades, stream.filter("event_type = 'view'"), "user_id", "ts", "value", _HOUR, "5 seconds")

    return in_batches(spark, sf_dir, "asof", plan).select(F.get_json_object("row", "$.event_id").cast("bigint").alias("trade_id"), F.col("key").alias("user_id"), F.round("value", 4).alias("rate"))


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms, part FROM ({_PARTS}) WHERE event_type IN ('purchase', 'view')),
      k AS (SELECT user_id, part AS q, max(max(ms)) OVER (PARTITION BY user_id ORDER BY part) - {_HOUR} AS clock FROM e GROUP BY user_id, part),
      h AS (SELECT *, CAST(floor((lag(clock) OVER (PARTITION BY user_id ORDER BY q) - {48 * _HOUR}) / {6 * _HOUR}) AS BIGINT) * {6 * _HOUR} AS least FROM k),
      o AS (SELECT h.user_id, h.q, max((r.ms, r.value)) AS older FROM h JOIN e r ON r.event_type = 'view' AND r.user_id = h.user_id AND r.part < h.q AND r.ms < h.least GROUP BY ALL),
      t AS (SELECT t.event_id, t.user_id, t.ms, h.q, h.clock, max((r.ms, r.value)) AS best
            FROM e t JOIN h ON h.user_id = t.user_id AND h.q >= t.part AND t.ms <= h.clock LEFT JOIN o ON o.user_id = h.user_id AND o.q = h.q
            LEFT JOIN e r ON r.event_type = 'view' AND r.user_id = t.user_id AND r.part <= h.q AND r.ms <= t.ms AND (r.part = h.q OR h.least IS NULL OR r.ms >= h.least OR (r.ms, r.value) = o.older)
            WHERE t.event_type = 'purchase' GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY q) AS n FROM t WHERE best IS NOT NULL OR clock >= ms + {24 * _HOUR})
      SELECT event_id AS trade_id, user_id, best[1] AS rate_ms, round(best[2], 4) AS rate FROM n WHERE n = 1""")
def asof_late_stream(spark, sf_dir):
    """As-of join over four micro-batches in which a tenth of trades and rates comes a part late, days behind the others:
    late trades are answered from two days of history and the youngest rate before; trades without a rate wait for a day."""
    state, out = run.scratch(spark, "asof-late-state"), run.scratch(spark, "asof-late-out")

    def once(stream: DataFrame) -> None:
        trades = stream.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
        plan = stateful.asof_history_stream(trades, stream.filter("event_type = 'view'"), "user_id", "ts", "value", _HOUR, 48 * _HOUR, 24 * _HOUR, 6 * _HOUR)
        run.run_to_parquet(plan, "asof-late", checkpoint=state, out=out)

    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "value").filter("event_type IN ('purchase', 'view')")
    run.feed(in_parts(rows, F.col("event_id") % 10 == 3, events(spark, sf_dir)), "part", 4, "asof-late-in", once)
    return spark.read.parquet(out).select(F.get_json_object("row", "$.event_id").cast("bigint").alias("trade_id"), F.col("key").alias("user_id"), F.col("value_ms").alias("rate_ms"), F.round("value", 4).alias("rate"))


_ENRICHED = f"""WITH p AS (SELECT a.event_id AS trade_id, b.event_id AS quote_id, a.user_id, a.ts, a.value AS price {_PAIRS.format(24, 0)}),
      r AS (SELECT * FROM events WHERE event_type = 'signup')
      SELECT p.trade_id, p.quote_id, round(r.value, 4) AS rate, c.c_mktsegment AS tier, floor(coalesce(p.price * r.value, 0) * 100 + 0.5) / 100 AS notional_usd
      FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.ts >= r.ts LEFT JOIN customer c ON c.c_custkey = p.user_id"""


@query(_ENRICHED)
def multiway_enrich(spark, sf_dir):
    """Interval join with quotes, as-of join with rates, lookup of the account."""
    trades, quotes = _trades_quotes(events(spark, sf_dir))
    pairs = joins.bucketed_interval_join(trades, quotes, ["user_id"], "trade_ts", "quote_ts", 86_400, 0)
    rates = events(spark, sf_dir, "signup").select("user_id", F.col("ts").alias("rate_ts"), F.col("value").alias("rate"))
    rated = joins.asof_join(pairs, rates, ["user_id"], "trade_ts", "rate_ts", ["rate"], bucket=F.to_date("__ts"))
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tier"))
    out = joins.lookup_join(rated, accounts, ["user_id"], ["tier"])
    return out.select("trade_id", "quote_id", F.round("rate", 4).alias("rate"), "tier", X.half_up(X.notional_usd(F.lit(1), F.col("price"), F.col("rate")), 2).alias("notional_usd"))


@query(_ENRICHED)
def multiway_asof_stream(spark, sf_dir):
    """The same as a stream over four micro-batches: interval join, as-of join with state on what it gives, lookup. Marks
    a month and two months behind the last event close the sources (the first one the join, the second one what follows it),
    so all rows come out."""
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tier"))
    state, out = run.scratch(spark, "multiway-asof-state"), run.scratch(spark, "multiway-asof-out")
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "value").filter("event_type IN ('purchase', 'view', 'signup')")
    marks = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.explode(F.array(*map(F.lit, ("purchase", "view", "signup")))).alias("event_type"), "ts", F.lit(0.0).alias("value"))
    marks = [marks.withColumns({"ts": F.col("ts") + F.expr(f"interval {30 * k} days"), "part": F.lit(2 + k).cast("bigint")}) for k in (1, 2)]

    def once(stream: DataFrame) -> None:
        side = lambda kind, name, value: stream.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"), F.col("value").alias(value)).withWatermark(f"{name}_ts", "5 seconds")
        pairs = joins.interval_join(side("purchase", "trade", "price"), side("view", "quote", "quote").drop("quote"), ["user_id"], "trade_ts", "quote_ts", "-24 hours", "0 hours").drop("quote_ts")
        rated = stateful.asof_stream(pairs.withColumnRenamed("trade_ts", "ts"), side("signup", "rate", "rate").withColumnRenamed("rate_ts", "ts"), "user_id", "ts", "rate", 6 * _HOUR, None)
        row = F.from_json("row", "trade_id bigint, quote_id bigint, price double").alias("r")
        found = joins.lookup_join(rated.select(F.col("key").alias("user_id"), row, F.col("value").alias("rate")), accounts, ["user_id"], ["tier"])
        run.run_to_parquet(found.select("r.*", "rate", "tier"), "multiway-asof", checkpoint=state, out=out)

    run.feed(in_parts(rows).unionByName(marks[0]).unionByName(marks[1]), "part", 5, "multiway-asof-in", once)
    kept = spark.read.parquet(out).filter("trade_id IS NOT NULL")
    return kept.select("trade_id", "quote_id", F.round("rate", 4).alias("rate"), "tier", X.half_up(X.notional_usd(F.lit(1), F.col("price"), F.col("rate")), 2).alias("notional_usd"))


_FILLS = "(SELECT CASE WHEN l_orderkey % 20 = 0 THEN -l_orderkey ELSE l_orderkey END AS k, sum(l_quantity) AS filled FROM lineitem WHERE l_orderkey % 5 <> 1 GROUP BY 1)"


def _orders_fills(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A fifth of the orders without fill, some fills of unknown orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 <> 1")
    key = F.when(F.col("l_orderkey") % 20 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    return orders, lines.groupBy(key.alias("k")).agg(F.sum("l_quantity").alias("filled"))


@query(f"SELECT coalesce(o.o_orderkey, f.k) AS k, o.o_totalprice AS price, f.filled, CASE WHEN o.o_orderkey IS NULL THEN 'RIGHT_ORPHAN' WHEN f.k IS NULL THEN 'LEFT_ORPHAN' ELSE 'INNER' END AS join_kind FROM orders o FULL JOIN {_FILLS} f ON o.o_orderkey = f.k")
def orders_full_tagged(spark, sf_dir):
    return joins.tagged_full_join(*_orders_fills(spark, sf_dir), ["k"])


def _plain_join(how: str, sql: str):
    def plan(spark, sf_dir):
        orders, fills = _orders_fills(spark, sf_dir)
        return orders.join(fills, "k", how)

    plan.__name__ = f"orders_{how}"
    query(f"SELECT {sql} AS k, o.o_totalprice AS price, f.filled FROM orders o {how} JOIN {_FILLS} f ON o.o_orderkey = f.k")(plan)


for _how, _key in (("inner", "f.k"), ("left", "o.o_orderkey"), ("right", "f.k")):
    _plain_join(_how, _key)


@query("""SELECT t.event_id AS trade_id, q.event_id AS quote_id, f.event_id AS rate_id, c.c_mktsegment AS tier FROM events t
      JOIN events q ON q.event_type = 'view' AND q.user_id = t.user_id AND q.ts BETWEEN t.ts - INTERVAL 24 HOUR AND t.ts
      JOIN events f ON f.event_type = 'signup' AND f.user_id = t.user_id AND f.ts BETWEEN t.ts - INTERVAL 72 HOUR AND t.ts
      LEFT JOIN customer c ON c.c_custkey = t.user_id WHERE t.event_type = 'purchase'""")
def multiway_stream(spark, sf_dir):
    """Chained stateful joins: trades with quotes, what comes out with rates, then the account; fed in four parts, each a
    restart from the checkpoint."""
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tier"))
    state, out = run.scratch(spark, "multiway-state"), run.scratch(spark, "multiway-out")

    def once(stream: DataFrame) -> None:
        side = lambda kind, name: stream.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", "5 seconds")
        pairs = joins.interval_join(side("purchase", "trade"), side("view", "quote"), ["user_id"], "trade_ts", "quote_ts", "-24 hours", "0 hours").drop("quote_ts")
        rated = joins.interval_join(pairs, side("signup", "rate"), ["user_id"], "trade_ts", "rate_ts", "-72 hours", "0 hours").drop("rate_ts")
        run.run_to_parquet(joins.lookup_join(rated, accounts, ["user_id"], ["tier"]), "multiway", checkpoint=state, out=out)

    run.feed(in_parts(events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")), "part", 4, "multiway-in", once)
    return spark.read.parquet(out).select("trade_id", "quote_id", "rate_id", "tier")


@query("""WITH l AS (SELECT user_id AS key, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) n FROM events WHERE event_type = 'purchase') WHERE n = 1),
      r AS (SELECT user_id AS key, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) n FROM events WHERE event_type = 'signup') WHERE n = 1),
      m AS (SELECT max(ts) - INTERVAL 5 SECOND AS mark FROM events),
      j AS (SELECT coalesce(l.key, r.key) AS key, l.event_id AS le, r.event_id AS re, l.ts AS lt, r.ts AS rt FROM l FULL JOIN r ON l.key = r.key),
      k AS (SELECT *, CASE WHEN abs(epoch_us(lt) // 1000 - epoch_us(rt) // 1000) <= 3600000 THEN 'INNER' WHEN rt IS NULL OR lt < rt THEN 'LEFT_ORPHAN' ELSE 'RIGHT_ORPHAN' END AS join_kind FROM j)
      SELECT key, join_kind, CASE WHEN join_kind <> 'RIGHT_ORPHAN' THEN CAST(le AS VARCHAR) END AS left_value, CASE WHEN join_kind <> 'LEFT_ORPHAN' THEN CAST(re AS VARCHAR) END AS right_value
      FROM k, m WHERE join_kind = 'INNER' OR least(coalesce(lt, rt), coalesce(rt, lt)) + INTERVAL 1 HOUR <= mark""")
def orphan_deadline_stream(spark, sf_dir):
    """One row a key: the first purchase met by the first sign-up, or an orphan an hour later."""
    plan = lambda stream: stateful.match_or_orphan_stream(stream.filter("event_type = 'purchase'"), stream.filter("event_type = 'signup'"), "user_id", "ts", "event_id", _HOUR, 40 * 24 * _HOUR, "5 seconds")
    return in_batches(spark, sf_dir, "orphans", plan)


_LOOKUP = "SELECT l_orderkey, l_linenumber, p_brand, s_name, round(l_quantity * p_retailprice, 2) AS notional FROM lineitem {0} JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) p ON l_partkey = p_partkey {0} JOIN supplier ON l_suppkey = s_suppkey"


def _lookup(spark, sf_dir, how: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    part = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0")
    out = joins.lookup_join(lines, part, ["p_partkey"], ["p_brand", "p_retailprice"], how)
    out = joins.lookup_join(out, table(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_name"], how)
    return out.select("l_orderkey", "l_linenumber", "p_brand", "s_name", F.round(X.notional(F.col("l_quantity"), F.col("p_retailprice")), 2).alias("notional"))


@query(_LOOKUP.format("LEFT"))
def lookup_multi(spark, sf_dir):
    return _lookup(spark, sf_dir, "left")


@query(_LOOKUP.format("INNER"))
def lookup_inner(spark, sf_dir):
    return _lookup(spark, sf_dir, "inner")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 1) JOIN part ON l_partkey = p_partkey")
def lookup_probe(spark, sf_dir):
    """The log's first row looked up, as a probe of the dimension; the limit is the feature."""
    first = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).orderBy("l_orderkey", "l_linenumber", "p_partkey").limit(1)
    return joins.lookup_join(first, table(spark, sf_dir, "part"), ["p_partkey"], ["p_brand"], "inner").select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT a.event_id AS event_id, a.user_id, c.c_name AS account_name, c.c_custkey IS NULL AS missing FROM events a LEFT JOIN customer c ON a.user_id = c.c_custkey WHERE a.event_type = 'purchase'")
def lookup_stream(spark, sf_dir):
    """Stream lookup: the dimension is read again for each of four micro-batches, nothing is kept in state."""
    accounts = refresh.RefreshedDimension(spark, lambda: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("account_name")))
    out, state = run.scratch(spark, "lookup"), run.scratch(spark, "lookup-state")
    rows = in_parts(events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts"))
    once = lambda stream: refresh.refreshed_lookup(stream.filter("event_type = 'purchase'").select("event_id", "user_id"), accounts, ["user_id"], ["account_name"], out, "lookup", checkpoint=state)
    run.feed(rows, "part", 4, "lookup-in", once)
    accounts.release()
    return spark.read.parquet(out).select("event_id", "user_id", "account_name", F.col("account_name").isNull().alias("missing"))


@query(f"""SELECT e.event_id AS event_id, e.user_id, CASE WHEN part >= 2 THEN c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN '-VIP' ELSE '' END WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS tier
      FROM ({_PARTS}) e LEFT JOIN customer c ON e.user_id = c.c_custkey""")
def lookup_refreshed_stream(spark, sf_dir):
    """A dimension that changes after the first of four micro-batches (new accounts, new tiers of a fifth) and is read again
    a minute after it was read; batches come half a minute apart, so the second one still sees what the first one saw."""
    folder, out, state, now = run.scratch(spark, "accounts"), run.scratch(spark, "refreshed"), run.scratch(spark, "refreshed-state"), [0.0]
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tier"))
    load = lambda: io.latest_by_key(spark.read.parquet(folder), ["user_id"], ["version"]).select("user_id", "tier")
    accounts = refresh.RefreshedDimension(spark, load, every_s=60, clock=lambda: now[0])
    customer.filter("user_id % 3 <> 0").withColumn("version", F.lit(1)).write.parquet(folder)

    def once(stream: DataFrame) -> None:
        refresh.refreshed_lookup(stream.select("event_id", "user_id"), accounts, ["user_id"], ["tier"], out, "refreshed", checkpoint=state)
        if now[0] == 0:
            tier = F.concat("tier", F.when(F.col("user_id") % 5 == 0, "-VIP").otherwise(""))
            customer.withColumns({"tier": tier, "version": F.lit(2)}).write.mode("append").parquet(folder)
        now[0] += 30

    run.feed(in_parts(events(spark, sf_dir).select("event_id", "user_id", "ts"), F.col("event_id") % 10 == 3), "part", 4, "refreshed-in", once)
    accounts.release()
    return spark.read.parquet(out).select("event_id", "user_id", "tier")


@query("SELECT c_mktsegment, count(*) AS customers, count(o.k) AS with_orders, count(*) - count(o.k) AS without_orders FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c_custkey = o.k GROUP BY 1")
def dim_reconcile(spark, sf_dir):
    active = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    both = table(spark, sf_dir, "customer").join(active, F.col("c_custkey") == F.col("k"), "left")
    return both.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.count("k").alias("with_orders"), (F.count(F.lit(1)) - F.count("k")).alias("without_orders"))


@query("SELECT p_brand, count(*) AS trades, round(avg(p_retailprice), 4) AS avg_price FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def cold_live_join(spark, sf_dir):
    history = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    joined = joins.lookup_join(history, table(spark, sf_dir, "part"), ["p_partkey"], ["p_brand", "p_retailprice"])
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("trades"), F.round(F.avg("p_retailprice"), 4).alias("avg_price"))


@query("SELECT o_orderkey, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS tier FROM orders JOIN customer ON o_custkey = c_custkey")
def changelog_join_final(spark, sf_dir):
    """Orders joined with accounts of which a third changes after the first half of the orders: earlier rows are revised."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    dim = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("tier"))
    changed = dim.filter("c_custkey % 3 = 0").withColumn("tier", F.lit("NEW"))
    first, second = orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1")
    none_o, none_d = first.limit(0), dim.limit(0)
    log = joins.revise_join(first, none_o, none_d, dim, ["c_custkey"]).withColumn("seq", F.lit(1))
    log = log.unionByName(joins.revise_join(second, first, changed, dim, ["c_custkey"]).withColumn("seq", F.lit(2)))
    return io.latest_by_key(log, ["o_orderkey"], ["seq"]).select("o_orderkey", "c_custkey", "tier")


_TIERS = "SELECT 0 AS version, c_custkey, c_mktsegment AS tier FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 1, c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'VIP' ELSE c_mktsegment END FROM customer"


@query(f"SELECT b AS batch, o_orderkey, o_custkey AS c_custkey, tier FROM range(4) r(b) JOIN orders ON o_orderkey % 4 <= b JOIN ({_TIERS}) c ON c.c_custkey = o_custkey AND version = CASE WHEN b < 2 THEN 0 ELSE 1 END")
def revised_join_stream(spark, sf_dir):
    """Orders in four micro-batches joined with accounts whose change feed comes along; before the third one a fifth of the
    accounts gets a new tier and a third comes in anew. The log of results folded after each batch."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("tier"))
    path = run.scratch(spark, "revised-join")
    schema = StructType(list(rows.schema)).add("seq", LongType())
    accounts = keyed.KeyedTable(spark, f"{path}/accounts", schema, ["c_custkey"], buckets=4, feed=True)
    join = revise.RevisedJoin(spark, f"{path}/join", orders.schema, rows.schema, ["c_custkey"], buckets=4)
    accounts.merge(rows.filter("c_custkey % 3 <> 0").withColumn("seq", F.lit(0).cast("bigint")), 0)
    taken = []

    def once(stream: DataFrame) -> None:
        if len(taken) == 2:
            tier = F.when(F.col("c_custkey") % 5 == 0, "VIP").otherwise(F.col("tier"))
            accounts.merge(rows.withColumns({"tier": tier, "seq": F.lit(1).cast("bigint")}), 1)
        join.run(stream, accounts.change_stream())
        taken.append(1)

    run.feed(orders.withColumn("part", F.pmod("o_orderkey", F.lit(4))), "part", 4, "revised-in", once)
    log = join.log()
    after = [revise.folded(log, b).withColumn("batch", F.lit(b).cast("bigint")) for b in range(4)]
    return reduce(DataFrame.unionByName, after).select("batch", "o_orderkey", "c_custkey", "tier")


# aggregations


@query("SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS largest, min(o_totalprice) AS smallest FROM orders GROUP BY 1 ORDER BY orders DESC, o_custkey LIMIT 10")
def account_activity_topk(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("largest"), F.min("o_totalprice").alias("smallest"))
    return sums.orderBy(F.desc("orders"), "o_custkey").limit(10)


@query("SELECT p_type AS sector, count(*) AS n, round(avg(p_retailprice), 4) AS avg_price FROM part GROUP BY 1")
def sector_stats(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("sector")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("avg_price")).orderBy("sector")


@query("SELECT n_name, count(*) AS trades, round(sum(l_quantity * l_extendedprice), 0) AS notional FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def notional_by_country(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), X.notional(F.col("l_quantity"), F.col("l_extendedprice")).alias("v"))
    by = lines.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("v"))  # one row a supplier before the joins
    out = joins.lookup_join(by, table(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_nationkey"], "inner")
    out = joins.lookup_join(out, table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), ["s_nationkey"], ["n_name"], "inner")
    return out.groupBy("n_name").agg(F.sum("c").alias("trades"), F.round(F.sum("v"), 0).alias("notional")).orderBy(F.desc("notional"))


@query("SELECT count(*) AS n, count(o_orderpriority) AS n_priority FROM orders")
def global_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderpriority").alias("n_priority"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 AND l_shipdate >= TIMESTAMP '1995-01-01'")
def narrow_filter(spark, sf_dir):
    """Filters and two columns reach the scan; the start position is a filter too."""
    recent = io.from_position(table(spark, sf_dir, "lineitem"), "l_shipdate", F.lit("1995-01-01").cast("timestamp_ntz"))
    return recent.filter("l_returnflag = 'R' AND l_quantity > 40").select("l_orderkey", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, floor(l_quantity * l_extendedprice * 100 + 0.5) / 100 AS notional, floor(l_quantity * l_extendedprice * 0.0005 * 10000 + 0.5) / 10000 AS commission, floor(l_quantity * l_extendedprice * 0.0001 * 10000 + 0.5) / 10000 AS tax, epoch_us(l_shipdate) // 1000 + 172800000 AS settled_at, 's01-app1' AS source_app FROM lineitem")
def settlement_fees(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", X.to_millis(F.col("l_shipdate")).alias("ms"))
    out = X.stamped(X.settlement(lines, "l_quantity", "l_extendedprice", "ms"), "s01-app1")
    return out.select("l_orderkey", "l_linenumber", *(X.half_up(F.col(c), d).alias(c) for c, d in (("notional", 2), ("commission", 4), ("tax", 4))), "settled_at", "source_app")


@query("SELECT event_id, floor(value * 100 + 0.5) / 100 AS mid, value - value * CAST(0.00025 AS DOUBLE) AS bid, value + value * CAST(0.00025 AS DOUBLE) AS ask, CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS band FROM events WHERE event_type = 'view'")
def quote_spread(spark, sf_dir):
    bid, ask = X.bid_ask(F.col("value"))
    return events(spark, sf_dir, "view").select("event_id", X.half_up(F.col("value"), 2).alias("mid"), bid.alias("bid"), ask.alias("ask"), F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("band"))


_CURRENCY = """WITH c AS (SELECT c_custkey, c_name, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS HUGEINT))), lambda a, x: (a * 31 + x) % 4294967296) AS h FROM customer),
      s AS (SELECT c_custkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM c)
      SELECT c_custkey, CAST(h AS BIGINT) AS hash, (['USD', 'EUR', 'JPY', 'GBP'])[CAST(((h % 4) + 4) % 4 AS INT) + 1] AS currency FROM s"""


@query(_CURRENCY)
def account_currency(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.string_hash(F.col("c_name")).alias("hash"), X.currency_of(F.col("c_name")).alias("currency"))


@query(f"SELECT c_custkey AS account_id, currency FROM ({_CURRENCY})")
def currency_function(spark, sf_dir):
    """The currency as a SQL function, over names in camel case that come out in snake case."""
    X.register_sql_functions(spark)
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("accountId"), F.col("c_name").alias("accountName"))
    return spark.sql("SELECT account_id, currency_of(account_name) AS currency FROM {accounts}", accounts=X.snake_columns(accounts))


# duplicates and quality

_DUP = "(SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0 AND event_id > 0)"


def _doubled(spark, sf_dir) -> DataFrame:
    return quality.inject_duplicates(events(spark, sf_dir), "event_id", 10)


@query(f"SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 1) AS dup_keys, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT event_id, count(*) AS n FROM {_DUP} GROUP BY 1)")
def dup_report(spark, sf_dir):
    return quality.duplicate_report(_doubled(spark, sf_dir), ["event_id"])


@query(f"SELECT event_id, count(*) AS n FROM {_DUP} GROUP BY 1 HAVING count(*) > 1")
def having_dups(spark, sf_dir):
    return quality.duplicates(_doubled(spark, sf_dir), ["event_id"])


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_first(spark, sf_dir):
    return quality.dedup_first(events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id FROM events),
      p AS (SELECT user_id, min(ms) AS ms FROM o GROUP BY 1 UNION ALL SELECT p.user_id, (SELECT min(o.ms) FROM o WHERE o.user_id = p.user_id AND o.ms >= p.ms + 86400000) FROM p WHERE p.ms IS NOT NULL)
      SELECT o.event_id, o.user_id FROM p JOIN o ON o.user_id = p.user_id AND o.ms = p.ms""")
def dedup_ttl_stream(spark, sf_dir):
    """A user's first event, and the first after each day that has passed since the one before."""
    plan = lambda stream: stateful.dedup_stream(stream.select("event_id", "user_id", "ts", F.unix_millis("ts").alias("ms")), "user_id", "ms", "ts", 24 * _HOUR, "5 seconds")
    return in_batches(spark, sf_dir, "dedup", plan).select("event_id", "user_id")


@query("SELECT min(event_id) AS event_id, user_id FROM events GROUP BY user_id")
def dedup_store_stream(spark, sf_dir):
    """A user's first event, over four parts that arrive in the order of ids, each a restart; the state store remembers a user for a
    day by the clock, so no repeat passes in this run."""
    rows = events(spark, sf_dir).select("event_id", "user_id")
    top = rows.agg(F.max("event_id")).first()[0] or 0
    rows = rows.withColumn("part", F.floor(F.col("event_id") * 4 / (top + 1)))
    sizes = {r[0]: r[1] for r in rows.groupBy("part").count().collect()}
    left, state, out = [sizes.get(k, 0) for k in range(4)], run.scratch(spark, "store-state"), run.scratch(spark, "store-out")
    once = lambda stream: run.run_for(stateful.dedup_store_stream(stream, "user_id", "event_id", 24 * _HOUR), "store", left.pop(0), out, state)
    run.feed(rows, "part", 4, "store-in", once)
    return spark.read.parquet(out).select("event_id", "user_id")


@query("SELECT user_id, count(*) AS committed, count(*) AS upserted, 2 * count(*) AS appended FROM events GROUP BY user_id")
def replayed_sinks(spark, sf_dir):
    """Events arrive in four parts, each a restart, and then all come once more from the beginning, under a fresh checkpoint. A
    plain append repeats them, an upsert by key doesn't; the file sink's own commits keep restarts from repeating any."""
    data, folder = in_parts(events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")), run.scratch(spark, "replayed")
    table_ = keyed.KeyedTable(spark, f"{folder}/upserted", data.drop("part").schema, ["event_id"], buckets=4, order="ts")
    streams: list[DataFrame] = []

    def sink(first: int) -> Callable[[DataFrame, int], None]:
        def each(batch: DataFrame, batch_id: int) -> None:
            io.append_log(batch, f"{folder}/appended", "event_type")
            table_.merge(batch, first + batch_id)

        return each

    def once(stream: DataFrame) -> None:
        streams.append(stream)
        run.run_batches(stream, sink(0), "replayed", checkpoint=f"{folder}/state")
        run.run_to_parquet(stream, "committed", checkpoint=f"{folder}/committed-state", out=f"{folder}/committed")

    run.feed(data, "part", 4, "replayed-in", once)
    run.run_batches(streams[-1], sink(1000), "replayed-again")
    count = lambda df, name: df.select("user_id", *(F.lit(int(name == c)).alias(c) for c in ("committed", "upserted", "appended")))
    sinks = {"committed": spark.read.parquet(f"{folder}/committed"), "upserted": table_.read(), "appended": spark.read.parquet(f"{folder}/appended")}
    every = reduce(DataFrame.unionByName, (count(df, name) for name, df in sinks.items()))
    return every.groupBy("user_id").agg(*(F.sum(c).cast("bigint").alias(c) for c in sinks))


_PURCHASES = "SELECT '{0}' AS mode, CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events WHERE event_type = 'purchase' GROUP BY ALL"


@query(" UNION ALL ".join(map(_PURCHASES.format, ("batch", "stream"))))
def log_scan_modes(spark, sf_dir):
    """A log table by day, appended to twice, read whole and as a stream by one plan."""
    path, rows = run.scratch(spark, "log"), events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    for k in range(2):
        io.append_log(rows.filter(F.col("event_id") % 2 == k), path, "day")
    plan = lambda log: log.filter("event_type = 'purchase'").select("day", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    modes = {"batch": plan(spark.read.schema(rows.schema).parquet(path)), "stream": run.run_to_parquet(plan(spark.readStream.schema(rows.schema).parquet(path)), "log")}
    every = reduce(DataFrame.unionByName, (df.withColumn("mode", F.lit(name)) for name, df in modes.items()))
    return every.groupBy("mode", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


_BY_HOUR = "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n FROM {0} GROUP BY ALL"


@query(_BY_HOUR.format("events"))
def dedup_then_count(spark, sf_dir):
    clean = _doubled(spark, sf_dir).dropDuplicates(["event_id"])
    return ntz(windows.tumbling(clean, ["user_id"], "ts", "1 hour", [F.count(F.lit(1)).alias("n")]), "window_start").drop("window_end")


@query(_BY_HOUR.format(_DUP))
def naive_count(spark, sf_dir):
    return ntz(windows.tumbling(_doubled(spark, sf_dir), ["user_id"], "ts", "1 hour", [F.count(F.lit(1)).alias("n")]), "window_start").drop("window_end")


@query("SELECT count(*) AS total, count(*) FILTER (c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL) AS complete, count(*) FILTER (c_acctbal < 0) AS negative FROM customer")
def completeness(spark, sf_dir):
    return quality.coverage(table(spark, sf_dir, "customer"), {"complete": F.col("c_acctbal").isNotNull() & F.col("c_mktsegment").isNotNull(), "negative": F.col("c_acctbal") < 0})


@query("WITH s AS (SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS target_rows) SELECT source_rows, target_rows, abs(source_rows - target_rows) AS lag, abs(source_rows - target_rows) <= floor(source_rows / 10) + 50 AS within FROM s")
def count_reconcile(spark, sf_dir):
    return quality.reconcile(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey").distinct())


@query("SELECT count(*) AS keys, count(c_custkey) AS hits, count(*) - count(c_custkey) AS misses FROM (SELECT DISTINCT o_custkey * 2 AS k FROM orders) LEFT JOIN customer ON c_custkey = k")
def point_lookup_batch(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("k")).distinct()
    found = keys.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey") == F.col("k"), "left")
    return found.agg(F.count(F.lit(1)).alias("keys"), F.count("c_custkey").alias("hits"), (F.count(F.lit(1)) - F.count("c_custkey")).alias("misses"))


@query("SELECT event_id, event_type AS source, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'view') AND props IS NOT NULL")
def envelope_router(spark, sf_dir):
    """Envelopes routed by source to typed rows; unknown sources are dropped."""
    schema = StructType([StructField("k", LongType())])
    routed = io.route_envelopes(events(spark, sf_dir), F.upper("event_type"), F.col("event_id"), F.col("props"), {"click": schema, "view": schema})
    return routed["click"].withColumn("source", F.lit("click")).unionByName(routed["view"].withColumn("source", F.lit("view"))).select(F.col("key").alias("event_id"), "source", "k")


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 3 <> 0")
def tolerant_json(spark, sf_dir):
    """Events as JSON messages of which a third is cut off: malformed ones go, camelCase is read as snake_case."""
    named = events(spark, sf_dir).select(F.col("event_id").alias("eventId"), F.col("user_id").alias("userId"), "value")
    sent = io.to_key_value(named, "eventId").select(F.when(F.col("key").cast("bigint") % 3 == 0, F.substring("value", 1, 9)).otherwise(F.col("value")).alias("value"))
    return io.parse_events(sent, StructType([StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("value", DoubleType())]))


_REJECTS = "SELECT CASE WHEN event_id % 7 = 0 THEN 'empty' WHEN event_id % 3 = 0 THEN 'malformed' WHEN event_id % 5 = 0 THEN 'no_key' ELSE 'good' END AS reason, count(*) AS n FROM events GROUP BY 1"


def _messages(rows: DataFrame) -> DataFrame:
    """Events as JSON messages: a seventh without text, a third cut off, a fifth without its key."""
    sent = F.to_json(F.struct(F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("eventId"), F.col("user_id").alias("userId"), "value"))
    cut = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, " ")).when(F.col("event_id") % 3 == 0, F.substring(sent, 1, 9)).otherwise(sent)
    return rows.select(cut.alias("value"))


_MESSAGE = StructType([StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("value", DoubleType())])


def _reasons(spark, counts) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in sorted(counts.items()) if v], "reason string, n bigint")


@query(_REJECTS)
def rejects_counted(spark, sf_dir):
    """Rejected messages by reason, observed while the good ones are written."""
    good, seen = rejects.parse_counted(_messages(events(spark, sf_dir)), _MESSAGE, "messages")
    io.discard(good)
    return _reasons(spark, seen.get)


@query(_REJECTS)
def rejects_counted_stream(spark, sf_dir):
    """The same over four micro-batches, told to a listener."""
    told, state, out = rejects.RejectCounts("messages"), run.scratch(spark, "rejects-state"), run.scratch(spark, "rejects-out")
    spark.streams.addListener(told)
    try:
        once = lambda stream: run.run_to_parquet(rejects.parse_counted(_messages(stream), _MESSAGE, "messages")[0], "rejects", checkpoint=state, out=out)
        run.feed(in_parts(events(spark, sf_dir).select("event_id", "user_id", "value", "ts")), "part", 4, "rejects-in", once)
        return _reasons(spark, told.totals())
    finally:
        spark.streams.removeListener(told)


@query("SELECT user_id, round(avg(value), 6) AS mean_of_largest FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS n FROM events WHERE value IS NOT NULL) WHERE n <= 5 GROUP BY 1")
def accumulated(spark, sf_dir):
    """An accumulator without a built-in twin: the mean of a user's five largest values."""
    out = accumulators.accumulate(events(spark, sf_dir), "user_id", "value", accumulators.LargestMean(5), "mean_of_largest")
    return out.filter("mean_of_largest IS NOT NULL").select("user_id", F.round("mean_of_largest", 6).alias("mean_of_largest"))


_EIGHTHS = "SELECT *, least(7, CAST(8 * (epoch_us(ts) // 1000 - lo) // (hi - lo + 1) AS BIGINT)) AS part FROM events, (SELECT min(epoch_us(ts) // 1000) AS lo, max(epoch_us(ts) // 1000) AS hi FROM events)"


@query(f"""SELECT b AS batch_id, max(epoch_us(ts) // 1000) FILTER (event_type = 'purchase' AND part <= b) AS trades, max(epoch_us(ts) // 1000) FILTER (event_type = 'view' AND part <= 2 * b + 1) AS quotes,
      abs(max(epoch_us(ts) // 1000) FILTER (event_type = 'purchase' AND part <= b) - max(epoch_us(ts) // 1000) FILTER (event_type = 'view' AND part <= 2 * b + 1)) AS drift_ms FROM range(8) r(b), ({_EIGHTHS}) GROUP BY b""")
def admission_drift(spark, sf_dir):
    """Two sources of eight files each, of which one admits a file a trigger and the other two: how far they drift apart."""
    rows = in_parts(events(spark, sf_dir).select("event_type", "ts"), count=8)
    sources = {}
    for name, kind, files in (("trades", "purchase", 1), ("quotes", "view", 2)):
        folder, own = run.scratch(spark, name), rows.filter(F.col("event_type") == kind).select("ts", "part")
        for k in range(8):
            own.filter(F.col("part") == k).select("ts").coalesce(1).write.parquet(f"{folder}/{k}")
        sources[name] = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", files).parquet(f"{folder}/*").select("ts", F.lit(name).alias("source"))
    out = run.scratch(spark, "admitted")
    run.run_batches(sources["trades"].unionByName(sources["quotes"]), lambda batch, i: io.write_once(batch, i, out), "admitted")
    return run.admitted(spark.read.parquet(out).withColumn("batch_id", F.col("batch_id").cast("bigint")), "source", "ts").select("batch_id", "trades", "quotes", "drift_ms")


# keyed tables


def _writes(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), "event_type", "value")


def _keyed(spark, name: str, df: DataFrame, **how) -> keyed.KeyedTable:
    """The writes applied in two batches, the second of them twice."""
    out = keyed.KeyedTable(spark, run.scratch(spark, name), df.schema, ["user_id"], buckets=4, **how)
    half = F.col("seq" if "seq" in df.columns else "part") % 2
    for i, part in enumerate((0, 1, 1)):
        out.merge(df.filter(half == part), min(i, 1))
    return out


@query("SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY 1")
def merge_lww(spark, sf_dir):
    return _keyed(spark, "lww", _writes(spark, sf_dir)).read()


@query("SELECT user_id, min(event_id) AS seq, min_by(event_type, event_id) AS event_type, min_by(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT user_id, min(event_id), min_by(event_type, event_id), min_by(value, event_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def merge_first_row(spark, sf_dir):
    """The batch of even numbers comes first: its rows stay."""
    writes = _writes(spark, sf_dir)
    out = keyed.KeyedTable(spark, run.scratch(spark, "first"), writes.schema, ["user_id"], "first", buckets=4)
    for i, part in enumerate((0, 1)):
        out.merge(writes.filter(F.col("seq") % 2 == part), i)
    return out.read()


@query("SELECT user_id, max(version) AS version, max_by(event_id, (version, event_id)) AS seq FROM (SELECT *, (event_id * 37) % 101 AS version FROM events) GROUP BY 1")
def merge_versioned(spark, sf_dir):
    writes = events(spark, sf_dir).select("user_id", ((F.col("event_id") * 37) % 101).alias("version"), F.col("event_id").alias("seq"))
    return _keyed(spark, "versioned", writes, engine="versioned").read()


@query("SELECT user_id, 0 AS part, count(*) AS n, round(sum(value), 2) AS total, max(value) AS largest, min(value) AS smallest FROM events GROUP BY 1")
def merge_aggregate(spark, sf_dir):
    writes = events(spark, sf_dir).select("user_id", (F.col("event_id") % 2).alias("part"), F.lit(1).cast("bigint").alias("n"), F.col("value").alias("total"), F.col("value").alias("largest"), F.col("value").alias("smallest"))
    rules = {"part": "min", "n": "sum", "total": "sum", "largest": "max", "smallest": "min"}
    out = keyed.KeyedTable(spark, run.scratch(spark, "aggregate"), writes.schema, ["user_id"], "aggregate", buckets=4, rules=rules)
    for i, part in enumerate((0, 1, 1)):
        out.merge(writes.filter(F.col("part") == part), min(i, 1))
    return out.read().select("user_id", F.lit(0).alias("part"), "n", F.round("total", 2).alias("total"), "largest", "smallest")


@query("SELECT user_id, max_by(value, event_id) FILTER (event_type = 'click') AS click, max_by(value, event_id) FILTER (event_type = 'view') AS view, max_by(value, event_id) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1")
def merge_partial(spark, sf_dir):
    """Three sources own a column each of one row."""
    kinds = ("click", "view", "purchase")
    writes = events(spark, sf_dir).filter(F.col("event_type").isin(*kinds)).select("user_id", "event_type", *(F.col("value").alias(k) for k in kinds), F.col("event_id").alias("seq"))
    out = keyed.KeyedTable(spark, run.scratch(spark, "partial"), writes.drop("event_type").schema, ["user_id"], "partial", buckets=4)
    for i, kind in enumerate(kinds):
        out.merge(writes.filter(F.col("event_type") == kind), i, [kind])
    return out.read().drop("seq")


_V1, _V2 = "(SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 7 <> 0)", "(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 11 <> 0)"


@query(f"""WITH b AS {_V1}, a AS {_V2}, j AS (SELECT b.c_custkey AS bk, a.c_custkey AS ak, b.c_mktsegment AS bs, a.c_mktsegment AS "as", b.c_acctbal AS bb, a.c_acctbal AS ab FROM b FULL JOIN a ON a.c_custkey = b.c_custkey)
      SELECT '+I' AS op, ak AS c_custkey, "as" AS c_mktsegment, ab AS c_acctbal FROM j WHERE bk IS NULL UNION ALL SELECT '-D', bk, bs, bb FROM j WHERE ak IS NULL
      UNION ALL SELECT '-U', bk, bs, bb FROM j WHERE bk = ak AND bs <> "as" UNION ALL SELECT '+U', ak, "as", ab FROM j WHERE bk = ak AND bs <> "as" """)
def changelog_diff(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    before = customer.filter("c_custkey % 7 <> 0")
    after = customer.filter("c_custkey % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "VIP").otherwise(F.col("c_mktsegment")))
    return keyed.changelog(before, after, ["c_custkey"])


@query("""WITH v AS (SELECT user_id, max(event_id) AS seq, max_by(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1),
      w AS (SELECT user_id, max(event_id) AS seq, max_by(value, event_id) AS value FROM events GROUP BY 1)
      SELECT '+I' AS op, v.*, CAST(0 AS BIGINT) AS batch_id FROM v UNION ALL SELECT '+I', w.*, 1 FROM w WHERE user_id NOT IN (SELECT user_id FROM v)
      UNION ALL SELECT '-U', v.*, 1 FROM v JOIN w ON v.user_id = w.user_id AND v.seq <> w.seq UNION ALL SELECT '+U', w.*, 1 FROM v JOIN w ON v.user_id = w.user_id AND v.seq <> w.seq""")
def change_feed_stream(spark, sf_dir):
    """Change rows that merges write, read as a stream; the replayed batch adds none."""
    out = _keyed(spark, "feed", _writes(spark, sf_dir).drop("event_type"), feed=True)
    return run.run_to_parquet(out.change_stream(), "feed")


@query("SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def snapshot_as_of(spark, sf_dir):
    """Time travel to the table's first snapshot."""
    return _keyed(spark, "travel", _writes(spark, sf_dir)).read(snapshot=1)


@query("SELECT snapshot_id, batch_id, CASE WHEN snapshot_id = 1 THEN a ELSE b END AS total_record_count FROM (VALUES (CAST(1 AS BIGINT), CAST(0 AS BIGINT)), (2, 1)) t(snapshot_id, batch_id), (SELECT count(DISTINCT user_id) FILTER (event_id % 2 = 0) AS a, count(DISTINCT user_id) AS b FROM events)")
def snapshot_list(spark, sf_dir):
    return _keyed(spark, "list", _writes(spark, sf_dir)).snapshots().drop("commit_time")


@query("SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') GROUP BY 1")
def keyed_lookup(spark, sf_dir):
    """All users who have signed up, looked up by key."""
    keys = events(spark, sf_dir, "signup").select("user_id")
    return _keyed(spark, "lookup", _writes(spark, sf_dir)).lookup(keys)


@query("SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events WHERE user_id IN (SELECT o_custkey FROM orders) GROUP BY 1")
def keyed_lookup_accounts(spark, sf_dir):
    """All accounts with orders looked up by key; the first batch's snapshot is overlaid by the second."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    return _keyed(spark, "accounts", _writes(spark, sf_dir)).lookup(keys)


@query("SELECT event_id, user_id, date_trunc('millisecond', ts) AS trade_time, value FROM events WHERE event_type = 'purchase'")
def stream_to_keyed_table(spark, sf_dir):
    """Stream ingest into a keyed table, epoch milliseconds turned to timestamps."""
    stream = event_stream(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", F.unix_millis("ts").alias("ms"), "value")
    plan = stream.select("event_id", "user_id", X.from_millis(F.col("ms")).alias("trade_time"), "value", F.col("ms").alias("seq"))
    lake = keyed.KeyedTable(spark, run.scratch(spark, "lake"), plan.schema, ["event_id"], buckets=4)
    run.run_batches(plan, lambda batch, i: lake.merge(batch, i), "lake")
    return ntz(lake.read().drop("seq"), "trade_time")


# tiers


def _tiers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    log = tier.tiered(events(spark, sf_dir).select("event_id", "user_id", "value"), (F.col("user_id") % 4).cast("int"), ["event_id"])
    return log.filter("__offset >= 50"), log.filter("__offset < 120")


@query("SELECT event_id, user_id, value FROM events")
def tier_union(spark, sf_dir):
    """Hot rows from offset 50 on and cold ones up to 119 overlap; each row is read once."""
    hot, cold = _tiers(spark, sf_dir)
    return tier.unified_log(hot, cold).select("event_id", "user_id", "value")


@query("SELECT CAST(user_id % 4 AS INT) AS __bucket, count(*) AS n, CAST(0 AS BIGINT) AS min_offset, count(*) - 1 AS max_offset FROM events GROUP BY 1")
def tier_buckets(spark, sf_dir):
    log = tier.tiered(events(spark, sf_dir).select("event_id", "user_id"), (F.col("user_id") % 4).cast("int"), ["event_id"])
    return tier.bucket_report(log)


@query("SELECT CAST(user_id % 4 AS INT) AS __bucket, count(*) AS n, CAST(0 AS BIGINT) AS min_offset, count(*) - 1 AS max_offset, min(c) AS min_timestamp, max(c) AS max_timestamp FROM (SELECT *, CASE WHEN event_id <= (SELECT max(event_id) // 2 FROM events) THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS c FROM events) GROUP BY 1")
def tier_copy_job(spark, sf_dir):
    """Two runs of the tiering job: the first when half of the events are there, the second copies only what has come since."""
    rows, cold = events(spark, sf_dir).select("event_id", "user_id", "value"), run.scratch(spark, "cold")
    half = rows.agg(F.expr("max(event_id) div 2")).first()[0]
    for day, hot in ((1, rows.filter(F.col("event_id") <= half)), (2, rows)):
        tier.copy_fresh(hot, cold, (F.col("user_id") % 4).cast("int"), ["event_id"], "event_id", F.lit(f"2024-01-0{day}").cast("timestamp"))
    return ntz(tier.bucket_report(spark.read.parquet(cold)), "min_timestamp", "max_timestamp")


@query(f"SELECT CAST(user_id % 4 AS INT) AS __bucket, count(*) AS n, CAST(0 AS BIGINT) AS min_offset, count(*) - 1 AS max_offset, count(DISTINCT event_id) AS events, count(DISTINCT part) AS runs FROM ({_PARTS}) GROUP BY 1")
def tier_stream_copy(spark, sf_dir):
    """Tiering as a stream, run four times; a tenth of the events reaches the hot log late. Offsets are dense."""
    cold, runs = run.scratch(spark, "tiering"), []

    def once(stream: DataFrame) -> None:
        tier.tiering(stream, cold, F.col("user_id") % 4, ["event_id"], F.lit(f"2024-02-0{len(runs) + 1}").cast("timestamp"))
        runs.append(1)

    run.feed(in_parts(events(spark, sf_dir).select("event_id", "user_id", "ts"), F.col("event_id") % 10 == 3), "part", 4, "tiering-in", once)
    log = tier.cold_tier(spark, cold).groupBy("__bucket")
    return log.agg(F.count(F.lit(1)).alias("n"), F.min("__offset").alias("min_offset"), F.max("__offset").alias("max_offset"), F.countDistinct("event_id").alias("events"), F.countDistinct("__timestamp").alias("runs"))


@query("SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1")
def tier_keyed(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "value")
    return tier.unified_keyed(rows.filter("event_id % 3 > 0"), rows.filter("event_id % 3 < 2"), ["user_id"], "event_id")
