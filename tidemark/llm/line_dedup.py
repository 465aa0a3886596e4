"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier line (by doc_id, then line number) equals it or is one character away: one inserted, deleted
or replaced. Equal lines collapse first. Two lines one edit apart agree in their first or second half, so only lines that
share a half with another line stand for the join ("live" lines); this gate loses nothing. A live line emits all its
variants with one character deleted as hashed keys. Lines with an equal variant from the same place differ by one
replaced character; a line that equals a variant lacks one character of the variant's line. Each line takes the earliest
line that it meets so; that both texts are equal but for the character at that place is verified, and the earlier one stays.

Variants of a long line are hashed in chunks of which only one differs, and a line's chunks travel as rows of their own,
so the work grows with the line's length times a chunk, whatever the length. Lists of equal variants are bounded by the alphabet and the line's length, because lines in them are distinct.

Defined cases: blank lines always stay and are never compared; null and empty texts have no lines; rows that repeat with
the same id and text count as one document; null ids are one id, before all others; lines at one place (of rows of one id
with other texts) are neither earlier; an empty table gives an empty result; the other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

CHUNK = 64
#: Up to so many live lines are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_LINES = 100_000


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter("length(trim(line)) > 0")


def _ids(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _halves() -> Column:
    """Keys of the halves that lines one edit away share: for partners of the own length or more, and of one less."""
    part = lambda size: (
        f"xxhash64('first', {size}, left(line, ({size}) div 2)), xxhash64('second', {size}, right(line, ({size}) - ({size}) div 2))"
    )
    return F.expr(f"array({part('length(line)')}, {part('length(line) - 1')})")


def _chunks(live: DataFrame) -> DataFrame:
    """h, h2, first, n, c, w: a line's chunks and the character behind each, cut in one pass over the line."""
    parts = F.expr(f"regexp_extract_all(line, '(?s).{{1,{CHUNK}}}', 0)")
    cut = live.select("h", "h2", "first", F.length("line").alias("n"), parts.alias("parts"))
    return cut.select("h", "h2", "first", "n", F.posexplode(F.expr("transform(parts, (x, i) -> concat(x, left(coalesce(get(parts, i + 1), ''), 1)))")).alias("c", "w"))


def _variants(live: DataFrame) -> DataFrame:
    """vh, vn, place (0: the line itself), h, h2, first. A variant's hash is that of the chunks before the place, of the
    chunk without the character, and of the chunks behind it, each a character further; the sums over the others are
    running ones, so a row carries one chunk of its line."""
    s = CHUNK
    hashed = _chunks(live).withColumns({"a": F.expr(f"xxhash64(c, left(w, {s}))"), "b": F.expr(f"if(length(w) > 1, xxhash64(c, substring(w, 2, {s})), 0L)")})
    summed = hashed.withColumns({
        "all": F.expr("bit_xor(a) over (partition by h, h2)"),
        "rest": F.expr("a ^ bit_xor(a) over (partition by h, h2 order by c) ^ bit_xor(b) over (partition by h, h2) ^ bit_xor(b) over (partition by h, h2 order by c)"),
    })
    self_rows = summed.filter("c = 0").select(F.col("all").alias("vh"), F.col("n").alias("vn"), F.lit(0).alias("place"), "h", "h2", "first")
    place = summed.withColumn("j", F.expr(f"explode(sequence(1, least({s}, n - c * {s})))"))
    shorter = f"concat(left(w, j - 1), substring(w, j + 1, {s}))"
    own = place.select(F.expr(f"rest ^ if({shorter} = '', 0L, xxhash64(c, {shorter}))").alias("vh"), (F.col("n") - 1).alias("vn"), (F.col("c") * s + F.col("j")).alias("place"), "h", "h2", "first")
    return self_rows.unionByName(own)


def near_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (h, h2, first: place of the earliest equal line), and of them those that go (h, h2, kept: the place of an earlier line one edit away)."""
    keyed = _ids(_lines(docs)).select("h", "h2", "doc_id", "line_no", _halves().alias("keys"))
    distinct = checkpoint(keyed.groupBy("h", "h2", *(F.col("keys")[i].alias(f"k{i}") for i in range(4))).agg(F.min(F.struct("doc_id", "line_no")).alias("first")))
    halves = distinct.select("h", "h2", "first", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    shared = halves.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("k")
    live = checkpoint(halves.join(shared, "k", "left_semi").select("h", "h2", "first").distinct())
    some = live.select(F.col("h").alias("__h"), F.col("h2").alias("__h2"), "first")
    if live.count() <= BROADCAST_LINES:
        some = F.broadcast(some)
    place = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    texts = checkpoint(_ids(_lines(docs)).join(some, place & (F.col("h") == F.col("__h")) & (F.col("h2") == F.col("__h2"))).select("h", "h2", "first", "line").dropDuplicates(["h", "h2"]))

    rows = _variants(texts).withColumn("self", F.struct("first", "place"))
    met = rows.withColumns({
        "replaced": F.expr("if(place = 0, null, named_struct('kept', min(first) over (partition by vh, vn, place), 'place', place, 'kind', 1))"),
        "longer": F.expr("if(place = 0, min(if(place = 0, null, self)) over (partition by vh, vn), null)"),
        "shorter": F.expr("if(place = 0, null, named_struct('kept', min(if(place = 0, first, null)) over (partition by vh, vn), 'place', place, 'kind', 3))"),
    }).withColumns({"longer": F.expr("if(longer is null, null, named_struct('kept', longer.first, 'place', longer.place, 'kind', 2))"), "shorter": F.expr("if(shorter.kept is null, null, shorter)")})
    earliest = met.select("h", "h2", "first", F.least("replaced", "longer", "shorter").alias("m")).filter("m.kept < first").groupBy("h", "h2").agg(F.min("m").alias("m"))
    pairs = earliest.select("h", "h2", "m.*").join(texts.select("h", "h2", "line"), ["h", "h2"]).join(texts.select(F.col("first").alias("kept"), F.col("line").alias("other")), "kept")
    without = lambda c: f"concat(left({c}, place - 1), substring({c}, place + 1))"
    one_edit = F.expr(f"case kind when 1 then {without('line')} = {without('other')} when 2 then line = {without('other')} else {without('line')} = other end")
    gone = pairs.filter(one_edit).select("h", "h2", "kept").distinct()
    return distinct.select("h", "h2", "first"), checkpoint(gone)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_kept, kept_text of every row: the lines that stay, in order, blank ones included."""
    distinct, gone = near_lines(docs)
    stay = distinct.join(gone, ["h", "h2"], "left_anti")
    # The staying lines' hashes by position, so that a document finds each of its lines at once. Positions that rows of one
    # id with different texts share are looked up in the set.
    places = F.sort_array(F.collect_set(F.struct(F.col("first.line_no").alias("line_no"), "h"))).alias("__stay")
    by_doc = stay.groupBy(F.col("first.doc_id").alias("__id")).agg(places)
    by_doc = by_doc.withColumn("__shared", F.expr("size(array_distinct(__stay.line_no)) < size(__stay)"))
    gap = "x.line_no - if(j = 0, -1, get(__stay, j - 1).line_no) - 1"
    by_doc = by_doc.withColumn("__at", F.expr(f"if(__shared, array(), flatten(transform(__stay, (x, j) -> concat(array_repeat(cast(null as bigint), {gap}), array(x.h)))))"))
    by_doc = by_doc.withColumn("__stay", F.expr("if(__shared, __stay, null)"))
    joined = docs.select("doc_id", "text").join(by_doc, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.filter(lines, lambda x, i: (F.length(F.trim(x)) == 0) | F.coalesce(F.when(F.col("__shared"), F.array_contains(F.col("__stay"), F.struct(i.alias("line_no"), F.xxhash64(x).alias("h")))).otherwise(F.get(F.col("__at"), i) == F.xxhash64(x)), F.lit(False)))
    out = joined.withColumn("__kept", kept).withColumn("__lines", lines)
    size = lambda c: F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(c)).cast("bigint")
    return out.select("doc_id", "text", size("__lines").alias("n_lines"), size("__kept").alias("n_kept"), F.concat_ws("\n", "__kept").alias("kept_text"))
