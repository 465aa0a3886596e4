"""Queries of the corpus operators, with production parameters, over their whole tables; and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, language_id, quality, toxicity
from tidemark.llm.collocations import collocations
from tidemark.llm.common import held_out, table
from tidemark.llm.decontamination import build_index, contaminated
from tidemark.llm.exact_dedup import exact_groups
from tidemark.llm.license_scan import scan_documents
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.sentencepiece_codec import digest_documents
from tidemark.llm.simhash import simhash_components
from tidemark.llm.structure_repair import repair


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents")).drop("spans")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_control_case(table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_conversations(turns))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and the test item found in it."""
    return contaminated(table(spark, sf_dir, "documents"), build_index(table(spark, sf_dir, "benchmark")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=5, percent=80)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs, modulus=4, remainder=2))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"), damage=True)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), n=4, bits=4)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), threshold=100, longest=5, percent=100, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_quality_classifier, op3_exact_dedup, op4_license_scan, op5_chat_format, op6_benchmark_decontamination)
    found += (op7_ngram_jaccard_join, op8_line_dedup, op9_language_id, op10_sentencepiece, op11_structure_repair, op12_simhash, op13_collocations)
    return {f.__name__: f for f in found}


def _audit_step() -> str:
    """SQL for op11: what one row makes of the best edits b (by state, cost and audit in one text each). First insertions, then
    the row's own edit."""
    grown = "printf('%08d', CAST(left(b[{0}], 8) AS INT) + {1}) || substr(b[{0}], 9) || '{2}'"
    follow = {1: 3, 2: 3, 3: 4, 4: 3}
    to: dict[int, list[str]] = {k: [] for k in follow}
    for start in follow:
        state, had = start, ""
        for _ in range(3):
            cost = 2 * len(had)
            to[state].append(grown.format(start, cost + 3, had + "D"))
            roles = {"s": 2} if state == 1 else {}
            roles |= {"a": 4} if state == 3 else {"u": 3}
            for role, end in roles.items():
                to[end].append(f"CASE WHEN fault NOT IN ('b', 'd') AND i = '{role}' THEN {grown.format(start, f'{cost} + bad', had + 'K')} END")
            to[follow[state]].append(f"CASE WHEN fault NOT IN ('b', 'd') THEN {grown.format(start, f'{cost + 2} + bad', had + 'R')} END")
            state, had = follow[state], had + "I"
    return "[" + ", ".join(f"least({', '.join(to[k])})" for k in (1, 2, 3, 4)) + "]"


_REPAIR = r"""
            WITH RECURSIVE bits AS (SELECT b, 0 AS k, CAST(b AS BIGINT) AS x FROM range(256) r(b) UNION ALL SELECT b, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8),
                 crc AS MATERIALIZED (SELECT list(x ORDER BY b) AS t FROM bits WHERE k = 8),
                 c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
                 k AS (SELECT c.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS kind FROM c, crc),
                 d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
                       FROM k, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
                 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_replace(text, '[ 	-]+\z', '') AS seen FROM d),
                 f AS MATERIALIZED (SELECT *, left(role, 1) AS i, CASE WHEN seen = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
                       lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM o),
                 s AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, ['00000000', NULL, NULL, NULL] AS b FROM (SELECT DISTINCT conv_id FROM f)
                       UNION ALL SELECT s.conv_id, s.pos + 1, {step} FROM s JOIN (SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS bad FROM f) f ON f.conv_id = s.conv_id AND f.pos = s.pos + 1),
                 e AS (SELECT conv_id, pos AS rows, least(b[1], b[4], printf('%08d', CAST(left(b[3], 8) AS INT) + 2) || substr(b[3], 9) || 'I', printf('%08d', CAST(left(b[2], 8) AS INT) + 4) || substr(b[2], 9) || 'II') AS best
                       FROM s WHERE pos = (SELECT max(pos) FROM f WHERE f.conv_id = s.conv_id)),
                 m AS (SELECT conv_id, CAST(left(best, 8) AS BIGINT) AS cost, substr(best, 9) AS audit FROM e),
                 x AS (SELECT conv_id, p, substr(audit, p, 1) AS edit, CAST(length(replace(left(audit, p), 'I', '')) AS BIGINT) AS pos FROM m, range(1, length(audit) + 1) r(p)),
                 y AS (SELECT x.*, f.role, f.text, row_number() OVER (PARTITION BY x.conv_id ORDER BY p) AS q FROM x LEFT JOIN f ON f.conv_id = x.conv_id AND f.pos = x.pos AND edit <> 'I' WHERE edit <> 'D'),
                 h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - lead_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS digest
                       FROM (SELECT *, max(CASE WHEN q = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead_s FROM y) GROUP BY conv_id),
                 g AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                       count(*) FILTER (prev IS NOT NULL AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
            SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
                   coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
            FROM (SELECT DISTINCT conv_id FROM conversations) n LEFT JOIN g USING (conv_id) LEFT JOIN m USING (conv_id) LEFT JOIN h USING (conv_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_structure_repair": _REPAIR.replace("{step}", _audit_step()),
        "op13_collocations": r"""
            WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
                 w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
                 g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(ws) >= k),
                 n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
                 f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY ALL HAVING count(*) >= 100),
                 x AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM f, range(2, 5) r(s), range(1, 5) q(i) WHERE s < k AND i + s - 1 <= k GROUP BY ALL),
                 c AS (SELECT f.*, n.n FROM f JOIN n USING (lang) LEFT JOIN x USING (lang, phrase) WHERE k > 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
                 u AS (SELECT c.lang, c.phrase, c.a, c.n, j, l.a AS l, r.a AS r, CAST((CAST(1000 AS HUGEINT) * c.a * c.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
                       FROM c, range(1, 5) q(j), f l, f r WHERE j < c.k AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j], ' ') AND r.phrase = array_to_string(c.ws[j + 1:], ' ')),
                 b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM u),
                 t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE o = 1)
            SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000""",
        "op3_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
                 g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
            SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
            FROM d JOIN g USING (text_sha256)""",
        "op5_chat_format": r"""
            WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
                 e AS (SELECT *, length(regexp_replace(role || chr(0) || text, '([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')) - 1 AS escaped FROM t)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(escaped + 20) AS BIGINT) AS formatted_chars
            FROM e GROUP BY conv_id""",
        "op7_ngram_jaccard_join": r"""
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
                 g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
                 n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM g),
                 s AS MATERIALIZED (SELECT doc_id, hash(unnest(sh)) AS h FROM g),
                 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
                 l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n_shingles + y.n_shingles - k)),
                 r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
            SELECT doc_id, n_shingles, (SELECT min(c) FROM r WHERE r.id = doc_id) AS component_id FROM n""",
        "op8_line_dedup": r"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
                 o AS MATERIALIZED (SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS line FROM t),
                 d AS MATERIALIZED (SELECT line, min((doc_id, k)) AS first FROM o WHERE length(trim(line, ' ')) > 0 GROUP BY line),
                 e AS MATERIALIZED (SELECT DISTINCT line, first, unnest([(1, n, left(line, n // 2)), (2, n, right(line, n - n // 2)), (1, n - 1, left(line, (n - 1) // 2)), (2, n - 1, right(line, n - 1 - (n - 1) // 2))]) AS key FROM (SELECT *, length(line) AS n FROM d)),
                 c AS (SELECT DISTINCT a.line AS x, b.line AS y FROM e a JOIN e b ON a.key = b.key AND a.first > b.first AND abs(length(a.line) - length(b.line)) <= 1),
                 f AS (SELECT DISTINCT x FROM c WHERE
                       CASE WHEN length(x) = length(y) THEN len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) = 1
                            WHEN length(x) > length(y) THEN list_contains(list_transform(range(0, length(x)), lambda i: left(x, i) || substr(x, i + 2)), y)
                            ELSE list_contains(list_transform(range(0, length(y)), lambda i: left(y, i) || substr(y, i + 2)), x) END),
                 s AS (SELECT o.doc_id, o.k, o.line FROM o LEFT JOIN d ON o.line = d.line LEFT JOIN f ON o.line = f.x WHERE d.line IS NULL OR d.first = (o.doc_id, o.k) AND f.x IS NULL),
                 m AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS kept FROM s GROUP BY doc_id)
            SELECT t.doc_id, CAST(CASE WHEN t.text = '' THEN 0 ELSE len(t.ls) END AS BIGINT) AS n_lines, CAST(CASE WHEN t.text = '' THEN 0 ELSE coalesce(m.n, 0) END AS BIGINT) AS n_kept, sha256(coalesce(m.kept, '')) AS kept_sha256
            FROM t LEFT JOIN m USING (doc_id)""",
    }
