"""The pipeline against a brute-force version of its stages."""

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components, documents, odd
from tidemark.llm import language_id
from tidemark.llm.queries import tokenizer_path


def test_pipeline(spark, sf_dir):
    docs = documents(spark, sf_dir)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    rows = [r for r in docs.collect() if pred[r.doc_id][0] != "und" and pred[r.doc_id][1] >= 0.35]
    last = {}
    for r in rows:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    rows = [r for r in rows if last[r.text] == r.doc_id]
    comp = brute_components(rows)
    rows = [r for r in rows if comp[r.doc_id][2] == r.doc_id]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(t in r.text for t in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    expected = {r.doc_id: (library.encode(r.text), library.decode(library.encode(r.text))) for r in rows}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: (list(r.ids), r.decoded) for r in found} == expected and len(found) == len(expected) < docs.count()


def test_stages_keep_columns(spark, sf_dir):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.names == docs.schema.names, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_pipeline_of_no_documents(spark, sf_dir, tmp_path):
    documents(spark, sf_dir).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() == 0


CLASHING = ["n", "stays", "h", "id", "__sha", "bucket", "row", "gone", "own", "key", "met", "keep", "sid", "slice", "a b.c"]


def test_stages_survive_any_column_name(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(60)
    docs = docs.unionByName(docs.filter("doc_id % 5 = 0").withColumn("doc_id", docs["doc_id"] + 100_000)).select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    docs = docs.unionByName(docs.filter("doc_id % 7 = 0"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = sorted(r.doc_id for r in stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), sf_dir).collect())
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema, name
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == plain, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING), name
