import duckdb
import pytest
from pyspark.sql import functions as F
from test_pii import plain
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from accountlens.llm import packing


def brute_force(rows, items):
    """doc_id to text after all stages but the last."""
    rows = {doc: text for doc, text in rows.items() if any(x.isalpha() for x in text or "")}
    ids = sorted(rows)
    root = plain_components([plain_fingerprint(rows[doc]) for doc in ids], 4)
    rows = {doc: rows[doc] for i, doc in enumerate(ids) if root[i] == i}
    rows = {doc: text for doc, text in rows.items() if not any(item in text for item in items)}
    out = {}
    for doc, text in rows.items():
        at, pieces = 0, []
        for start, end, kind in sorted((int(a), int(b), kind) for kind, a, b in (span.split(":") for span in plain(text))):
            if start >= at:
                pieces += [text[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        out[doc] = "".join(pieces) + text[at:]
    return out


def test_run_against_brute_force(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    items = [text for (text,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    want = brute_force(texts, items)
    assert {row.doc_id: row.text for row in docs.collect()} == want
    rows = corpus_pipeline.run(spark, sf_dir)
    cut = packing.pieces(spark.createDataFrame(list(want.items()), "doc_id long, text string"))
    assert sorted(rows.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(cut.select("doc_id", "piece", "start", "length", F.crc32("ids")).collect())


@pytest.mark.parametrize("stage", [function for _, function in corpus_pipeline.STAGES], ids=[name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows(stage, spark, sf_dir, odd, none):
    assert stage(spark, odd, sf_dir).count() > 0
    assert stage(spark, none, sf_dir).collect() == []
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert stage(spark, odd, sf_dir).columns == odd.columns


def test_stages():
    assert len(corpus_pipeline.STAGES) == 5
