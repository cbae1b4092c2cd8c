"""The pipeline's stages one after the other, each against what it may do to its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from spendgrid.llm import pieces
from spendgrid.llm.shared import documents, stored


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = documents(spark, folder)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        docs = stored(stage(spark, docs, folder), f"test-{name}")
        rows = docs.collect()
        ids = {r.doc_id for r in rows}
        seen.append(name)
        assert ids <= set(before) and rows
        if name != "encode":
            assert docs.columns == columns
        if name == "exact":
            plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
            best = {}
            for i, t in before.items():
                best[plain(t)] = min(best.get(plain(t), (1, 0)), (-len(t), i))
            assert sorted(r.doc_id for r in rows) == sorted(i for _, i in best.values())
        if name == "mix":
            assert ids == set(before)
        if name == "encode":
            coder = pieces.codec(pieces.read_model())
            assert all(coder.decode(r.ids) == before[r.doc_id] and r.round_trip for r in rows)
    assert seen == ["quality", "exact", "similar", "mix", "encode"] and len(ids) > 100


def test_stages_on_odd_rows(spark):
    folder = "/root/testdata/sf0.001"
    schema = documents(spark, folder).schema
    text = "one two three four five six seven eight"
    rows = [(None, text, "en", None, 3), (1, text, None, "a", None), (1, text, None, "a", None), (2, None, "en", "a", 0), (3, "", None, None, 0),
            (4, " \t", "en", "b", 2), (5, "word " * 60_000, "en", "b", 300_000)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema).withColumn("_id", F.lit("kept"))
        for name, stage in corpus_pipeline.STAGES:
            columns, docs = docs.columns, stored(stage(spark, docs, folder), f"odd-{name}")
            found = docs.collect()
            assert len(found) <= 8 and (given or not found)
            if name != "encode":
                assert docs.columns == columns and all(r["_id"] == "kept" for r in found)
            if name == "exact":
                assert len({(r.text or "").replace(" ", "").replace("\t", "") for r in found}) == len(found)
