"""The pipeline's stages on the smallest tables: columns, decisions, and agreement with the operators."""

import os

import pytest

from tessera.llm import decontaminate, near_dedup, pipeline, quality_rules
from tessera.llm.common import DOCUMENT, documents, saved

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_in_order(spark):
    docs = documents(spark, DATA)
    before = docs.count()
    for name, stage in pipeline.STAGES:
        found = saved(stage(spark, docs, DATA), name)
        if name == "sharding":
            assert found.columns[:5] == DOCUMENT and "shard" in found.columns
            assert sorted(r.text for r in found.select("text").collect()) == sorted(r.text for r in docs.select("text").collect())
            return
        assert found.columns == DOCUMENT
        rows = found.count()
        if name == "quality":
            kept = quality_rules.quality_rules(docs, DOCUMENT).where("__kept")
            assert rows == kept.count() < before
        if name == "near_dedup":
            classes = near_dedup.near_dedup(docs)
            assert rows == classes.select("class_id").distinct().count()
        if name == "decontamination":
            marked = decontaminate.decontaminate(docs, spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert rows == marked.where("NOT contaminated").count()
        docs = found
    raise AssertionError("no sharding stage")


def test_stages_on_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None, None, None), (None, text, "en", None), (None, text, "en", None), (3, "", "en", "a"), (4, text + " one", None, "a"), (5, "x " * 20_000, "en", "a"), (6, " ".join(f"v{i}" for i in range(90)), "de", None)]
    for some in (rows, []):
        docs = spark.createDataFrame([(i, t, a, b, len(t or "")) for i, t, a, b in some], "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in pipeline.STAGES:
            docs = saved(stage(spark, docs, DATA), name)
            if not some:
                assert docs.count() == 0
            elif name == "near_dedup":
                assert sorted(r.doc_id or 0 for r in docs.collect()) == [4, 6]
