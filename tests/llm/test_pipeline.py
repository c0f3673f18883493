"""The stages one after the other on a small table, and that nothing else needs this package."""

from __future__ import annotations

import re
from pathlib import Path

import corpus_pipeline


def test_stages_keep_columns_and_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, data)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns and 0.5 * before < docs.count() <= before, name
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert len(rows) == docs.count() and all(r.lossless for r in rows)


def test_only_the_entry_imports_the_package():
    root = Path(corpus_pipeline.__file__).resolve().parent
    for path in (root / "passagemill").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"passagemill\.llm|corpus_pipeline", path.read_text()), path
