"""How many files the tables of a bounded sample have."""

import pytest

from tidemark.llm import common, language, toxicity


@pytest.mark.parametrize("module", [toxicity, language])
def test_sample_tables_are_few_files(spark, monkeypatch, module):
    """However many partitions the session's shuffles have; each file of a local store forks a process, too."""
    files = {}

    def written(df, what):
        out = common.written(df, what)
        files[what] = len(out.inputFiles())
        return out

    monkeypatch.setattr(module, "written", written)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, f"vile{i % 7} grumpf rotter wort{i} wort{i + 1} hund{i % 90} katze{i % 80} maus{i % 70}", i % 2, "de" if i % 3 else "en") for i in range(600)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string").repartition(3)
        module.learn(docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files
    assert max(files.values()) <= common.SAMPLE_PARTS, files
