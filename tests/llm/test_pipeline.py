"""The pipeline's stages, each against plain Python on what the one before kept."""

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_packing import check


def test_stages(spark, small, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs, seen = small, {}
    for name, stage in stages.items():
        path = str(tmp_path / name)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        seen[name] = spark.read.parquet(path)
        assert name == "packing" or seen[name].columns == small.columns
        docs = seen[name]

    def texts(df):
        return {r.doc_id: r.text for r in df.collect()}

    first, good = texts(small), texts(seen["quality rules"])
    base = {i for i, t in first.items() if (m := plain.measures(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert set(good) == base  # no source here is condemned
    lines = texts(seen["line dedup"])
    assert lines == {i: kept for i, _, _, kept in plain.kept_lines(list(good.items()))}
    groups = plain.link_groups(list(lines.items()), 5)
    alone = texts(seen["near dedup"])
    assert alone == {i: t for i, t in lines.items() if groups[i][1] == i}
    clean = texts(seen["pii"])
    assert set(clean) == set(alone) and not any(plain.base_spans(t) for t in clean.values())
    assert sum(clean[i] != alone[i] for i in clean) < len(clean) / 2
    rows = seen["packing"].collect()
    assert check(rows, list(clean.items())) <= 1.05 * sum(r.length for r in rows) / 2048 + 2


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
