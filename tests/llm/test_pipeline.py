"""The stages one after another, each held against its rule."""

import corpus_pipeline
from pyspark.sql import functions as F

from foliospark.llm import near_duplicates, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, kept = docs.columns, docs
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        kept = near_duplicates.table(kept, "stage")
        frames.append(kept)
    good, single, clean, mixed, packed = frames
    assert all(f.columns == columns for f in frames[:-1])
    scores = quality.quality_scores(docs, labels)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    marked = near_duplicates.near_duplicates(good, k=5)
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in marked.where("kept").collect()}
    assert clean.count() == single.count() and secrets.secret_findings(clean).where("n_assign + n_access + n_hex > 0").count() == 0
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def rows(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long, _row string, blob string")


ODD = [
    (1, "plain words about a quiet town and its river " * 6, "en", "a", 1, "x", "y"),
    (1, "other words under the same number, of a market and a bridge " * 5, "en", "a", 1, None, None),
    (1, "plain words about a quiet town and its river " * 6, "en", "a", 1, "x", "y"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "b", 0, "", ""),
    (None, "a document without a number, long enough to be kept by any rule here " * 4, "en", "b", 9, "x", "y"),
    (None, "another one without a number, about ships and harbours in the north " * 4, "en", None, 9, "x", "y"),
    (4, 'settings of a server with password: "hunter2222" in one of its lines ' * 3, "en", "b", 9, "x", "y"),
    (5, "very long " * 20000, "en", "b", 9, "x", "y"),
]


def test_stages_on_odd_rows(spark):
    docs = rows(spark, ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        kept = [tuple(r) for r in got.collect()]
        if name == "minhash near-dedup":
            # Of the rows that share number 1 the one with the least text stays; those without a number all stay.
            assert sorted((r[0] or 0, (r[1] or "")[:5]) for r in kept) == [
                (0, "a doc"), (0, "anoth"), (1, "other"), (2, ""), (3, ""), (4, "setti"), (5, "very ")
            ]
        elif name == "secret scans":
            assert len(kept) == len(ODD) and sum("hunter" in (r[1] or "") for r in kept) == 0
            assert [r[4] for r in kept if r[0] == 2] == [None] and all(r[5:] == ("x", "y") for r in kept if r[0] == 4)
        elif name == "mixing sources":
            assert {tuple(r[:4]) for r in kept} <= {tuple(r[:4]) for r in ODD} and any(r[0] is None for r in kept)
    packing = corpus_pipeline.STAGES[-1][1]
    packed = packing(spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(ODD) and packing(spark, docs.limit(0), SF).count() == 0
