import corpus_pipeline
from __spark_entry__ import queries

TABLES = "/root/testdata/sf0.001"


def test_stages_on_planted_documents(spark, docs_of, prose):
    shared = prose(80, 500)
    clean = [(i, prose(120, i)) for i in range(30)]
    rows = clean + [(40, clean[3][1]), (41, clean[4][1] + " end"), (42, prose(90, 42) + " " + shared), (43, shared + " " + prose(90, 43))]
    rows += [(50, "spam and eggs " * 50), (51, None), (52, ""), (53, prose(60, 9) + " &&&" * 60)]
    docs = docs_of(rows, odd=False)
    first = corpus_pipeline.quality_rules(spark, docs, TABLES)
    assert {r["doc_id"] for r in first.collect()} == {r[0] for r in rows} - {50, 51, 52, 53}
    second = corpus_pipeline.near_dedup(spark, first, TABLES)
    assert {r["doc_id"] for r in second.collect()} == set(range(30)) | {42, 43}
    third = corpus_pipeline.repeat_removal(spark, second, TABLES)
    texts = {r["doc_id"]: r["text"] for r in third.collect()}
    assert texts == dict(clean) | {42: texts[42], 43: texts[43]}
    assert shared[50:-50] not in texts[42] and prose(90, 42) in texts[42] and prose(90, 43) in texts[43]
    for stage in (first, second, third):
        assert stage.columns == corpus_pipeline.COLUMNS


def test_run_over_the_table(spark):
    out = queries()["pipeline"](spark, TABLES)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_ids"]
    assert out.count() > 50 and out.where("n_ids < 1").count() == 0


def test_every_stage_on_odd_rows_and_on_none(spark, docs_of, prose):
    rows = [(i, prose(60, i), ["en", "fr", None][i % 3]) for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \n\t"), (None, prose(50, 20)), (None, None), (None, prose(50, 20)), (3, prose(60, 3)), (3, prose(40, 21))]
    rows += [(23, prose(20000, 22)), (24, "one"), (-(2**63), prose(50, 23)), (2**63 - 1, prose(50, 24))]
    docs = docs_of(rows)  # with columns that operators use inside
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TABLES)
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert set(out.select("doc_id").distinct().toPandas()["doc_id"].dropna().astype(int)) <= {r[0] for r in rows if r[0] is not None}, name
        assert stage(spark, docs.limit(0), TABLES).count() == 0, name
    encoding = corpus_pipeline.STAGES[-1][1]
    encoded = encoding(spark, docs, TABLES).collect()
    assert len(encoded) == len(rows) and sorted(r["n_ids"] for r in encoded)[:3] == [0, 0, 0]
    assert encoding(spark, docs.limit(0), TABLES).count() == 0
    assert corpus_pipeline.mixing(spark, docs, TABLES).where("doc_id IS NULL").count() >= 1
