"""The corpus pipeline, stage by stage, against what each stage must do."""

import corpus_pipeline as P
from voxloom.llm import minmax, queries

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(5001, "12 34 !!", "en", "x", 8), (5002, None, "en", "x", 0)], docs.schema)
    plain = spark.createDataFrame([(5003, "Mail me at some.body@mail.example.com or 42.144.35.254, the card is 4041894974608795.", "en", "x", 85)], docs.schema)
    copy = docs.filter("doc_id = 7").selectExpr("5004L AS doc_id", "concat(text, ' end')  AS text", "lang", "source", "n_chars")
    now = docs.unionByName(junk).unionByName(plain).unionByName(copy)
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, now, SF).write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, now)
        if k < len(P.STAGES) - 1:
            assert now.schema == docs.schema
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "near_dedup", "pii", "packing"]
    gone = ids(seen["language_id"][0]) - ids(seen["language_id"][1])
    assert {5001, 5002} <= gone and len(gone) <= 3
    before, after = seen["near_dedup"]
    groups = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(before).collect()}
    assert ids(after) == {i for i, c in groups.items() if i == c} and 5004 not in ids(after)
    text = {r["doc_id"]: r["text"] for r in seen["pii"][1].collect()}
    assert "some.body" not in text[5003] and "42.144" not in text[5003] and "4041894974608795" not in text[5003]
    assert ids(now) == ids(seen["pii"][1])


def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
