"""Pipeline stages and filters on empty tables, null and repeated ids, and columns with clashing names."""

import corpus_pipeline as P
import pytest

from voxloom.llm import language_id, minmax, pseudonyms, toxicity

SF = "/root/testdata/sf0.001"
EXTRA = "kept boolean, component_id long, score double, predicted int, held_out boolean, feature string, label int, fold int, key long, salt int, hash long, bucket int, kinds string, pseudonyms string"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with null and repeated ids, null, empty and long texts, and the operators' own names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    blank = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in (c.split() for c in EXTRA.split(", ")))
    more = spark.createDataFrame([(None, "the of and in that is was", "en", "s", 5), (None, None, None, None, None), (3, "the of and another text in this", "en", "s", 5), (3, "the of and another text in this", "en", "s", 5), (9001, "", None, "s", 0), (9002, "the and of " * 30_000, "en", "s", 9)], docs.schema)
    return docs.unionByName(more).selectExpr("*", *blank.split(", ")).cache()


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stage_keeps_columns(spark, odd, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, odd, SF)
    n = out.count()
    assert 0 < n
    if name != "packing":
        assert out.columns == odd.columns and n <= odd.count()
        assert out.dtypes == odd.dtypes
    empty = stage(spark, odd.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns


def test_stages_keep_rows_without_an_id(spark, odd):
    kept = P.drop_near_duplicates(spark, odd, SF)
    assert kept.filter("doc_id IS NULL").count() == 2 and kept.filter("doc_id = 3").count() == odd.filter("doc_id = 3").count()
    assert P.hide_private(spark, odd, SF).count() == odd.count()


def test_filters_state_their_cases(spark, odd):
    profiles = language_id.train(odd)
    stay = language_id.keep_identified(odd, profiles)
    assert stay.filter("text IS NULL OR text = ''").isEmpty() and stay.filter("doc_id = 9002").count() == 1
    grammar = toxicity.Grammar({"another": 9.0}, {})
    clean = toxicity.keep_clean(odd, grammar)
    assert clean.filter("doc_id = 3 AND text LIKE '%another%'").isEmpty() and clean.filter("text IS NULL OR text = ''").count() == 2
    found = minmax.near_duplicates(odd)
    assert found.count() == odd.count() and found.filter("doc_id IS NULL AND component_id IS NOT NULL").isEmpty()
    hidden = pseudonyms.pseudonymize(odd, "k", kinds_col="kinds")
    assert hidden.columns == odd.columns and hidden.select("pseudonyms").filter("pseudonyms IS NOT NULL").isEmpty()
