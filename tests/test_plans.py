"""The plans that the queries should have."""

import contextlib
import io
import re

import pytest

from tallyforge.operators import search
from tallyforge.plans import registry

NO_PYTHON = ["agency_spend", "fund_rollup", "payee_profiles", "flag_offsetting", "canonical_payees", "canonical_agencies", "agency_contractors", "running_total", "latest_delivery", "graph_edges", "name_keys", "bm25_plain"]


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_hot_paths_stay_in_the_jvm(spark, small, name):
    text = plan(registry.queries()[name](spark, small))
    assert "Python" not in text and "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(registry.queries()["just_under_screen"](spark, small))
    assert "GreaterThanOrEqual(extended_amount,4000.0)" in text
    (schema,) = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert {c.split(":")[0] for c in schema.split(",")} == {"extended_amount", "agency_canonical", "payee_canonical"}


def test_sums_combine_before_the_one_shuffle(spark, small):
    df = registry.queries()["agency_spend"](spark, small)
    text = df._jdf.queryExecution().sparkPlan().toString()
    assert text.count("HashAggregate") == 2 and "partial_sum" in text


def test_top_listings_do_not_sort_everything(spark, small):
    assert "TakeOrderedAndProject" in plan(registry.queries()["top_agencies"](spark, small))


def test_retrieval(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Resolution on storm drains and drainage", "R-001-20"), (2, "Ordinance on police overtime", "O-002-20"), (3, None, "M-003-20"), (4, "", "M-004-20")], "doc_id long, text string, file_no string")
    ix = search.Index(docs)
    assert [r["doc_id"] for r in ix.search("drain draining").collect()] == [1]
    assert ix.search("library").count() == 0 and ix.search("the of").count() == 0
    assert ix.search("police", min_score=99).count() == 0
    folder = search.swap_corpus(docs, str(tmp_path / "corpus"))
    search.swap_corpus(docs.limit(1), folder)
    assert spark.read.parquet(folder).count() == 1


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("formalize", "formal"), ("goodness", "good"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky")])
def test_stems(word, stem):
    assert search.porter(word) == stem


def test_citations():
    hits = [{"doc_id": 1, "file_no": "O-002-20"}, {"doc_id": 2, "file_no": "12345"}, {"doc_id": 3, "file_no": "R-9"}]
    assert [h["doc_id"] for h in search.cited(hits, "As O–002–20 and 12345 say; not R-99.")] == [1]
    assert search.context([{"doc_id": 7, "text": "x" * 900}]).count("x") == 600
