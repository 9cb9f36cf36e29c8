import pytest
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import derive
from tallyforge.operators.components import connected_components


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_canonicalize_exact_then_first_prefix_then_source(spark):
    df = spark.createDataFrame([(1, "ACME"), (2, "ACME #7"), (3, "acme x"), (4, None), (5, "Other_1"), (6, "Otherx1")], "i int, s string")
    exact = spark.createDataFrame([("ACME", "Acme Inc"), (None, "x")], "source string, canonical string")
    prefixes = [("ACME #", "Acme Stores"), ("ACME", "Acme"), ("Other_", "Other")]
    got = rows(derive.canonicalize(df, "s", "c", exact, prefixes).select("i", "c"))
    assert got == {(1, "Acme Inc"), (2, "Acme Stores"), (3, "acme x"), (4, None), (5, "Other"), (6, "Otherx1")}
    got = rows(derive.canonicalize(df, "s", "c", exact, prefixes, case_insensitive=True).select("i", "c"))
    assert (3, "Acme") in got


def test_many_prefixes_are_joined_with_the_same_result(spark, monkeypatch):
    df = spark.createDataFrame([("AB1",), ("A9",), ("Z",), (None,)], "s string")
    prefixes = [("AB", "first"), ("A", "second"), ("AB1", "third")]
    compiled = derive.canonicalize(df, "s", "c", None, prefixes)
    monkeypatch.setattr(derive, "MAX_COMPILED_PREFIXES", 1)
    assert rows(derive.canonicalize(df, "s", "c", None, prefixes).select("s", "c")) == rows(compiled.select("s", "c"))


def test_map_entries_of_equal_keys():
    pairs = [("a", "1"), ("A", "2"), ("a", "3")]
    assert derive.dedupe_map(pairs, False) == [("a", "3"), ("A", "2")]
    assert derive.dedupe_map(pairs, True) == [("A", "3")]


def test_offsetting_marks_whole_groups_and_never_null_keys(spark):
    df = spark.createDataFrame([(1, "k", 5.0), (2, "k", -5.0), (3, "k", None), (4, None, 1.0), (5, None, -1.0), (6, "z", 0.0)], "i int, k string, a double")
    assert rows(derive.flag_offsetting(df, ["k"], "a").where("is_offsetting").select("i")) == {(1,), (2,), (3,)}


def test_artifacts_are_large_amounts_taken_back(spark):
    df = spark.createDataFrame([(1, "k", 900.0), (2, "k", -800.0), (3, "z", 900.0), (4, "k", None)], "i int, k string, a double")
    assert rows(derive.flag_artifacts(df, ["k"], "a", 500.0).where("is_data_artifact").select("i")) == {(1,), (2,)}


@pytest.mark.parametrize("a,b", [("Gas & Light Company", "GAS AND LIGHT CO."), ("The Acme Co", "ACME"), ("A.B.C. Supply L.L.C.", "ABC SUPPLY LLC"), ("Fuel Stop #482", "Fuel Stop")])
def test_spellings_of_one_key(spark, a, b):
    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(C.name_key(F.col("a")), C.name_key(F.col("b"))).first()
    assert x == y != ""


def test_keys_that_differ_and_odd_names(spark):
    df = spark.createDataFrame([("HALL #2 WEST",), ("HALL #3 WEST",), ("CO",), ("The Company",), (None,), ("###",)], "s string")
    assert [r[0] for r in df.select(C.name_key(F.col("s"))).collect()] == ["HALL 2 WEST", "HALL 3 WEST", "CO", "COMPANY", "", ""]


def test_coercions(spark):
    df = spark.createDataFrame([("12",), (" 7.0",), ("x",), ("1.5",), (None,)], "s string")
    assert [r[0] for r in df.select(C.coerce_int(F.col("s"))).collect()] == [12, 7, None, None, None]
    ms = spark.createDataFrame([("0",), ("1583020800000",), ("bad",)], "s string").select(C.epoch_ms_date(F.col("s")))
    assert [r[0] for r in ms.collect()] == ["1970-01-01", "2020-03-01", None]
    assert C.like_escape("A_B 50% a\\b") == "A\\_B 50\\% a\\\\b"


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("q", "q"), (None, "a"), ("b", "a")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)], "a string, b string")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got["c"] == got["a"] == "a" and got["y"] == "x" and "q" not in got
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"}
    assert connected_components(e.where("false")).count() == 0
