"""Whole-table queries against brute force, where SQL can't say the same."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import derive
from tallyforge.plans import registry

ODD = ["a\u00a0\u2003b", "\u3000x \u2028\ty\u0085", "z\u200b \u200bz", "\x1c\x1fq\x0b\x0cr", "Привет  \n мир", "\ufeff a", "", " \u00a0\n ", None, "<|endoftext|>  ok"]


def python_clean(text):
    return None if text is None or text != text else re.sub(r"\s+", " ", text).strip()


def test_white_space_of_every_script(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(C.clean_space(F.col("t"))).collect()] == [python_clean(t) for t in ODD]


def test_clean_texts_all_takes_every_document(spark, small):
    want = {r.doc_id: python_clean(r.text) for r in pd.read_parquet(f"{small}/documents.parquet", columns=["doc_id", "text"]).itertuples()}
    assert {r["doc_id"]: r["cleaned"] for r in registry.queries()["clean_texts_all"](spark, small).collect()} == want


def python_key(name):
    """Identity key, word by word."""
    s = re.sub(r"\s*#\s*\d*\s*$", "", name.upper().replace(".", "").replace("&", " AND "))
    words = re.sub(r"[^A-Z0-9]+", " ", s).split()
    words = words[1:] if len(words) > 1 and words[0] == "THE" else words
    while len(words) > 1 and words[-1] in C.SUFFIXES:
        words.pop()
    return " ".join(words)


PAYEES = ["Acme\u00a0Drains Inc", "ACME DRAINS", "Acme Drains\u2003#\u00a012", "Müller & Söhne GmbH\u00a0#7", "Hooliföm & Kedoyan, Inc.", "The\u00a0Straße Co", "Привет", "Yesil #\u0663", "\u00a0"]


def test_keys_of_names_beyond_ascii(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(PAYEES)], "k int, p string")
    got = [r[0] for r in df.orderBy("k").select(C.name_key(F.col("p"))).collect()]
    assert got == [python_key(p) for p in PAYEES] and got[:3] == ["ACME DRAINS"] * 3


def test_name_queries_take_payees_beyond_ascii(spark, tmp_path):
    rows = [(p, 10.0 * (k + 1), False) for k, p in enumerate(PAYEES)] + [("Acme\u00a0Drains Inc", 0.5, False), (None, 7.0, False), ("Acme Drains", 900.0, True)]
    spark.createDataFrame(rows, "payee string, extended_amount double, is_data_artifact boolean").write.parquet(f"{tmp_path}/expenditures.parquet")
    keys = {r["payee"]: r["key"] for r in registry.queries()["name_keys_all"](spark, str(tmp_path)).collect()}
    assert keys == {p: python_key(p) for p, _, _ in rows if p is not None}
    want: dict = {}
    for p, w, wrong in rows:
        if p is not None and not wrong and python_key(p):
            total, members = want.get(python_key(p), (0.0, set()))
            want[python_key(p)] = (total + w, members | {p})
    got = {r["key"]: (r["weight"], r["members"]) for r in registry.queries()["name_clusters_all"](spark, str(tmp_path)).collect()}
    assert got == {k: (round(w, 2), len(m)) for k, (w, m) in want.items()} and got["ACME DRAINS"] == (60.5, 3)


def test_table_profile_all_has_every_column(spark, small):
    d = pd.read_parquet(f"{small}/expenditures.parquet")
    got = {r["column"]: r for r in registry.queries()["table_profile_all"](spark, small).collect()}
    assert sorted(got) == sorted(d.columns) and len(got) == 27
    for c in d.columns:
        x = d[c].dropna()
        assert (got[c]["n_rows"], got[c]["n_null"], got[c]["n_distinct"]) == (len(d), len(d) - len(x), x.nunique()), c
        low, high = got[c]["low"], got[c]["high"]
        if got[c]["type"] in ("int", "bigint", "double"):
            assert (float(low), float(high)) == (x.min(), x.max()), c
        elif got[c]["type"].startswith("timestamp"):
            assert (pd.Timestamp(low), pd.Timestamp(high)) == (x.min(), x.max()), c
        else:
            assert (low, high) == tuple(str(v).lower() if got[c]["type"] == "boolean" else v for v in (x.min(), x.max())), c


def test_p4_ranges_has_the_range_of_each_column_and_load(spark, small):
    want = {}
    for name, column in (("expenditures", "fund"), ("expenditures", "agency_canonical"), ("salary_data", "CalYear")):
        d = pd.read_parquet(f"{small}/{name}.parquet", columns=["load_id", column]).dropna(subset=["load_id"])
        for load, values in d.groupby("load_id")[column]:
            x = [v for v in values.dropna() if str(v).strip()]
            number = column == "CalYear"
            want[name, load, column] = (str(int(min(x))), str(int(max(x)))) if x and number else (min(x), max(x)) if x else (None, None)
    got = {(r["table_name"], r["load_id"], r["column_name"]): (r["low"], r["high"]) for r in registry.queries()["p4_ranges"](spark, small).collect()}
    assert got == want


def test_canonical_payees_takes_every_prefix(spark, tmp_path, monkeypatch):
    chains = [(f"Shop {k:03} ", f"Chain {k}") for k in range(300)] + [("SHOP 250 x", "later"), (None, "none")]
    spark.createDataFrame(chains, "prefix string, canonical string").coalesce(1).write.parquet(f"{tmp_path}/payee_prefix_map.parquet")
    payees = ["shop 250 xy", "Shop 003 #1", "Shop 299 ", "Shop 2", None]
    spark.createDataFrame(list(enumerate(payees)), "line_id long, payee string").write.parquet(f"{tmp_path}/expenditures.parquet")
    query = registry.queries()["canonical_payees"]
    assert {r["line_id"]: r["label"] for r in query(spark, str(tmp_path)).collect()} == {0: "Chain 250", 1: "Chain 3", 2: "Chain 299", 3: "Shop 2", 4: None}
    monkeypatch.setattr(derive, "MAX_PREFIXES", 100)
    with pytest.raises(ValueError):
        query(spark, str(tmp_path))
