import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyforge.operators import column_profile as P
from tallyforge.operators import schema_drift as D

REC = "raw_id long, feed string, file_name string, file_seq int, line_no int, record string"


def feed(files):
    """Rows of one feed from a list of lists of objects."""
    rows, n = [], 0
    for k, recs in enumerate(files, 1):
        for i, o in enumerate(recs, 1):
            n += 1
            rows.append((n, "f", f"y{k}.json", k, i, o if isinstance(o, str) or o is None else json.dumps(o)))
    return rows


def changes(spark, files):
    got = D.changes(spark.createDataFrame(feed(files), REC)).collect()
    return sorted((r["file_name"], r["change"], r["field_from"], r["field_to"]) for r in got)


def people(n, name, amount, seed, year="FISCAL_YEAR", kind=int):
    rnd = random.Random(seed)
    return [{name: f"{rnd.choice(['Acme', 'Bolt', 'Core'])} Paving {rnd.randint(1, 9)} Inc", amount: round(rnd.uniform(1, 900), 2), year: kind(2000 + seed)} for _ in range(n)]


def test_renamed_added_removed_retyped(spark):
    a, b = people(20, "payee", "AMOUNT", 1), people(20, "vendor_name", "dist_amount", 2)
    for o in b:
        o["region"] = "District 4"
    c = people(20, "Vendor_Name", "dist_amount", 3, kind=str)
    assert changes(spark, [a, b, c]) == [
        ("y2.json", "added", "", "region"), ("y2.json", "renamed", "AMOUNT", "dist_amount"), ("y2.json", "renamed", "payee", "vendor_name"),
        ("y3.json", "removed", "region", ""), ("y3.json", "renamed", "vendor_name", "Vendor_Name"), ("y3.json", "retyped", "FISCAL_YEAR", "FISCAL_YEAR"),
    ]


def test_single_odd_values_and_empty_fields_change_no_kind(spark):
    a, b, c = (people(9, "p", "amount", s) for s in (1, 2, 3))
    b[0]["amount"] = "12.50"
    for o in b:
        o["FISCAL_YEAR"] = None
    assert changes(spark, [a, b, c]) == []
    for o in c:
        o["FISCAL_YEAR"] = 2003.0
    assert changes(spark, [a, b, c]) == [("y3.json", "retyped", "FISCAL_YEAR", "FISCAL_YEAR")]


def test_odd_records_and_empty_tables(spark):
    files = [[None, "not json", "[1]", {"a": 1}], [{"a": 1, "b": {"c": [1]}}, {"a": True}]]
    assert changes(spark, files) == [("y2.json", "added", "", "b"), ("y2.json", "added", "", "b.c")]
    none = spark.createDataFrame([], REC)
    assert D.changes(none).count() == 0 and D.unify(none, ["raw_id"]).count() == 0


def test_unified_ledger(spark):
    a = [{"payee": "Acme Paving Inc", "AMOUNT": "1,200.50", "FISCAL_YEAR": 2001}, {"payee": "Bolt Co", "AMOUNT": "(3.00)", "FISCAL_YEAR": 2001}]
    b = [{"vendor_name": "Acme Paving Inc", "dist_amount": 7.5, "budget_year": "FY2002", "x": 1}, {"vendor_name": "Bolt Co", "dist_amount": 8.5, "budget_year": "FY2002"}]
    df = D.unify(spark.createDataFrame(feed([a, b]), REC), ["raw_id"])
    got = {r["raw_id"]: (r["fiscal_year"], r["extended_amount"], r["payee"], r["others"]) for r in df.collect()}
    assert got[1] == (2001, 1200.5, "Acme Paving Inc", "{}") and got[2][1] == -3.0
    assert got[3] == (2002, 7.5, "Acme Paving Inc", '{"x": 1}')


def test_fields_inside_of_objects(spark):
    a, b = ([{"id": k, "party": {n: f"{w} Paving {k % 5} Inc", "town": f"Town {k % 3}"}} for k in range(20)] for n, w in (("payee", "Acme"), ("vendor_name", "Acme")))
    assert changes(spark, [a, b]) == [("y2.json", "renamed", "party.payee", "party.vendor_name")]
    moved = [{"id": k, "party": {"vendor_name": f"Acme Paving {k % 5} Inc", "town": k % 3}} for k in range(20)]
    assert changes(spark, [b, moved]) == [("y2.json", "retyped", "party.town", "party.town")]
    df = D.unify(spark.createDataFrame(feed([b]), REC), ["raw_id"])
    assert {r["payee"] for r in df.collect()} == {f"Acme Paving {k} Inc" for k in range(5)}


def fields(files):
    """The fields of files of one feed, as the matcher sees them."""
    out = []
    for recs in files:
        acc = {}
        for o in recs:
            for k, (f, v) in enumerate(D.flat(o).items()):
                t = acc.setdefault(f, D.Tally())
                t.pos += k
                t.n += 1
                if v is not None:
                    t.add(D.traits(v))
        out.append([D.Field(f, t.pos / t.n, None, t.classes, t.log_sum / t.log_n if t.log_n else None, t.vals, t.words) for f, t in acc.items()])
    return out


def test_the_flow_decides_renames():
    """What field pairs start with, their names, finds none of these; the flow from values, types and neighbours does."""
    rnd = random.Random(3)
    rec = lambda who, day, sum_: [{who: f"{rnd.choice(['Acme', 'Bolt', 'Core'])} Paving Inc", day: f"2020-0{rnd.randint(1, 9)}-11", sum_: round(rnd.uniform(1, 9e3), 2), "note": "x y"} for _ in range(25)]
    before, after = fields([rec("payee", "payment_date", "extended_amount"), rec("supplier", "settled", "charge")])
    want = [("extended_amount", "charge"), ("payee", "supplier"), ("payment_date", "settled")]
    assert sorted(D.match_renames(before, after)) == want
    assert D.match_renames(before, after, rounds=0) == []
    scores = D.flood(before, after)
    assert scores.shape == (4, 4) and scores.max() == 1.0 and scores.min() >= 0.0


def test_flooding_converges_whatever_the_rounds():
    before, after = fields([[{"a_b": 1, "c": "x"}], [{"a": 2, "c": "x", "d.e": None}]])
    assert abs(D.flood(before, after, rounds=60) - D.flood(before, after, rounds=600)).max() < 1e-2
    assert D.flood([], after).shape == (0, 3) and D.match_renames([], after) == [] == D.match_renames(before, [])


def test_flooding_prefers_the_like_field():
    f = lambda name, pos, cls: D.Field(name, pos, "string", cls, None)
    left = [f("payment_date", 0, [9, 0, 0, 0, 0, 0, 0]), f("payment_void_date", 1, [9, 0, 0, 0, 0, 0, 0])]
    right = [f("CheckVoidDt", 0, [9, 0, 0, 0, 0, 0, 0]), f("RECORD_DATE", 1, [9, 0, 0, 0, 0, 0, 0])]
    assert sorted(D.match_renames(left, right)) == [("payment_date", "RECORD_DATE"), ("payment_void_date", "CheckVoidDt")]


@pytest.mark.parametrize("value,want", [(2015, ("year", "2015")), ("FY2015", ("year", "2015")), ("2015-2016", ("year", "2015")), ("03/16/2025", ("date", "2025-03-16")), (1745798400000, ("date", "2025-04-28")), ("(83.02)", ("money", "-83.02")), (7, ("int", "7")), ("A12", ("code", "a12")), ({"b": 1}, ("nested", '{"b": 1}'))])
def test_value_classes(value, want):
    assert D.classify(value) == want


# ---- load profiles ----


def loads(tmp_path, rows, name="t", group=1000):
    t = pa.table({"load_id": pa.array([r[0] for r in rows], pa.int64()), "city": [r[1] for r in rows], "loaded_at": pa.array([None if r[2] is None else f"{r[2]}-08-02" for r in rows]).cast(pa.timestamp("us")), "v": pa.array([r[3] for r in rows], pa.int32() if all(r[3] is None or isinstance(r[3], int) for r in rows) else pa.string())})
    path = tmp_path / f"{name}.parquet"
    pq.write_table(t, path, row_group_size=group)
    return str(path)


def found(spark, path, rule):
    return sorted((r["load_id"], r["finding"]) for r in P.findings(spark, path, "t", [rule]).collect())


def test_findings_of_text(spark, tmp_path):
    rule = P.ColumnRule("v", missing_rise=0.1, pattern=r"\A[0-9]{4} - [A-Z]+\z", pattern_share=0.02, distinct_factor=1.5, shift=0.5)
    rows = [(1, "a", 2020, "1000 - A")] * 8 + [(2, "a", 2021, "1000 - A")] * 4 + [(2, "a", 2021, x) for x in (None, "", "  ", "bad")]
    rows += [(3, "a", 2022, f"100{i} - B") for i in range(8)] + [(9, "b", 2022, None)] * 2 + [(10, "b", 2023, "1000 - A")] * 2 + [(None, "a", 2020, "x")]
    assert found(spark, loads(tmp_path, rows), rule) == [(2, "missing"), (2, "pattern"), (3, "distinct"), (3, "shift")]


def test_findings_of_numbers_from_footers_and_from_data_agree(spark, tmp_path):
    rule = P.ColumnRule("v", missing_rise=0.1, low=2000, distinct_factor=1.5)
    rows = [(1, "a", 2020, 2020)] * 10 + [(2, "a", 2021, None)] * 10 + [(3, "a", 2022, 1899)] * 10
    one = loads(tmp_path, rows, "one", 7)
    folder = tmp_path / "many.parquet"
    folder.mkdir()
    for k in (1, 2, 3):
        part = loads(tmp_path, [r for r in rows if r[0] == k], f"p{k}")
        (folder / f"p{k}.parquet").write_bytes(open(part, "rb").read())
    want = [(2, "missing"), (3, "range")]
    assert found(spark, one, rule) == want and found(spark, str(folder), rule) == want
    stats = P.footers(spark, str(folder), ["load_id", "city", "loaded_at", "v"])
    known, whole = P.footer_counts(stats, "load_id", ["city", "loaded_at"], "v")
    assert len(whole) == 3
    assert {(r["load_id"], r["value"], r["n"]) for r in known.collect()} == {("1", "2020", 10), ("2", None, 10), ("3", "1899", 10)}


def test_empty_table(spark, tmp_path):
    assert found(spark, loads(tmp_path, []), P.ColumnRule("v", missing_rise=0.1, low=2000, distinct_factor=1.5)) == []
