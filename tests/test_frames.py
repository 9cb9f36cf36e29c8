import datetime as dt

import pandas as pd
import pytest

from tallyforge.functions import frames as R
from tallyforge.functions import sqltext as S
from tallyforge.functions import years as Y
from tallyforge.plans import gate, service


def frame(rows):
    return pd.DataFrame(rows, columns=["label", "value"])


@pytest.mark.parametrize("sql,ordered", [
    ("SELECT a FROM t", False), ("SELECT 'ORDER BY x' FROM t", False), ("SELECT a FROM t -- ORDER BY a", False), ("SELECT reorder_by FROM t", False),
    ("select * from t order   by a", True), ("SELECT rank() OVER (ORDER BY a) FROM t", True), ("WITH c AS (SELECT * FROM t ORDER BY a LIMIT 3) SELECT * FROM c", True),
])
def test_whether_a_query_speaks_of_order(sql, ordered):
    assert S.orders_result(sql) is ordered


@pytest.mark.parametrize("clause,want", [("ORDER BY top DESC", "top"), ("ORDER BY t.top", "top"), ('ORDER BY "top" DESC NULLS LAST', "top"), ("ORDER BY 2 DESC LIMIT 3", "top"), ("ORDER BY 9", None), ("ORDER BY other", None), ("", None), ("ORDER BY TOP desc, mean", "top")])
def test_ranked_measure(clause, want):
    assert S.order_measure(f"SELECT job, top, mean FROM t {clause}", ["job", "top", "mean"]) == want


def test_ordinals():
    assert S.ordinal_columns('SELECT a, row_number() OVER (ORDER BY b) AS "rank" FROM t') == {"rank"}
    assert S.ordinal_columns("SELECT ntile(4) OVER w AS q FROM t WINDOW w AS (ORDER BY ')')") == {"q"}
    assert S.ordinal_columns("SELECT 'rank() OVER () AS r', rank() OVER () FROM t") == set()


def test_charts():
    pay = pd.DataFrame({"job": list("abcdef"), "top": [9.0, 8, 7, 6, 5, 4], "mean": [1.0, 5, 2, 6, 3, 4]})
    assert R.pick_chart(pay).value == "mean"
    assert R.pick_chart(pay, "SELECT job, top, mean FROM t ORDER BY top DESC") == R.Chart("bar", "job", "top")
    years = pd.DataFrame({"fiscal_year": range(2001, 2020), "amount": [float(i % 7) for i in range(19)]})
    assert R.pick_chart(years).kind == "line"
    months = pd.DataFrame({"month": ["May", "June", "July", "August", "March", "April"], "amount": [1.0, 2, 3, 4, 5, 6]})
    assert R.pick_chart(months).kind == "bar"
    assert R.pick_chart(pd.DataFrame({"p": list("ab"), "n": [1, 2], "amount": [2.0, 3]})) == R.Chart("pie", "p", "amount")
    assert R.pick_chart(pd.DataFrame({"p": [str(i) for i in range(301)], "v": [float(i) for i in range(301)]})).kind is None
    assert R.pick_chart(pd.DataFrame({"p": [], "v": []})).kind is None


def test_window_of_points():
    asc = pd.DataFrame({"month": [f"20{y:02}-{m:02}" for y in range(10, 16) for m in range(1, 13)][:61], "v": [float(i % 5) for i in range(61)]})
    f, note = R.chart_window(asc, R.Chart("line", "month", "v"))
    assert note == "last 30 of 61" and f["month"].iloc[-1] == asc["month"].iloc[-1]
    f, _ = R.chart_window(asc[::-1], R.Chart("bar", "month", "v"))
    assert f["month"].iloc[0] == asc["month"].iloc[-1]
    ranked = frame([(str(i), float(100 - i)) for i in range(61)])
    assert R.chart_window(ranked, R.Chart("bar", "label", "value"))[1] == "top 30 of 61"
    assert R.chart_window(ranked[::-1], R.Chart("bar", "label", "value"))[1] == "30 of 61"
    assert R.chart_window(pd.concat([ranked.head(30), frame([(None, 1.0)])]), R.Chart("bar", "label", "value"))[1] is None


@pytest.mark.parametrize("label,is_total", [("TOTAL", True), ("Grand Total", True), ("TOTAL - ALL FUNDS", True), ("TOTAL ALL YEARS", True), ("SUBTOTAL", True), ("Overall total", True), ("TOTAL RENTALS OF BELVO INC", True), ("Total: all", True)])
def test_totals_by_shape_or_value(label, is_total):
    assert bool(R.total_mask(frame([(label, 100.0), ("a", 60.0), ("b", 40.0)]), "label", "value").iloc[0]) is is_total


def test_names_with_total_stay_and_totals_go_last():
    assert not R.total_mask(frame([("TOTAL RENTALS OF BELVO INC", 90.0), ("a", 60.0), ("b", 40.0)]), "label", "value").any()
    assert not R.total_mask(frame([("TOTAL RENTALS OF BELVO INC", 50.0), ("a", -30.0), ("b", -20.0)]), "label", "value").any()
    both = frame([("TOTAL - ALL", 100.0), ("SUBTOTAL", 50.0), ("a", 30.0), ("b", 20.0)])
    assert list(R.without_totals(both, "label", "value")["label"]) == ["a", "b"]
    moved, n = R.totals_last(both, "label", "value")
    assert n == 2 and list(moved["label"]) == ["a", "b", "TOTAL - ALL", "SUBTOTAL"]
    assert R.totals_last(frame([("TOTAL - A", 1.0), ("TOTAL - B", 2.0)]), "label", "value")[1] == 0


@pytest.mark.parametrize("label,told", [("total", True), ("GRAND  TOTAL", True), ("Total - x", True), ("Total–x", False), ("TOTAL SPENDING, 2020", True), ("TOTALS", False), ("NOT TOTAL", False), ("GRANDTOTAL", False), ("TOTALALL", False), ("", False)])
def test_labels_of_totals(label, told):
    assert R.says_total(label) is told


def test_direction_of_an_axis():
    s = lambda *x: pd.Series(x, dtype="object")
    assert R.direction(s("2020-01", "2020-02")) == 1 and R.direction(s("2021", "2020", None)) == -1 and R.direction(pd.Series([1, 3, 2])) == 0
    assert R.direction(s("May", "June")) is None and R.direction(s()) is None


def test_display_order_and_notes():
    f = frame([("x", 1.0), ("y", 3.0), ("z", 2.0)])
    assert list(R.display_order(f, "SELECT label, value FROM t")["label"]) == ["y", "z", "x"]
    assert list(R.display_order(f, "SELECT label, value FROM t ORDER BY label")["label"]) == ["x", "y", "z"]
    text = R.render(frame([(str(i), float(i)) for i in range(103)]), R.Chart("bar", "label", "value"))
    assert "[TRUNCATED: this table has 103 rows." in text and "the 53 rows in" in text


@pytest.mark.parametrize("name,whole,kind", [("total_spend", True, "currency"), ("n_distinct_payees", False, "count"), ("vendors", True, "count"), ("total", False, "currency"), ("employees_count", False, "count")])
def test_measure_kind(name, whole, kind):
    assert R.measure_kind(name, pd.Series([1, 2] if whole else [1.0, 2.0])) == kind


def test_humanize():
    labels = {"fund": "Fund", "fund_name": "Fund Name", "CalYear": "Year"}
    assert R.humanize("fund_name by fund in CalYear, other_col", labels) == "Fund Name by Fund in Year, Other Col"
    assert R.humanize("the fund of CalYear", labels, prose=True) == "the fund of Year"


def test_years():
    assert Y.fiscal_year_end(2026, 7) == dt.date(2026, 6, 30) and Y.fiscal_year_end(2026) == dt.date(2026, 12, 31)
    f = Y.year_facts(2026, 7, "2026-06-25", today=dt.date(2026, 8, 1))
    assert not f.partial and f.last_complete == 2026
    assert Y.year_facts(2026, 7, "2026-03-16", today=dt.date(2026, 8, 1)).in_progress == 2026
    assert Y.year_facts(2026, 7, "2026-06-30", today=dt.date(2026, 6, 30)).partial
    assert Y.year_facts(2026, 7, None, today=dt.date(2027, 8, 1)).last_complete == 2025
    assert Y.salary_facts(2026, None) is None


def test_year_context(spark):
    spark.createDataFrame([("2026-03-16", 2026), ("2025-06-30", 2025)], "payment_date string, fiscal_year int").createOrReplaceTempView("yc_e")
    spark.createDataFrame([(2026,), (2025,)], "CalYear int").createOrReplaceTempView("yc_s")
    ask = lambda t, **k: Y.year_context(spark, 7, dt.date(2026, 8, 1), ledger="yc_e", salaries=t, **k)
    c = ask("yc_s")
    assert (c["first"], c["newest"], c["in_progress"], c["last_complete"], c["salary_state"]) == (2025, 2026, 2026, 2025, "ok")
    assert ask("yc_none")["salary_state"] == "no_table"
    assert ask("yc_s", salary_year="other")["salary_state"] == "error"
    spark.table("yc_s").where("CalYear = 2026").createOrReplaceTempView("yc_1")
    spark.table("yc_s").where("false").createOrReplaceTempView("yc_0")
    assert ask("yc_1")["salary_state"] == "single_year" and ask("yc_0")["salary_state"] == "no_years"


@pytest.mark.parametrize("sql", ["DROP TABLE t", "CREATE TABLE x AS SELECT 1", "SET a=1", "INSERT INTO t VALUES (1)", "SELECT reflect('java.lang.System', 'exit')", "CACHE TABLE t", "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM parquet.`/tmp/x`", "SELECT 1 WHERE EXISTS (SELECT * FROM csv.`/etc/passwd`)", "WITH a AS (SELECT java_method('a', 'b')) SELECT * FROM a", "SELECT (SELECT max(v) FROM json.`/x`)", "SELECT input_file_name()", "SELECT * FROM no_such_table", "SELEC 1"])
def test_gate_refuses(spark, sql):
    with pytest.raises(gate.Refused):
        gate.check(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT load, use FROM gate_w WHERE call IN (SELECT load FROM gate_w)", "WITH a AS (SELECT * FROM gate_w) SELECT * FROM a WHERE EXISTS (SELECT 1 FROM gate_w b WHERE b.load = a.load)", "SELECT * FROM range(3)", "SHOW TABLES", "DESCRIBE gate_w", "SELECT load FROM gate_w UNION SELECT x FROM (VALUES (1), (2)) AS q(x)"])
def test_gate_lets_reading_pass(spark, sql):
    spark.createDataFrame([(1, 2, 3)], "load int, use int, call int").createOrReplaceTempView("gate_w")
    gate.check(spark, sql)


def test_aliases_in_where_and_quoted_names(spark):
    spark.createDataFrame([(1, "a"), (5, "b")], 'v int, `Odd Name` string').createOrReplaceTempView("gate_a")
    assert [tuple(r) for r in gate.ask(spark, 'SELECT v + 1 AS w, "Odd Name" FROM gate_a WHERE w > 3 AND "Odd Name" <> \'w\'').collect()] == [(6, "b")]
    assert [r[0] for r in gate.ask(spark, "SELECT v * 0 AS v FROM gate_a WHERE v > 3").collect()] == [0]  # a column goes before an alias
    assert gate.ask(spark, "SELECT n FROM (SELECT v AS n FROM gate_a QUALIFY row_number() OVER (ORDER BY v DESC) = 1)").first()[0] == 5


def test_gate_runs_and_rewrites(spark):
    spark.createDataFrame([("LOAD CO", "a", 1.0), ("b", "b", None), ("LOAD CO", "c", 3.0)], "payee string, payee_canonical string, amount double").createOrReplaceTempView("gate_t")
    r = gate.run(spark, "```sql\nSELECT payee, sum(amount) AS total_amount FROM gate_t WHERE payee = 'LOAD CO' GROUP BY payee\n```", {"payee": "payee_canonical"})
    assert r.n_rows == 0 and "payee_canonical = 'LOAD CO'" in r.sql
    r = gate.run(spark, "SELECT payee, string_agg(DISTINCT payee_canonical, '; ' ORDER BY payee_canonical) AS names FROM gate_t GROUP BY payee ORDER BY payee")
    assert list(r.frame["names"]) == ["a; c", "b"]
    r = gate.run(spark, "SELECT payee, amount FROM gate_t QUALIFY row_number() OVER (PARTITION BY payee ORDER BY amount DESC) = 1 ORDER BY amount")
    assert list(r.frame["payee"]) == ["LOAD CO", "b"]
    asked = []
    r = gate.answer(spark, "q", lambda q, err: asked.append(err) or ("SELECT nope FROM gate_t" if err is None else "SELECT * EXCLUDE (amount) FROM gate_t"))
    assert len(asked) == 2 and list(r.frame.columns) == ["payee", "payee_canonical"]


def test_dialect_bridge():
    assert S.to_spark("SELECT a FROM t ORDER BY a DESC, b NULLS FIRST LIMIT 2") == "SELECT a FROM t ORDER BY a DESC NULLS LAST, b NULLS FIRST LIMIT 2"
    assert S.to_spark("SELECT 7 // 2, '//' FROM t") == "SELECT 7  div  2, '//' FROM t"
    assert not S.is_query("I can't help with 'select' questions".replace("select", "these"))


def test_service_plane():
    t = [0.0]
    limit = service.RateLimit(2, 60, lambda: t[0])
    assert [limit.allow("x") for _ in range(3)] == [True, True, False]
    t[0] = 61
    assert limit.allow("x")
    cache = service.ResponseCache("prompt", cap=2)
    calls = []

    class Done:
        sql, text, chart, n_rows = "SELECT 1", "1", None, 1

    run = lambda q: calls.append(q) or Done
    a = list(service.events("Q?", run, cache, limit, service.Usage()))
    assert [e["type"] for e in a] == ["status", "sql", "results", "done"]
    t[0] = 200
    assert list(service.events("q?", run, cache, limit, service.Usage())) == a and len(calls) == 1
    for q in "abc":
        cache.put(q, [{"type": "done"}])
    assert len(cache.items) == 2
    cache.put("bad", [{"type": "error"}])
    assert cache.get("bad") is None
    tries = []
    assert service.with_retries(lambda: tries.append(1) or 1 / 0, lambda e: True, lambda: "other", times=2, sleep=lambda s: None) == "other" and len(tries) == 2
    assert service.refined("draft", lambda: iter([" "])) == "draft"
