"""Queries over the payment ledger: summaries, screens, rankings, set operations, windows; each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import derive
from tallyforge.plans import gate
from tallyforge.session import table

GRANT_WORDS = ["grant", "federal", "state", "shelter", "home ", "trust", "opioid", "special", "housing"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and its oracle under the function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def ledger(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "expenditures")


def total(c: str = "extended_amount"):
    return C.round2(F.sum(c))


# ---- summaries ----


@query("""SELECT agency_canonical AS agency, round(sum(extended_amount) * 100, 0) / 100 AS total_spend, count(*) AS n_payments, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year
FROM expenditures WHERE agency_canonical IS NOT NULL GROUP BY agency_canonical""")
def agency_spend(spark, base):
    return ledger(spark, base).where("agency_canonical IS NOT NULL").groupBy(F.col("agency_canonical").alias("agency")).agg(total().alias("total_spend"), F.count(F.lit(1)).alias("n_payments"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))


@query("SELECT fiscal_year, round(sum(extended_amount) * 100, 0) / 100 AS total_spend, count(*) AS n_payments, count(DISTINCT agency_canonical) AS n_agencies FROM expenditures GROUP BY fiscal_year")
def annual_spend(spark, base):
    return ledger(spark, base).groupBy("fiscal_year").agg(total().alias("total_spend"), F.count(F.lit(1)).alias("n_payments"), F.count_distinct("agency_canonical").alias("n_agencies"))


@query("SELECT expenditure_type, fiscal_year, round(sum(extended_amount) * 100, 0) / 100 AS total_spend, count(*) AS n FROM expenditures WHERE expenditure_type IS NOT NULL GROUP BY 1, 2")
def type_by_year(spark, base):
    return ledger(spark, base).where("expenditure_type IS NOT NULL").groupBy("expenditure_type", "fiscal_year").agg(total().alias("total_spend"), F.count(F.lit(1)).alias("n"))


@query("""SELECT jobTitle AS job_title, Department AS department, round(avg(YTD_Total) * 100, 0) / 100 AS avg_total, max(YTD_Total) AS max_total, count(DISTINCT Employee_Name) AS n_employees
FROM salary_data WHERE CalYear = (SELECT max(CalYear) - 1 FROM salary_data WHERE CalYear <= 2026) AND YTD_Total IS NOT NULL GROUP BY 1, 2""")
def top_salaries(spark, base):
    s = table(spark, base, "salary_data")
    year = s.where("CalYear <= 2026").agg((F.max("CalYear") - 1).alias("y"))
    return (
        s.where("YTD_Total IS NOT NULL").join(F.broadcast(year), F.col("CalYear") == F.col("y"))  # one row
        .groupBy(F.col("jobTitle").alias("job_title"), F.col("Department").alias("department"))
        .agg(C.round2(F.avg("YTD_Total")).alias("avg_total"), F.max("YTD_Total").alias("max_total"), F.count_distinct("Employee_Name").alias("n_employees"))
    )


@query("""SELECT e.agency_canonical AS agency, count(DISTINCT e.payee_canonical) AS n_contractors, count(*) AS n_payments, round(sum(e.extended_amount) * 100, 0) / 100 AS total_spend
FROM expenditures e JOIN (SELECT DISTINCT lower(FULLNAME) AS k FROM active_contractors WHERE FULLNAME IS NOT NULL) c ON lower(e.payee_canonical) = c.k GROUP BY 1""")
def agency_contractors(spark, base):
    """The licence table has several rows per firm: it is made distinct before the join, so payments never multiply."""
    firms = table(spark, base, "active_contractors").select(F.lower("FULLNAME").alias("k")).where("k IS NOT NULL").distinct()
    e = ledger(spark, base)
    return e.join(firms, F.lower("payee_canonical") == F.col("k")).groupBy(F.col("agency_canonical").alias("agency")).agg(F.count_distinct("payee_canonical").alias("n_contractors"), F.count(F.lit(1)).alias("n_payments"), total().alias("total_spend"))


_GRANTS_SQL = " OR ".join(f"lower(fund) LIKE '%{w}%'" for w in GRANT_WORDS)


@query(f"SELECT fund, fiscal_year, round(sum(extended_amount) * 100, 0) / 100 AS total_spend, count(*) AS n FROM expenditures WHERE {_GRANTS_SQL} GROUP BY 1, 2")
def grant_funding(spark, base):
    return ledger(spark, base).where(C.contains_any(F.col("fund"), GRANT_WORDS)).groupBy("fund", "fiscal_year").agg(total().alias("total_spend"), F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN grouping(fund) = 1 THEN 'TOTAL - ALL FUNDS' ELSE fund END AS fund_label, CAST(grouping(fund) AS INTEGER) AS is_total, round(sum(extended_amount) * 100, 0) / 100 AS total_spend, count(*) AS n
FROM expenditures GROUP BY ROLLUP(fund)""")
def fund_rollup(spark, base):
    """The grand total is told by grouping, so a genuine null fund keeps its own row."""
    r = ledger(spark, base).rollup("fund").agg(F.grouping("fund").cast("int").alias("is_total"), total().alias("total_spend"), F.count(F.lit(1)).alias("n"))
    return r.select(F.when(F.col("is_total") == 1, "TOTAL - ALL FUNDS").otherwise(F.col("fund")).alias("fund_label"), "is_total", "total_spend", "n")


@query("SELECT city, invoice_number, count(*) AS n, round(sum(extended_amount) * 100, 0) / 100 AS net FROM expenditures WHERE invoice_number IS NOT NULL AND extended_amount IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 AND abs(sum(extended_amount)) < 0.01")
def netting_groups(spark, base):
    g = ledger(spark, base).where("invoice_number IS NOT NULL AND extended_amount IS NOT NULL").groupBy("city", "invoice_number").agg(F.count(F.lit(1)).alias("n"), F.sum("extended_amount").alias("s"))
    return g.where("n > 1 AND abs(s) < 0.01").select("city", "invoice_number", "n", C.round2(F.col("s")).alias("net"))


@query("SELECT payee_canonical, agency_canonical, count(*) AS n, round(sum(extended_amount) * 100, 0) / 100 AS total_spend FROM expenditures WHERE extended_amount BETWEEN 4000 AND 4999.99 GROUP BY 1, 2 HAVING count(*) >= 2")
def just_under_screen(spark, base):
    """Payments just below a threshold, told by payee and agency."""
    g = ledger(spark, base).where(F.col("extended_amount").between(4000, 4999.99)).groupBy("payee_canonical", "agency_canonical").agg(F.count(F.lit(1)).alias("n"), total().alias("total_spend"))
    return g.where("n >= 2")


@query("SELECT payee_canonical, count(DISTINCT agency_canonical) AS n_agencies, count(DISTINCT city) AS n_cities, round(sum(extended_amount) * 100, 0) / 100 AS total_spend FROM expenditures WHERE payee_canonical IS NOT NULL GROUP BY 1")
def payee_breadth(spark, base):
    return ledger(spark, base).where("payee_canonical IS NOT NULL").groupBy("payee_canonical").agg(F.count_distinct("agency_canonical").alias("n_agencies"), F.count_distinct("city").alias("n_cities"), total().alias("total_spend"))


_PROFILE_FROM = "FROM expenditures WHERE extended_amount > 0 AND payee_canonical IS NOT NULL GROUP BY payee_canonical"


@query(f"""SELECT payee_canonical AS payee, round(sum(extended_amount) * 100, 0) / 100 AS total_spend, count(*) AS transaction_count, count(DISTINCT fiscal_year) AS years_active, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year,
count(DISTINCT agency_canonical) AS agencies_served, coalesce(string_agg(DISTINCT agency_canonical, '; ' ORDER BY agency_canonical), '') AS agency_list, count(DISTINCT fund) AS funds_used, count(DISTINCT expenditure_type) AS expenditure_types {_PROFILE_FROM}""")
def payee_profiles(spark, base):
    return profiles(ledger(spark, base))


def profiles(e: DataFrame) -> DataFrame:
    """Ten measures of every paid payee.

    Payments are first added up per combination of what is counted distinct, so the distinct counts don't multiply the
    rows that are shuffled.
    """
    dims = ["fiscal_year", "agency_canonical", "fund", "expenditure_type"]
    g = e.where("extended_amount > 0 AND payee_canonical IS NOT NULL").groupBy(F.col("payee_canonical").alias("payee"), *dims).agg(F.sum("extended_amount").alias("s"), F.count(F.lit(1)).alias("n"))
    sets = g.groupBy("payee").agg(F.sum("s").alias("s"), F.sum("n").alias("transaction_count"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), *[F.collect_set(d).alias(d) for d in dims])
    size = lambda c: F.size(c).cast("long")
    return sets.select(
        "payee",
        C.round2(F.col("s")).alias("total_spend"),
        "transaction_count",
        size("fiscal_year").alias("years_active"),
        "first_year",
        "last_year",
        size("agency_canonical").alias("agencies_served"),
        F.array_join(F.array_sort("agency_canonical"), "; ").alias("agency_list"),
        size("fund").alias("funds_used"),
        size("expenditure_type").alias("expenditure_types"),
    )


@query("SELECT Department AS department, CalYear AS cal_year, round(sum(coalesce(Annual_Rate, 0)) * 100, 0) / 100 AS budget, round(sum(coalesce(YTD_Total, 0)) * 100, 0) / 100 AS paid, count(*) AS n FROM salary_data GROUP BY 1, 2")
def department_rollup(spark, base):
    s = table(spark, base, "salary_data")
    money = lambda c: C.round2(F.sum(F.coalesce(c, F.lit(0.0))))
    return s.groupBy(F.col("Department").alias("department"), F.col("CalYear").alias("cal_year")).agg(money("Annual_Rate").alias("budget"), money("YTD_Total").alias("paid"), F.count(F.lit(1)).alias("n"))


@query("""SELECT s.city, s.Department AS department, s.budget, coalesce(e.actual, 0) AS actual FROM
(SELECT city, Department, round(sum(YTD_Total) * 100, 0) / 100 AS budget FROM salary_data WHERE CalYear = 2024 AND Department IS NOT NULL GROUP BY 1, 2) s
LEFT JOIN (SELECT city, agency_canonical, round(sum(extended_amount) * 100, 0) / 100 AS actual FROM expenditures WHERE fiscal_year = 2024 GROUP BY 1, 2) e ON s.city = e.city AND s.Department = e.agency_canonical""")
def plan_against_actual(spark, base):
    s = table(spark, base, "salary_data").where("CalYear = 2024 AND Department IS NOT NULL").groupBy("city", F.col("Department").alias("department")).agg(total("YTD_Total").alias("budget"))
    e = ledger(spark, base).where("fiscal_year = 2024").groupBy(F.col("city").alias("c"), "agency_canonical").agg(total().alias("actual"))
    j = s.join(e, (F.col("city") == F.col("c")) & (F.col("department") == F.col("agency_canonical")), "left")
    return j.select("city", "department", "budget", F.coalesce("actual", F.lit(0.0)).alias("actual"))


@query("""SELECT 'supplies' AS view, round(sum(extended_amount) * 100, 0) / 100 AS total_spend, count(*) AS n FROM expenditures WHERE spend_category LIKE 'Office%'
UNION ALL SELECT 'any supplies', round(sum(extended_amount) * 100, 0) / 100, count(*) FROM expenditures WHERE spend_category ILIKE '%supplies%'
UNION ALL SELECT 'travel', round(sum(extended_amount) * 100, 0) / 100, count(*) FROM expenditures WHERE spend_category = 'Travel'""")
def overlapping_views(spark, base):
    e = ledger(spark, base)
    part = lambda name, cond: e.where(cond).agg(total().alias("total_spend"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("view"), "total_spend", "n")
    return part("supplies", F.col("spend_category").like("Office%")).unionAll(part("any supplies", F.col("spend_category").ilike("%supplies%"))).unionAll(part("travel", F.col("spend_category") == "Travel"))


@query("SELECT min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, max(payment_date) AS last_payment, count(*) AS n FROM expenditures")
def ledger_span(spark, base):
    return ledger(spark, base).agg(F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.max("payment_date").alias("last_payment"), F.count(F.lit(1)).alias("n"))


@query("SELECT payee_canonical AS value, round(sum(TRY_CAST(extended_amount AS DOUBLE)) * 100, 0) / 100 AS weight, count(*) AS n FROM expenditures WHERE NOT is_data_artifact AND payee_canonical IS NOT NULL GROUP BY 1")
def value_weights(spark, base):
    return ledger(spark, base).where("NOT is_data_artifact AND payee_canonical IS NOT NULL").groupBy(F.col("payee_canonical").alias("value")).agg(C.round2(F.sum(F.col("extended_amount").try_cast("double"))).alias("weight"), F.count(F.lit(1)).alias("n"))


# ---- projections, filters, derived columns ----


@query("""SELECT line_id, CASE WHEN payee IS NULL THEN NULL ELSE coalesce(""" + "{chain}" + """, payee) END AS label FROM expenditures""")
def canonical_payees(spark, base):
    """Prefix map in file order, any case; what no prefix fits keeps its own name."""
    pre = derive.prefix_rows(table(spark, base, "payee_prefix_map"))
    return derive.canonicalize(ledger(spark, base).select("line_id", "payee"), "payee", "label", prefixes=pre, case_insensitive=True).select("line_id", "label")


ORACLES["canonical_payees"] = """WITH m AS (SELECT upper(prefix) AS p, canonical AS c, row_number() OVER () AS o FROM payee_prefix_map),
h AS (SELECT payee, min_by(c, o) AS c FROM (SELECT DISTINCT payee FROM expenditures WHERE payee IS NOT NULL) x JOIN m ON starts_with(upper(payee), p) GROUP BY payee)
SELECT e.line_id, coalesce(h.c, e.payee) AS label FROM expenditures e LEFT JOIN h ON e.payee = h.payee"""


@query("SELECT e.line_id, coalesce(m.canonical, e.agency) AS label FROM expenditures e LEFT JOIN (SELECT city, source, min(canonical) AS canonical FROM agency_map WHERE canonical IS NOT NULL GROUP BY 1, 2) m ON e.city = m.city AND e.agency = m.source")
def canonical_agencies(spark, base):
    """Exact map of each city."""
    m = table(spark, base, "agency_map").select("city", "source", "canonical")
    return derive.canonicalize(ledger(spark, base).select("line_id", "city", "agency"), "agency", "label", m, on=["city"]).select("line_id", "label")


@query("SELECT count(DISTINCT payee) AS n_source, count(DISTINCT payee_canonical) AS n_target FROM expenditures")
def canonical_effect(spark, base):
    return derive.distinct_before_after(ledger(spark, base), "payee", "payee_canonical")


@query("""WITH k AS (SELECT city, payee, invoice_number FROM expenditures WHERE extended_amount IS NOT NULL GROUP BY 1, 2, 3 HAVING abs(sum(extended_amount)) < 0.01 AND count(*) > 1)
SELECT e.line_id, EXISTS (SELECT 1 FROM k WHERE k.city = e.city AND k.payee = e.payee AND k.invoice_number = e.invoice_number) AS nets FROM expenditures e""")
def flag_offsetting(spark, base):
    e = ledger(spark, base).select("line_id", "city", "payee", "invoice_number", "extended_amount")
    return derive.flag_offsetting(e, ["city", "payee", "invoice_number"], "extended_amount", "nets").select("line_id", "nets")


@query("""WITH k AS (SELECT city, payee FROM expenditures GROUP BY 1, 2 HAVING abs(sum(extended_amount)) < abs(max(extended_amount)))
SELECT e.line_id, coalesce(abs(e.extended_amount) > 1000, false) AND EXISTS (SELECT 1 FROM k WHERE k.city = e.city AND k.payee = e.payee) AS artifact FROM expenditures e""")
def flag_artifacts(spark, base):
    e = ledger(spark, base).select("line_id", "city", "payee", "extended_amount")
    return derive.flag_artifacts(e, ["city", "payee"], "extended_amount", 1000.0, "artifact").select("line_id", "artifact")


@query("SELECT substr(payment_date, 1, 7) AS month, round(sum(extended_amount) * 100, 0) / 100 AS total_spend, count(*) AS n FROM expenditures WHERE payment_date IS NOT NULL GROUP BY 1")
def spend_by_month(spark, base):
    return ledger(spark, base).where("payment_date IS NOT NULL").groupBy(C.month_of(F.col("payment_date")).alias("month")).agg(total().alias("total_spend"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT payee FROM expenditures WHERE regexp_matches(payee, '(?i)\\b(LLC|INC|CORP|CO|LTD|LP|COMPANY|SERVICES|ENGINEERING)\\b')")
def business_names(spark, base):
    return ledger(spark, base).where(F.col("payee").rlike(r"(?i)\b(LLC|INC|CORP|CO|LTD|LP|COMPANY|SERVICES|ENGINEERING)\b")).select("payee").distinct()


@query("SELECT coalesce(agency, 'N/A') AS agency_label, count(*) AS n FROM expenditures WHERE extended_amount IS NOT NULL GROUP BY 1")
def null_discipline(spark, base):
    return ledger(spark, base).where("extended_amount IS NOT NULL").groupBy(F.coalesce("agency", F.lit("N/A")).alias("agency_label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT line_id, CAST(year(TRY_CAST(payment_date AS DATE)) + CASE WHEN month(TRY_CAST(payment_date AS DATE)) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS derived_year,
CASE WHEN fiscal_year IS NULL THEN NULL ELSE CAST(make_date(fiscal_year, 6, 30) AS VARCHAR) END AS year_end FROM expenditures""")
def derived_fiscal_year(spark, base):
    d = F.col("payment_date").try_cast("date")
    return ledger(spark, base).select("line_id", C.fiscal_year_of(d, 7).alias("derived_year"), C.fiscal_year_end_of(F.col("fiscal_year"), 7).cast("string").alias("year_end"))


# ---- joins ----


@query("SELECT e.line_id, c.LICENSENO AS licence FROM expenditures e LEFT JOIN active_contractors c ON lower(trim(e.payee_canonical)) = lower(trim(c.FULLNAME)) WHERE e.extended_amount > 1000")
def licence_fan_out(spark, base):
    """Left join without making the right side distinct: a payment has a row per licence row."""
    e = ledger(spark, base).where("extended_amount > 1000").select("line_id", "payee_canonical")
    c = table(spark, base, "active_contractors").select("FULLNAME", F.col("LICENSENO").alias("licence"))
    return e.join(c, F.lower(F.trim("payee_canonical")) == F.lower(F.trim("FULLNAME")), "left").select("line_id", "licence")


@query("""WITH h AS (SELECT DISTINCT payee, min(payee_canonical) AS pc FROM expenditures WHERE payee IS NOT NULL GROUP BY payee), c AS (SELECT lower(FULLNAME) AS k, count(*) AS n FROM active_contractors WHERE FULLNAME IS NOT NULL GROUP BY 1)
SELECT e.line_id, coalesce(h.pc, e.payee) AS name, c.n AS n_licences FROM expenditures e LEFT JOIN h ON e.payee = h.payee LEFT JOIN c ON lower(coalesce(h.pc, e.payee)) = c.k""")
def chained_left_joins(spark, base):
    e = ledger(spark, base)
    h = e.where("payee IS NOT NULL").groupBy(F.col("payee").alias("p")).agg(F.min("payee_canonical").alias("pc"))
    c = table(spark, base, "active_contractors").where("FULLNAME IS NOT NULL").groupBy(F.lower("FULLNAME").alias("k")).agg(F.count(F.lit(1)).alias("n_licences"))
    j = e.select("line_id", "payee").join(h, F.col("payee") == F.col("p"), "left").select("line_id", F.coalesce("pc", "payee").alias("name"))
    return j.join(c, F.lower("name") == F.col("k"), "left").select("line_id", "name", "n_licences")


@query("SELECT line_id FROM expenditures e WHERE EXISTS (SELECT 1 FROM active_contractors c WHERE lower(c.FULLNAME) = lower(e.payee_canonical))")
def licensed_lines(spark, base):
    c = table(spark, base, "active_contractors").select(F.lower("FULLNAME").alias("k"))
    return ledger(spark, base).select("line_id", "payee_canonical").join(c, F.lower("payee_canonical") == F.col("k"), "left_semi").select("line_id")


@query("SELECT DISTINCT payee_canonical FROM expenditures e WHERE payee_canonical IS NOT NULL AND NOT EXISTS (SELECT 1 FROM active_contractors c WHERE lower(c.FULLNAME) = lower(e.payee_canonical))")
def unlicensed_payees(spark, base):
    c = table(spark, base, "active_contractors").select(F.lower("FULLNAME").alias("k")).where("k IS NOT NULL")
    return ledger(spark, base).where("payee_canonical IS NOT NULL").select("payee_canonical").distinct().join(c, F.lower("payee_canonical") == F.col("k"), "left_anti")


# ---- order, limits, windows ----


@query("SELECT agency_canonical, round(sum(extended_amount) * 100, 0) / 100 AS total_spend FROM expenditures WHERE agency_canonical IS NOT NULL GROUP BY 1 ORDER BY total_spend DESC NULLS LAST, agency_canonical LIMIT 20")
def top_agencies(spark, base):
    g = ledger(spark, base).where("agency_canonical IS NOT NULL").groupBy("agency_canonical").agg(total().alias("total_spend"))
    return g.orderBy(F.col("total_spend").desc_nulls_last(), "agency_canonical").limit(20)


@query("SELECT line_id, payee_canonical, extended_amount FROM expenditures WHERE extended_amount > 0 AND NOT is_data_artifact AND NOT is_offsetting")
def largest_payments(spark, base):
    e = ledger(spark, base).where("extended_amount > 0 AND NOT is_data_artifact AND NOT is_offsetting")
    return e.select("line_id", "payee_canonical", "extended_amount").orderBy(F.col("extended_amount").desc_nulls_last(), "line_id")


@query("SELECT DISTINCT spend_category FROM expenditures WHERE spend_category IS NOT NULL ORDER BY 1 LIMIT 12")
def sample_values(spark, base):
    return ledger(spark, base).select("spend_category").where("spend_category IS NOT NULL").distinct().orderBy("spend_category").limit(12)


@query("""SELECT city, payee_canonical, total_spend, CAST(rn AS INTEGER) AS place FROM (SELECT city, payee_canonical, round(sum(extended_amount) * 100, 0) / 100 AS total_spend,
row_number() OVER (PARTITION BY city ORDER BY round(sum(extended_amount) * 100, 0) / 100 DESC NULLS LAST, payee_canonical) AS rn FROM expenditures WHERE payee_canonical IS NOT NULL GROUP BY 1, 2) WHERE rn <= 3""")
def top_payees_per_city(spark, base):
    g = ledger(spark, base).where("payee_canonical IS NOT NULL").groupBy("city", "payee_canonical").agg(total().alias("total_spend"))
    w = Window.partitionBy("city").orderBy(F.col("total_spend").desc_nulls_last(), "payee_canonical")
    return g.withColumn("place", F.row_number().over(w)).where("place <= 3")


@query("""WITH g AS (SELECT city, agency_canonical, count(*) AS n FROM expenditures WHERE agency_canonical IS NOT NULL GROUP BY 1, 2)
SELECT city, agency_canonical, n, CAST(rank() OVER w AS INTEGER) AS rnk, CAST(dense_rank() OVER w AS INTEGER) AS dense, round(percent_rank() OVER w * 10000, 0) / 10000 AS pct, CAST(ntile(4) OVER (PARTITION BY city ORDER BY n DESC, agency_canonical) AS INTEGER) AS quarter FROM g WINDOW w AS (PARTITION BY city ORDER BY n DESC)""")
def ranking_functions(spark, base):
    g = ledger(spark, base).where("agency_canonical IS NOT NULL").groupBy("city", "agency_canonical").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("city").orderBy(F.desc("n"))
    t = Window.partitionBy("city").orderBy(F.desc("n"), "agency_canonical")
    return g.select("city", "agency_canonical", "n", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), (F.round(F.percent_rank().over(w) * 10000, 0) / 10000).alias("pct"), F.ntile(4).over(t).alias("quarter"))


@query("""WITH g AS (SELECT city, substr(payment_date, 1, 7) AS month, sum(extended_amount) AS s FROM expenditures WHERE payment_date IS NOT NULL AND extended_amount IS NOT NULL GROUP BY 1, 2)
SELECT city, month, round(sum(s) OVER (PARTITION BY city ORDER BY month) * 100, 0) / 100 AS running FROM g""")
def running_total(spark, base):
    """Months are aggregated first; the window then runs over few rows per city."""
    g = ledger(spark, base).where("payment_date IS NOT NULL AND extended_amount IS NOT NULL").groupBy("city", C.month_of(F.col("payment_date")).alias("month")).agg(F.sum("extended_amount").alias("s"))
    w = Window.partitionBy("city").orderBy("month").rangeBetween(Window.unboundedPreceding, 0)
    return g.select("city", "month", C.round2(F.sum("s").over(w)).alias("running"))


@query("""SELECT city, payee, invoice_number, line_id, load_id FROM (SELECT *, row_number() OVER (PARTITION BY city, payee, invoice_number ORDER BY load_id DESC, line_id DESC) AS rn FROM expenditures WHERE invoice_number IS NOT NULL AND payee IS NOT NULL) WHERE rn = 1""")
def latest_delivery(spark, base):
    """The newest line of each invoice: an aggregation with max_by instead of a window, so it combines before the shuffle."""
    e = ledger(spark, base).where("invoice_number IS NOT NULL AND payee IS NOT NULL")
    g = e.groupBy("city", "payee", "invoice_number").agg(F.max(F.struct("load_id", "line_id")).alias("m"))
    return g.select("city", "payee", "invoice_number", "m.line_id", "m.load_id")


# ---- set operations ----


@query("SELECT payee_canonical AS name FROM expenditures WHERE payee_canonical IS NOT NULL UNION SELECT FULLNAME FROM active_contractors WHERE FULLNAME IS NOT NULL")
def union_distinct(spark, base):
    a = ledger(spark, base).where("payee_canonical IS NOT NULL").select(F.col("payee_canonical").alias("name"))
    return a.union(table(spark, base, "active_contractors").where("FULLNAME IS NOT NULL").select("FULLNAME")).distinct()


@query("SELECT city, load_id, CalYear AS year, NULL AS fund, YTD_Total AS amount FROM salary_data UNION ALL SELECT city, load_id, fiscal_year, fund, extended_amount FROM expenditures")
def union_by_name(spark, base):
    a = table(spark, base, "salary_data").select("city", "load_id", F.col("CalYear").alias("year"), F.col("YTD_Total").alias("amount"))
    b = ledger(spark, base).select("fund", F.col("extended_amount").alias("amount"), "load_id", "city", F.col("fiscal_year").alias("year"))
    return a.unionByName(b, allowMissingColumns=True).select("city", "load_id", "year", "fund", "amount")


@query("SELECT payee AS name FROM expenditures WHERE payee IS NOT NULL INTERSECT SELECT FULLNAME FROM active_contractors")
def intersection(spark, base):
    return ledger(spark, base).where("payee IS NOT NULL").select(F.col("payee").alias("name")).intersect(table(spark, base, "active_contractors").select("FULLNAME"))


@query("SELECT DISTINCT city, fund FROM expenditures")
def distinct_rows(spark, base):
    return ledger(spark, base).select("city", "fund").distinct()


# ---- statements of the embedded engine's dialect, bridged ----


def bridged(name: str, sql: str) -> None:
    """Registers a statement that runs through the dialect bridge; its oracle is the statement itself."""

    def run(spark, base):
        for t in ("expenditures", "agency_map", "salary_data"):
            if t in sql:
                table(spark, base, t).createOrReplaceTempView(t)
        return gate.ask(spark, sql)

    run.__name__ = name
    query(sql)(run)


bridged("sql_qualify", "SELECT city, payee_canonical, line_id, extended_amount FROM expenditures WHERE extended_amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city ORDER BY extended_amount DESC, line_id) <= 2 ORDER BY city, line_id")
bridged("sql_list_aggregation", "SELECT city, string_agg(DISTINCT region, '; ' ORDER BY region) AS regions FROM expenditures WHERE region IS NOT NULL GROUP BY city")
bridged("sql_exclude", "SELECT * EXCLUDE (source) FROM agency_map ORDER BY canonical LIMIT 1000000")
bridged("sql_int_division", "SELECT line_id, fiscal_year // 10 AS decade FROM expenditures WHERE fiscal_year IS NOT NULL")
bridged("sql_distinct_on", "SELECT DISTINCT ON (city, fund) city, fund, line_id FROM expenditures WHERE fund IS NOT NULL ORDER BY city, fund, line_id DESC")
bridged("sql_null_order", "SELECT line_id, rank() OVER (PARTITION BY city ORDER BY region, line_id) AS place FROM expenditures")
bridged("sql_cte_union", "WITH a AS (SELECT city, sum(extended_amount) AS s FROM expenditures GROUP BY 1), b AS (SELECT city, sum(YTD_Total) AS s FROM salary_data GROUP BY ALL) SELECT city, 'ledger' AS kind, round(s * 100, 0) / 100 AS total FROM a UNION SELECT city, 'salaries', round(s * 100, 0) / 100 FROM b WHERE s > 0")
bridged("sql_filter_having", "SELECT city, count(*) FILTER (WHERE extended_amount < 0) AS negatives, count(*) AS n FROM expenditures GROUP BY city HAVING n > 1")
bridged("sql_quoted_names", 'SELECT "city", count(DISTINCT "Department") AS "Departments", max("YTD_Total") AS "top" FROM "salary_data" GROUP BY "city"')
bridged("sql_nested_qualify", "SELECT city, count(*) AS n, sum(extended_amount) AS s FROM (SELECT city, extended_amount FROM expenditures WHERE extended_amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY city ORDER BY extended_amount DESC, line_id) <= 3) q GROUP BY city")
bridged("sql_nested_distinct_on", "SELECT city, count(*) AS n FROM (SELECT DISTINCT ON (city, fund) city, fund, line_id FROM expenditures WHERE fund IS NOT NULL ORDER BY city, fund, line_id) q GROUP BY city")
bridged("sql_alias_in_where", "SELECT line_id, fiscal_year - 2000 AS since FROM expenditures WHERE since > 20")
bridged("sql_rename", "SELECT * RENAME (source AS typed, canonical AS listed) FROM agency_map")
bridged("sql_except", "SELECT payee AS name FROM expenditures WHERE payee IS NOT NULL EXCEPT SELECT payee_canonical FROM expenditures")
