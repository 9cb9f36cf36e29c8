"""Queries of the general data problems: schema drift (p2) and load profiles (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallyforge.operators import schema_drift
from tallyforge.operators.column_profile import ColumnRule, findings, footers, load_profile, value_counts
from tallyforge.session import table

FUND_FORM = r"\A[0-9]{4} - [A-Z][A-Za-z ]*[A-Za-z]\z"
LEDGER_RULES = [
    ColumnRule("fund", missing_rise=0.1003, pattern=FUND_FORM, pattern_share=0.0203, distinct_factor=1.503, shift=0.5003),
    ColumnRule("agency_canonical", missing_rise=0.1003, distinct_factor=1.503, shift=0.5003),
]
SALARY_RULES = [ColumnRule("CalYear", missing_rise=0.1003, low=2000, distinct_factor=1.503)]


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Every change of fields from file to file of each feed."""
    return schema_drift.changes(table(spark, base, "ledger_files")).select("feed", "file_name", "change", "field_from", "field_to").distinct()


def p2_ledger(spark: SparkSession, base: str) -> DataFrame:
    """All yearly files as one consistent ledger."""
    return schema_drift.unify(table(spark, base, "ledger_files"), ["raw_id", "feed", "file_seq", "line_no"])


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Loads in which a profiled column goes wrong or changes."""
    a = findings(spark, f"{base}/expenditures.parquet", "expenditures", LEDGER_RULES)
    return a.unionByName(findings(spark, f"{base}/salary_data.parquet", "salary_data", SALARY_RULES)).distinct()


def _profiles(spark: SparkSession, base: str) -> DataFrame:
    """The profile of each column in each load; ``low`` and ``high`` are by number for number columns, else by code point."""
    out = None
    for name, rules in (("expenditures", LEDGER_RULES), ("salary_data", SALARY_RULES)):
        kinds = table(spark, base, name).schema
        for r in rules:
            prof = load_profile(value_counts(spark, f"{base}/{name}.parquet", "load_id", "city", "loaded_at", r.column), r)
            low, high = ("low", "high") if isinstance(kinds[r.column].dataType, IntegralType) else ("first", "last")
            part = prof.select(F.lit(name).alias("table_name"), "load_id", F.lit(r.column).alias("column_name"), "n_rows", "n_missing", "n_distinct", "n_odd", "n_out", F.col(low).cast("string").alias("low"), F.col(high).cast("string").alias("high"))
            out = part if out is None else out.unionByName(part)
    return out


def p4_profile(spark: SparkSession, base: str) -> DataFrame:
    """The profile itself: rows, missing, distinct, odd and out-of-range values of each column in each load."""
    return _profiles(spark, base).drop("low", "high")


def p4_ranges(spark: SparkSession, base: str) -> DataFrame:
    """The same profile with the range of each column in each load."""
    return _profiles(spark, base)


def p4_footers(spark: SparkSession, base: str) -> DataFrame:
    """Null counts and extrema per column of whole tables, from the footers alone."""
    parts = []
    for name, cols in (("expenditures", ["load_id", "fiscal_year"]), ("salary_data", ["load_id", "CalYear"])):
        f = footers(spark, f"{base}/{name}.parquet", cols)
        parts.append(
            f.groupBy(F.lit(name).alias("table_name"), F.col("column").alias("column_name")).agg(
                F.sum("n_rows").alias("n_rows"),
                F.when(F.bool_and("exact"), F.sum("nulls")).alias("n_null"),
                F.min(F.expr("try_cast(low AS BIGINT)")).alias("low"),
                F.max(F.expr("try_cast(high AS BIGINT)")).alias("high"),
            )
        )
    return parts[0].unionByName(parts[1])


def _counts_sql(table: str, column: str) -> str:
    return f"SELECT '{table}' AS t, '{column}' AS c, city, load_id, year(loaded_at) AS y, CAST({column} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE load_id IS NOT NULL GROUP BY ALL"


_COUNTS = " UNION ALL ".join(f"({_counts_sql(t, c)})" for t, c in (("expenditures", "fund"), ("expenditures", "agency_canonical"), ("salary_data", "CalYear")))
_PROFILE = f"""
cnt AS ({_COUNTS}),
cl AS (SELECT *, v IS NULL OR regexp_full_match(v, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]*') AS miss FROM cnt),
prof AS (SELECT t, c, city, load_id, sum(n) AS nr, coalesce(sum(n) FILTER (miss), 0) AS nm, count(DISTINCT v) FILTER (NOT miss) AS nd,
  coalesce(sum(n) FILTER (NOT miss AND c = 'fund' AND NOT regexp_full_match(v, '[0-9]{{4}} - [A-Z][A-Za-z ]*[A-Za-z]')), 0) AS n_odd,
  coalesce(sum(n) FILTER (NOT miss AND c = 'CalYear' AND (TRY_CAST(v AS BIGINT) < 2000 OR TRY_CAST(v AS BIGINT) > y)), 0) AS n_out
  FROM cl GROUP BY 1, 2, 3, 4)"""

P4_FOUND_SQL = f"""WITH {_PROFILE},
b AS (SELECT *, lag(load_id) OVER w AS pl, lag(nr) OVER w AS pr, lag(nm) OVER w AS pm, lag(nd) OVER w AS pd, lead(load_id) OVER w AS nx FROM prof WINDOW w AS (PARTITION BY t, c, city ORDER BY load_id)),
sh AS (SELECT cl.t, cl.c, cl.city, cl.load_id, b.nx, cl.v, sum(cl.n) / max(b.nr - b.nm) AS s FROM cl JOIN b ON cl.t = b.t AND cl.c = b.c AND cl.load_id = b.load_id AND cl.city IS NOT DISTINCT FROM b.city WHERE NOT cl.miss AND cl.c <> 'CalYear' GROUP BY 1, 2, 3, 4, 5, 6),
dv AS (SELECT t, c, city, l, v, sum(d) AS d FROM (SELECT t, c, city, load_id AS l, v, s AS d FROM sh UNION ALL SELECT t, c, city, nx, v, -s FROM sh WHERE nx IS NOT NULL) GROUP BY 1, 2, 3, 4, 5),
di AS (SELECT t, c, city, l, sum(abs(d)) / 2 AS dist FROM dv GROUP BY 1, 2, 3, 4),
f AS (SELECT b.*, dist FROM b LEFT JOIN di ON b.t = di.t AND b.c = di.c AND b.load_id = di.l AND b.city IS NOT DISTINCT FROM di.city)
SELECT DISTINCT t AS table_name, load_id, c AS column_name, finding FROM (
  SELECT t, load_id, c, 'missing' AS finding FROM f WHERE pl IS NOT NULL AND nm / nr - pm / pr > 0.1003
  UNION ALL SELECT t, load_id, c, 'pattern' FROM f WHERE c = 'fund' AND nr > nm AND n_odd > 0.0203 * (nr - nm)
  UNION ALL SELECT t, load_id, c, 'range' FROM f WHERE n_out > 0
  UNION ALL SELECT t, load_id, c, 'distinct' FROM f WHERE pl IS NOT NULL AND pr > pm AND nd > 1.503 * pd AND nd - pd >= 3
  UNION ALL SELECT t, load_id, c, 'shift' FROM f WHERE c <> 'CalYear' AND pl IS NOT NULL AND nr > nm AND pr > pm AND dist > 0.5003)"""

P4_PROFILE_SQL = f"""WITH {_PROFILE}
SELECT t AS table_name, load_id, c AS column_name, CAST(nr AS BIGINT) AS n_rows, CAST(nm AS BIGINT) AS n_missing, CAST(nd AS BIGINT) AS n_distinct, CAST(n_odd AS BIGINT) AS n_odd, CAST(n_out AS BIGINT) AS n_out FROM prof"""

P4_FOOTERS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_null, CAST(min({c}) AS BIGINT) AS low, CAST(max({c}) AS BIGINT) AS high FROM {t}"
    for t, c in (("expenditures", "load_id"), ("expenditures", "fiscal_year"), ("salary_data", "load_id"), ("salary_data", "CalYear"))
)

QUERIES = {"p2_found": p2_found, "p2_ledger": p2_ledger, "p4_found": p4_found, "p4_profile": p4_profile, "p4_ranges": p4_ranges, "p4_footers": p4_footers}
ORACLES = {"p4_found": P4_FOUND_SQL, "p4_profile": P4_PROFILE_SQL, "p4_footers": P4_FOOTERS_SQL}
