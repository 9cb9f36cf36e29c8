"""How complete the newest years are."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fiscal_year_end(year: int, start_month: int = 1) -> dt.date:
    """Last day of a fiscal year that starts in ``start_month``."""
    return dt.date(year, 12, 31) if start_month == 1 else dt.date(year, start_month, 1) - dt.timedelta(days=1)


@dataclass(frozen=True)
class YearFacts:
    newest: int
    partial: bool
    covered_through: str | None
    last_complete: int

    @property
    def in_progress(self) -> int | None:
        return self.newest if self.partial else None

    def fact(self) -> str:
        if self.partial:
            loaded = f" (loaded through {self.covered_through})" if self.covered_through else ""
            return f"Data of fiscal year {self.newest} is incomplete{loaded}; FY{self.last_complete} is the last complete one."
        return f"FY{self.newest} is the most recent fiscal year and its data is complete."


def year_facts(newest: int, start_month: int = 1, covered=None, grace_days: int = 7, today: dt.date | None = None) -> YearFacts:
    """A year is complete if it is over and its payments run to within ``grace_days`` of its end; unknown cover is partial."""
    text = str(covered)[:10] if covered is not None else ""
    through = text if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else None
    end = fiscal_year_end(newest, start_month)
    over = (today or dt.date.today()) > end
    partial = through is None or not over or through < (end - dt.timedelta(days=grace_days)).isoformat()
    return YearFacts(newest, partial, through, newest - 1 if partial else newest)


def salary_facts(newest: int, prior: int | None) -> YearFacts | None:
    """The newest year of year-to-date totals is always partial; without a loaded earlier one nothing is said."""
    return None if prior is None else YearFacts(newest, True, None, prior)


def year_context(spark: SparkSession, start_month: int = 1, today: dt.date | None = None, *, ledger: str = "expenditures", year: str = "fiscal_year", paid: str = "payment_date", salaries: str = "salary_data", salary_year: str = "CalYear") -> dict:
    """Years of the ledger and the salaries; raises if the ledger has none.

    ``salary_state``: ok, no_table, no_years, single_year, or error if the table can't be asked.
    """
    e = spark.table(ledger)
    span = e.agg(F.min(year).alias("lo"), F.max(year).alias("hi")).first()
    if span["hi"] is None:
        raise ValueError("the ledger has no fiscal years")
    through = e.where(F.col(year) == span["hi"]).agg(F.max(F.col(paid).cast("string")).alias("d")).first()["d"]
    facts = year_facts(int(span["hi"]), start_month, through, today=today)
    out = {"first": int(span["lo"]), "newest": facts.newest, "in_progress": facts.in_progress, "last_complete": facts.last_complete, "facts": [facts.fact()], "salary": None}
    if not spark.catalog.tableExists(salaries):
        return out | {"salary_state": "no_table"}
    try:
        s: DataFrame = spark.table(salaries)
        top = s.agg(F.max(salary_year).alias("y")).first()["y"]
        below = s.where(F.col(salary_year) < F.lit(top)).agg(F.max(salary_year).alias("y")).first()["y"] if top is not None else None
    except AnalysisException:
        return out | {"salary_state": "error"}
    if top is None:
        return out | {"salary_state": "no_years"}
    if below is None:
        return out | {"salary_state": "single_year"}
    return out | {"salary_state": "ok", "salary": salary_facts(int(top), int(below))}
