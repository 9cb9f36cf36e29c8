"""A pack's data as a queryable catalog of views, in the order: ledger, canonical names, flags, enrichment, summaries."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tallyforge.operators import derive
from tallyforge.pack import Pack
from tallyforge.sources import files

LEDGER = "expenditures"


@dataclass
class Catalog:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    messages: list[str] = field(default_factory=list)

    def add(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def listing(self) -> list[str]:
        """Tables to show; helper tables begin with ``_``."""
        return sorted(t for t in self.tables if not t.startswith("_"))


def build(spark: SparkSession, pack: Pack, data_dir: str) -> Catalog:
    """All tables of a pack as views.  Everything is lazy; the ledger is cached, as all summaries read it."""
    cat = Catalog()
    ledger = files.load_sources(spark, pack.sources, data_dir)
    if ledger is not None:
        ledger = apply_maps(spark, pack, ledger)
        ledger = apply_flags(pack, ledger).cache()
        cat.add(LEDGER, ledger)
    for name, file in pack.enrichment.items():
        path = os.path.join(data_dir, file)
        if os.path.exists(path):
            cat.add(name, files.scan_csv(spark, [path]))
        else:
            cat.messages.append(f"{name}: no file {file}")
    for name, spec in pack.summaries.items():
        build_summary(spark, cat, name, spec)
    return cat


def apply_maps(spark: SparkSession, pack: Pack, ledger: DataFrame) -> DataFrame:
    for spec in pack.canonical:
        exact, ci = None, bool(spec.get("case_insensitive"))
        if spec.get("exact"):
            rows = derive.dedupe_map(pack.load_map(spec["exact"]), ci)
            exact = spark.createDataFrame(rows, "source string, canonical string")
        prefixes = pack.load_map(spec["prefix"]) if spec.get("prefix") else []
        ledger = derive.canonicalize(ledger, spec["source"], spec["target"], exact, prefixes, case_insensitive=ci)
    return ledger


def apply_flags(pack: Pack, ledger: DataFrame) -> DataFrame:
    if o := pack.flags.get("offsetting"):
        ledger = derive.flag_offsetting(ledger, o["keys"], pack.amount, tolerance=o.get("tolerance", 0.01))
    if a := pack.flags.get("artifact"):
        ledger = derive.flag_artifacts(ledger, a["keys"], pack.amount, a["threshold"])
    return ledger


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons that stand outside of literals and comments."""
    from tallyforge.functions.sqltext import blank_literals

    bare, out, at = blank_literals(sql), [], 0
    for k, c in enumerate(bare):
        if c == ";":
            out.append(sql[at:k])
            at = k + 1
    return [s.strip() for s in [*out, sql[at:]] if s.strip()]


def build_summary(spark: SparkSession, cat: Catalog, name: str, spec: dict) -> None:
    """Runs a summary's statements; helpers are ``name := statement`` in ``helpers``.  A failure is a message, not an error."""
    missing = [t for t in spec.get("requires", []) if t not in cat.tables]
    if missing:
        cat.messages.append(f"{name}: needs {', '.join(missing)}")
        return
    try:
        for helper, sql in (spec.get("helpers") or {}).items():
            cat.add(helper, spark.sql(sql))
        statements = split_statements(spec["sql"])
        for s in statements[:-1]:
            spark.sql(s)
        df = spark.sql(statements[-1]).cache()
        if df.isEmpty():
            cat.messages.append(f"{name}: no rows")
        cat.add(name, df)
    except (AnalysisException, ParseException, KeyError, IndexError) as e:
        cat.messages.append(f"{name}: {str(e).splitlines()[0]}")


def lock_down(spark: SparkSession) -> None:
    """After loading, SQL text can no longer scan files."""
    spark.conf.set("spark.sql.runSQLOnFiles", "false")


def single_csv(spark: SparkSession, path: str) -> DataFrame:
    """One CSV file as the view ``data``."""
    df = files.scan_csv(spark, [path])
    df.createOrReplaceTempView("data")
    return df
