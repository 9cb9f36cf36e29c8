"""The ledger as a property graph: node and edge DataFrames with totals and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import round2

#: Node label -> ledger column; edge name -> (source label, target label, whether payments are counted).
NODES = {"Agency": "agency_canonical", "Payee": "payee", "Fund": "fund", "Category": "expenditure_category", "Project": "project", "Year": "fiscal_year"}
EDGES = {"PAID": ("Agency", "Payee", True), "FUNDED_BY": ("Agency", "Fund", True), "SPENT_ON": ("Agency", "Category", True), "RAN": ("Agency", "Project", True), "PAID_FOR": ("Payee", "Project", True), "HAD_SPENDING": ("Agency", "Year", False)}


def _money():
    return round2(F.coalesce(F.sum("extended_amount"), F.lit(0.0)))


def nodes(ledger: DataFrame, label: str, top: int | None = None) -> DataFrame:
    """(label, id, total, count) of one kind of node; ``top`` keeps the heaviest of a kind where the graph is a view of these."""
    c = NODES[label]
    n = ledger.where(F.col(c).isNotNull()).groupBy(F.lit(label).alias("label"), F.col(c).cast("string").alias("id")).agg(_money().alias("total"), F.count(F.lit(1)).alias("count"))
    return n.orderBy(F.desc("total"), "id").limit(top) if top else n


def edges(ledger: DataFrame, name: str, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(edge, src, dst, total, count); an edge whose ends aren't both nodes vanishes."""
    a, b, counted = EDGES[name]
    ca, cb = NODES[a], NODES[b]
    e = ledger.where(F.col(ca).isNotNull() & F.col(cb).isNotNull()).groupBy(F.lit(name).alias("edge"), F.col(ca).cast("string").alias("src"), F.col(cb).cast("string").alias("dst")).agg(_money().alias("total"), F.count(F.lit(1)).alias("count"))
    if not counted:
        e = e.withColumn("count", F.lit(None).cast("long"))
    for side, ends in (("src", sources), ("dst", targets)):
        if ends is not None:
            e = e.join(ends.select(F.col("id").alias(side)), side, "left_semi")
    return e.select("edge", "src", "dst", "total", "count")


def licensed_edges(payees: DataFrame, licences: DataFrame) -> DataFrame:
    """(edge, src, dst) from payees to their licences by name."""
    lic = licences.where("FULLNAME IS NOT NULL AND LICENSENO IS NOT NULL").select(F.lower(F.trim("FULLNAME")).alias("k"), F.col("LICENSENO").alias("dst")).distinct()
    return payees.join(lic, F.lower(F.trim("id")) == F.col("k")).select(F.lit("LICENSED").alias("edge"), F.col("id").alias("src"), "dst")


def write(ledger: DataFrame, folder: str, payees: int | None = None) -> None:
    """All nodes and edges as Parquet, one folder per kind; payees may be kept to the heaviest."""
    made = {label: nodes(ledger, label, payees if label == "Payee" else None) for label in NODES}
    for label, df in made.items():
        df.write.mode("overwrite").parquet(f"{folder}/nodes_{label}")
    for name, (a, b, _) in EDGES.items():
        edges(ledger, name, made[a], made[b]).write.mode("overwrite").parquet(f"{folder}/edges_{name}")
