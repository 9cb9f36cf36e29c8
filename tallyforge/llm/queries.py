"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import canonical, leakage, linkage, residue, variants
from tallyforge.llm.tokenize import encode_corpus
from tallyforge.session import table


def _agencies(spark: SparkSession, base: str) -> DataFrame:
    return canonical.map_values(table(spark, base, "agency_map"), id_col="map_id", group_col="city", value_col="source", entry_col="canonical")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """The listed agency of every unmapped spelling, and the chain of every line that pays one."""
    a = _agencies(spark, base).select(F.lit("agency").alias("field"), F.col("map_id").cast("long").alias("row_id"), "canonical")
    p = canonical.label_chains(table(spark, base, "expenditures"), table(spark, base, "payee_prefix_map"), id_col="line_id", value_col="payee")
    return a.unionByName(p.select(F.lit("payee").alias("field"), F.col("line_id").cast("long").alias("row_id"), "canonical"))


def p1_scores(spark: SparkSession, base: str) -> DataFrame:
    """Each unmapped agency spelling with its entry and score; unmatched ones are reported without a score."""
    return _agencies(spark, base)


def p3_matches(spark: SparkSession, base: str) -> DataFrame:
    """Every payee with the licences of its firm and a calibrated confidence."""
    return linkage.firm_licences(table(spark, base, "expenditures"), table(spark, base, "active_contractors"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """The same pairs without the confidence."""
    return p3_matches(spark, base).select("payee_canonical", "licenseno")


def _payee_variants(spark: SparkSession, base: str) -> DataFrame:
    payees = table(spark, base, "expenditures").select(F.lit("").alias("g"), F.col("payee").alias("v"))
    return variants.clusters(payees, "payee", chains=table(spark, base, "payee_prefix_map"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """All pairs of spellings of one payee, and of one body of a city where one of the two isn't mapped yet."""
    m = table(spark, base, "agency_map")
    known = m.where("canonical IS NOT NULL AND source IS NOT NULL").select(F.coalesce("city", F.lit("")).alias("g"), F.col("source").alias("a"), F.col("canonical").alias("b"))
    bodies = variants.clusters(m.select(F.col("city").alias("g"), F.col("source").alias("v")), "agency", known=known)
    mapped = m.select(F.coalesce("city", F.lit("")).alias("mg"), F.col("source").alias("mv"), F.col("canonical").isNull().alias("open")).hint("merge")  # its files are many times smaller than its rows
    bodies = bodies.join(mapped, (F.col("g") == F.col("mg")) & (F.col("v") == F.col("mv"))).select("g", "v", "component", "open")
    a = bodies.select("g", F.col("component").alias("ca"), F.col("v").alias("name_a"), F.col("open").alias("oa"))
    b = bodies.select(F.col("component").alias("cb"), F.col("v").alias("name_b"), F.col("open").alias("ob"))
    bodies = a.join(b, (F.col("ca") == F.col("cb")) & (F.col("name_a") < F.col("name_b")) & (F.col("oa") | F.col("ob"))).select(F.lit("agency").alias("field"), F.col("g").alias("city"), "name_a", "name_b")
    payees = variants.pairs_of(_payee_variants(spark, base)).select(F.lit("payee").alias("field"), F.lit("").alias("city"), "name_a", "name_b")
    return payees.unionByName(bodies).distinct()


def p5_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Each payee spelling that has variants, with its entity and the number of spellings of the entity."""
    c = _payee_variants(spark, base)
    n = c.groupBy("component").agg(F.count(F.lit(1)).alias("spellings"))
    return c.join(n, "component").select(F.col("v").alias("payee"), F.regexp_replace("component", "\u0001", "").alias("entity"), "spellings")


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, base, "documents"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with the evaluation items that they repeat."""
    return leakage.leaks(table(spark, base, "documents"), table(spark, base, "eval_items")).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, base: str) -> DataFrame:
    """These documents without the leaked spans."""
    return leakage.without_leaks(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with template residue, filler, error messages or script notices in place of content."""
    return residue.residue(table(spark, base, "documents"))


def p8_evidence(spark: SparkSession, base: str) -> DataFrame:
    """What was found in each of these documents, with copies and hosts of low-information bodies."""
    return residue.evidence(table(spark, base, "documents")).where("hit")


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p3_found": p3_found, "p3_matches": p3_matches, "p5_found": p5_found, "p5_clusters": p5_clusters, "p6_ids": p6_ids, "p7_found": p7_found, "p7_clean": p7_clean, "p8_found": p8_found, "p8_evidence": p8_evidence}
ORACLES: dict[str, str] = {}
