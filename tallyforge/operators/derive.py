"""Derived columns of the ledger: canonical names and data-quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many prefixes are compiled into one expression; more are joined by prefix length.
MAX_COMPILED_PREFIXES = 200
#: So many prefixes are taken to the driver; more are an error.
MAX_PREFIXES = 100_000


def prefix_rows(chains: DataFrame) -> list[tuple[str, str]]:
    """(prefix, canonical) of a prefix map in file order, at most ``MAX_PREFIXES`` of them (checked)."""
    rows = chains.select("prefix", "canonical").limit(MAX_PREFIXES + 1).collect()
    if len(rows) > MAX_PREFIXES:
        raise ValueError(f"more than {MAX_PREFIXES} prefixes; label in parts")
    return [(r["prefix"], r["canonical"]) for r in rows if r["prefix"] is not None]


def dedupe_map(pairs: list[tuple[str, str]], case_insensitive: bool) -> list[tuple[str, str]]:
    """Entries of a map file in file order: of equal keys the last counts, of keys equal but for case the first."""
    last = dict(pairs)
    if not case_insensitive:
        return list(last.items())
    folded: dict[str, str] = {}
    for k, v in last.items():
        folded.setdefault(k.upper(), v)
    return list(folded.items())


def canonicalize(df: DataFrame, source: str, target: str, exact: DataFrame | None = None, prefixes: list[tuple[str, str]] = (), *, on: list[str] = (), case_insensitive: bool = False) -> DataFrame:
    """``target`` = exact entry of ``source``, else its first prefix entry in file order, else ``source`` itself.

    ``exact`` has the columns ``source`` and ``canonical`` (and ``on``, columns that must be equal too); its keys are
    made unique before the join, so rows never multiply.  Null stays null.
    """
    fold = (lambda c: F.upper(c)) if case_insensitive else (lambda c: c)
    hit: Column = F.lit(None).cast("string")
    out = df
    if exact is not None:
        keys = exact.where("source IS NOT NULL AND canonical IS NOT NULL").select(*[F.col(c).alias(f"_on_{c}") for c in on], fold(F.col("source")).alias("_key"), F.col("canonical").alias("_exact"))
        keys = keys.groupBy(*[f"_on_{c}" for c in on], "_key").agg(F.min("_exact").alias("_exact"))
        cond = fold(F.col(source)) == F.col("_key")
        for c in on:
            cond = cond & (F.col(c) == F.col(f"_on_{c}"))
        out = out.join(keys, cond, "left").drop("_key", *[f"_on_{c}" for c in on])
        hit = F.col("_exact")
    if len(prefixes) <= MAX_COMPILED_PREFIXES:
        chain = None
        for p, label in prefixes:
            cond = fold(F.col(source)).startswith(p.upper() if case_insensitive else p)
            chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))
        found = chain if chain is not None else F.lit(None).cast("string")
        out = out.withColumn(target, F.coalesce(hit, found, F.col(source)))
    else:
        out = _by_prefix_join(out.withColumn("_hit", hit), source, target, list(prefixes), fold, case_insensitive)
    return out.drop("_exact")


def _by_prefix_join(df: DataFrame, source: str, target: str, prefixes: list, fold, case_insensitive: bool) -> DataFrame:
    rows = [(p.upper() if case_insensitive else p, label, k) for k, (p, label) in enumerate(prefixes)]
    table = df.sparkSession.createDataFrame(rows, "_p string, _label string, _order int")
    lengths = sorted({len(p) for p, _, _ in rows})
    values = df.select(F.col(source).alias("_v")).where("_v IS NOT NULL").distinct()
    probes = values.select("_v", F.explode(F.array(*[F.substring(fold(F.col("_v")), 1, n) for n in lengths])).alias("_p")).distinct()
    won = probes.join(table, "_p").groupBy("_v").agg(F.min_by("_label", "_order").alias("_label"))
    return df.join(won, F.col(source) == F.col("_v"), "left").withColumn(target, F.coalesce("_hit", "_label", F.col(source))).drop("_v", "_label", "_hit")


def distinct_before_after(df: DataFrame, source: str, target: str) -> DataFrame:
    """How many names the canonicalization left: distinct values of both columns, nulls apart."""
    return df.agg(F.count_distinct(source).alias("n_source"), F.count_distinct(target).alias("n_target"))


def _flag(df: DataFrame, keys: DataFrame, on: list[str], flag: str, extra: Column | None = None) -> DataFrame:
    """``flag`` is true for rows whose key is in ``keys``; a null in the key matches nothing."""
    marked = keys.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], F.lit(True).alias("_hit"))
    cond = None
    for i, k in enumerate(on):
        c = F.col(k) == F.col(f"_k{i}")
        cond = c if cond is None else cond & c
    out = df.join(marked, cond, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return out.withColumn(flag, hit & extra if extra is not None else hit).drop("_hit", *[f"_k{i}" for i in range(len(on))])


def flag_offsetting(df: DataFrame, on: list[str], amount: str, flag: str = "is_offsetting", tolerance: float = 0.01) -> DataFrame:
    """Marks every row of a key whose non-null amounts, two or more, add up to nothing."""
    groups = df.where(F.col(amount).isNotNull()).groupBy(*on).agg(F.sum(amount).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return _flag(df, groups.where((F.abs("_s") < tolerance) & (F.col("_n") > 1)), on, flag)


def flag_artifacts(df: DataFrame, on: list[str], amount: str, threshold: float, flag: str = "is_data_artifact") -> DataFrame:
    """Marks very large amounts of a key whose sum is smaller than its largest amount: entries taken back in part."""
    groups = df.groupBy(*on).agg(F.sum(amount).alias("_s"), F.max(amount).alias("_m"))
    large = F.coalesce(F.abs(F.col(amount)) > threshold, F.lit(False))
    return _flag(df, groups.where(F.abs("_s") < F.abs("_m")), on, flag, large)
