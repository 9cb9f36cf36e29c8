"""Column-level quality profile of loads.

The counts of values per load come from two places, the cheaper that is exact:

1. the footers: a row group of one load whose column is all null, or whose integer minimum and maximum are equal, has
   its value counts in its footer, and its file isn't read when all its chunks are like that;
2. the data: every other file is scanned whole and its values are counted per load, with a map-side aggregation, so
   one hot load never meets in one task.  No dictionary page is read for distinct candidates, one row group that doesn't
   suffice has its whole file scanned, and null counts of text columns in footers aren't used.

Everything else (patterns, ranges, shares) is computed on the distinct values with their counts, not on rows.

Defined results: a value is missing if null, empty or blank (any Unicode white space); repeated rows count as often as
they come; an empty table gives an empty profile; a load without a load id has no place in the order and is left out;
columns not named are not read, so extra columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOOTER_SCHEMA = "file string, row_group int, n_rows long, column string, nulls long, low string, high string, exact boolean, is_int boolean"
INT_TYPES = ("INT32", "INT64")


@dataclass(frozen=True)
class ColumnRule:
    """What is looked for in one column; None switches a finding off. Shares and factors must be exceeded."""

    column: str
    missing_rise: float | None = None
    pattern: str | None = None
    pattern_share: float = 0.0
    low: int | None = None
    distinct_factor: float | None = None
    distinct_least: int = 3
    shift: float | None = None


def footers(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row per file, row group and column: row count, exact null count and extrema as the footer states them.

    ``exact`` is false where the footer has no null count or no extrema though there are values.
    """
    files = spark.read.parquet(path).inputFiles()

    def read(frames):
        import pandas as pd

        for pdf in frames:
            rows = [r for f in pdf["file"] for r in _footer(f, columns)]
            yield pd.DataFrame(rows, columns=["file", "row_group", "n_rows", "column", "nulls", "low", "high", "exact", "is_int"])

    paths = spark.createDataFrame([(f,) for f in files], "file string")
    return paths.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(read, FOOTER_SCHEMA)


def _footer(file: str, columns: list[str]):
    import pyarrow.parquet as pq
    from pyarrow import fs
    from urllib.parse import unquote

    where, inner = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), unquote(file.removeprefix("file:")))
    with where.open_input_file(unquote(inner)) as f:
        meta = pq.read_metadata(f)
    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for name in columns:
            if name not in at:
                yield file, g, group.num_rows, name, group.num_rows, None, None, True, False
                continue
            c = group.column(at[name])
            s = c.statistics
            is_int = c.physical_type in INT_TYPES and str(meta.schema.column(at[name]).logical_type.type) in ("NONE", "INT")
            if s is None or not s.has_null_count:
                yield file, g, group.num_rows, name, None, None, None, False, is_int
            elif s.null_count == group.num_rows:
                yield file, g, group.num_rows, name, s.null_count, None, None, True, is_int
            elif not s.has_min_max:
                yield file, g, group.num_rows, name, s.null_count, None, None, False, is_int
            else:
                text = [x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x) for x in (s.min, s.max)]
                yield file, g, group.num_rows, name, s.null_count, *text, True, is_int


def footer_counts(stats: DataFrame, load: str, others: list[str], column: str) -> tuple[DataFrame, list[str]]:
    """Value counts (load columns, value, n) of the files whose footers suffice for ``column``, and those files.

    A file suffices if in each row group the load and the columns in ``others`` hold one value and no null, and
    ``column`` is all null or an integer with equal extrema.
    """
    keys = [load, *others]
    one = (F.col("nulls") == 0) & F.col("exact") & (F.col("low") == F.col("high")) & (F.length("low") < 64)
    known = F.col("exact") & ((F.col("nulls") == F.col("n_rows")) | (F.col("is_int") & (F.col("low") == F.col("high"))))
    chunk = stats.groupBy("file", "row_group").agg(
        F.bool_and(F.when(F.col("column") == column, known).otherwise(F.when(F.col("column").isin(keys), one).otherwise(True))).alias("ok"),
        *[F.max(F.when(F.col("column") == k, F.col("low"))).alias(k) for k in keys],
        F.max(F.when(F.col("column") == column, F.col("low"))).alias("value"),
        F.max(F.when(F.col("column") == column, F.col("nulls"))).alias("nulls"),
        F.max("n_rows").alias("n_rows"),
    )
    whole = [r["file"] for r in chunk.groupBy("file").agg(F.bool_and("ok").alias("ok")).where("ok").select("file").collect()]
    if not whole:
        return chunk.where("false").select(*keys, F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n")), []
    part = chunk.where(F.col("file").isin(whole))
    pairs = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("value"), F.col("nulls").alias("n")), F.struct("value", (F.col("n_rows") - F.col("nulls")).alias("n"))))
    return part.select(*keys, pairs.alias("p")).select(*keys, "p.value", "p.n").where("n > 0"), whole


def is_missing(value: Column) -> Column:
    """Null, empty or blank; characters that only look like white space (no-break spaces) count as blank."""
    return value.isNull() | value.rlike(r"(?U)\A\s*\z")


def value_counts(spark: SparkSession, path: str, load: str, city: str, loaded_at: str, column: str) -> DataFrame:
    """(load_id, city, year, value, n) of one column, read from footers where they suffice and else from the data."""
    stats = footers(spark, path, [load, city, loaded_at, column])
    known, skip = footer_counts(stats, load, [city, loaded_at], column)
    data = spark.read.parquet(path)
    if skip:
        rest = [f for f in data.inputFiles() if f not in set(skip)]
        data = spark.read.schema(data.schema).parquet(*rest) if rest else data.where("false")
    scanned = (
        data.where(F.col(load).isNotNull())
        .groupBy(F.col(load).cast("long").alias("load_id"), F.col(city).alias("city"), F.year(loaded_at).alias("year"), F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not skip:
        return scanned
    known = known.select(F.col(load).cast("long").alias("load_id"), F.col(city).alias("city"), F.year(F.to_timestamp(loaded_at)).alias("year"), "value", "n")
    return scanned.unionByName(known).groupBy("load_id", "city", "year", "value").agg(F.sum("n").alias("n"))


def load_profile(counts: DataFrame, rule: ColumnRule) -> DataFrame:
    """One row per load of a column's value counts: rows, missing, distinct, values out of range and out of pattern, range as numbers and as texts."""
    c = counts.withColumn("miss", is_missing(F.col("value")))
    number = F.expr("try_cast(value AS BIGINT)")
    odd = ~F.col("miss") & ~F.col("value").rlike(rule.pattern) if rule.pattern else F.lit(False)
    out = ~F.col("miss") & ((number < rule.low) | (number > F.col("year"))) if rule.low is not None else F.lit(False)
    return c.groupBy("city", "load_id").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("miss"), F.col("n")).otherwise(0)).alias("n_missing"),
        F.count_distinct(F.when(~F.col("miss"), F.col("value"))).alias("n_distinct"),
        F.sum(F.when(odd, F.col("n")).otherwise(0)).alias("n_odd"),
        F.sum(F.when(out, F.col("n")).otherwise(0)).alias("n_out"),
        F.min(F.when(~F.col("miss"), number)).alias("low"),
        F.max(F.when(~F.col("miss"), number)).alias("high"),
        F.min(F.when(~F.col("miss"), F.col("value"))).alias("first"),
        F.max(F.when(~F.col("miss"), F.col("value"))).alias("last"),
    )


def with_before(profile: DataFrame) -> DataFrame:
    """Each load beside the one of the same city with the next lower load id (``before`` is null for a first load)."""
    w = Window.partitionBy("city").orderBy("load_id")
    cols = ["load_id", "n_rows", "n_missing", "n_distinct"]
    return profile.select("*", *[F.lag(c).over(w).alias(f"before_{c}") for c in cols])


def shifts(counts: DataFrame, loads: DataFrame) -> DataFrame:
    """(city, load_id, distance): half the sum of the absolute differences of value shares against the load before.

    Each count is used twice, as its own load's and as the next load's "before", so one aggregation over (load, value)
    replaces a full outer join of neighbouring loads.
    """
    w = Window.partitionBy("city").orderBy("load_id")
    near = loads.select("city", "load_id", (F.col("n_rows") - F.col("n_missing")).alias("total"), F.lead("load_id").over(w).alias("next_load"))
    c = counts.where(~is_missing(F.col("value"))).groupBy("city", "load_id", "value").agg(F.sum("n").alias("n"))
    share = c.join(near, (c["load_id"] == near["load_id"]) & c["city"].eqNullSafe(near["city"])).select(
        c["city"], c["load_id"], "next_load", "value", (F.col("n") / F.col("total")).alias("share")
    )
    both = share.select(
        "city",
        "value",
        F.explode(F.array(F.struct(F.col("load_id").alias("at"), F.col("share").alias("d")), F.struct(F.col("next_load").alias("at"), (-F.col("share")).alias("d")))).alias("x"),
    ).where("x.at IS NOT NULL")
    per_value = both.groupBy("city", F.col("x.at").alias("load_id"), "value").agg(F.sum("x.d").alias("d"))
    return per_value.groupBy("city", "load_id").agg((F.sum(F.abs("d")) / 2).alias("distance"))


def findings(spark: SparkSession, path: str, table_name: str, rules: list[ColumnRule], *, load: str = "load_id", city: str = "city", loaded_at: str = "loaded_at") -> DataFrame:
    """(table_name, load_id, column_name, finding) of every load in which a column goes wrong or changes."""
    out = None
    for r in rules:
        counts = value_counts(spark, path, load, city, loaded_at, r.column)
        prof = load_profile(counts, r)
        b = with_before(prof)
        had = F.col("before_load_id").isNotNull()
        filled, before_filled = F.col("n_rows") - F.col("n_missing"), F.col("before_n_rows") - F.col("before_n_missing")
        tests = []
        if r.missing_rise is not None:
            tests.append(("missing", had & (F.col("n_missing") / F.col("n_rows") - F.col("before_n_missing") / F.col("before_n_rows") > r.missing_rise)))
        if r.pattern:
            tests.append(("pattern", (filled > 0) & (F.col("n_odd") > r.pattern_share * filled)))
        if r.low is not None:
            tests.append(("range", F.col("n_out") > 0))
        if r.distinct_factor is not None:
            tests.append(("distinct", had & (before_filled > 0) & (F.col("n_distinct") > r.distinct_factor * F.col("before_n_distinct")) & (F.col("n_distinct") - F.col("before_n_distinct") >= r.distinct_least)))
        if r.shift is not None:
            d = shifts(counts, prof)
            b = b.join(d, (b["load_id"] == d["load_id"]) & b["city"].eqNullSafe(d["city"]), "left").drop(d["load_id"]).drop(d["city"])
            tests.append(("shift", had & (filled > 0) & (before_filled > 0) & (F.col("distance") > r.shift)))
        marks = F.array(*[F.when(cond, F.lit(name)) for name, cond in tests])
        part = b.select(F.lit(table_name).alias("table_name"), "load_id", F.lit(r.column).alias("column_name"), F.explode(F.array_compact(marks)).alias("finding"))
        out = part if out is None else out.unionByName(part)
    return out
