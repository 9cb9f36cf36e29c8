"""What tables hold, as profiles and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENUM_MOST = 12


def _as_text(c: Column, kind: T.DataType) -> Column:
    """A text for each value that only equal values share."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)  # no negative zero
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.BinaryType):
        c = F.hex(c)
    return c.cast("string")


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n_rows, n_null, n_distinct, low, high) of every column.

    One pass has counts and extrema, a second the distinct values of all columns as (column, text) pairs: their groups are
    hashed, which many distinct aggregates in one query are not.
    """
    cols = [f for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(cols):
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"f{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"f{i}")).alias("n_null"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, f in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), _as_text(F.col(f"`{f.name}`"), f.dataType).alias("v")) for i, f in enumerate(cols)])
    n = df.select(F.explode(pairs).alias("p")).select("p.i", "p.v").where("v IS NOT NULL").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    out = one.select(F.explode(rows).alias("p")).select("p.*").join(n, "i", "left")
    return out.select("column", "type", "n_rows", "n_null", F.coalesce("d", F.lit(0)).cast("long").alias("n_distinct"), "low", "high")


def values_of(df: DataFrame, column: str, n: int) -> list[str]:
    """The first ``n`` distinct values in order."""
    c = F.col(f"`{column}`")
    return [str(r[0]) for r in df.where(c.isNotNull()).select(c.cast("string")).distinct().orderBy(F.col(df.select(c.cast("string")).columns[0]).asc()).limit(n).collect()]


def compact(tables: dict[str, DataFrame]) -> str:
    """Tables, columns and types; text columns of few values with their values. Helper tables (``_``) are left out."""
    out = []
    for name in sorted(t for t in tables if not t.startswith("_")):
        df = tables[name]
        rows = {r["column"]: r for r in profile(df).collect()}
        parts = []
        for f in df.schema:
            r = rows.get(f.name)
            text = f"{f.name} {f.dataType.simpleString()}"
            if r is not None and f.dataType.simpleString() == "string" and 1 <= r["n_distinct"] <= ENUM_MOST:
                text += " [" + ", ".join(values_of(df, f.name, ENUM_MOST)) + "]"
            parts.append(text)
        out.append(f"{name}({next(iter(rows.values()))['n_rows'] if rows else 0} rows): " + "; ".join(parts))
    return "\n".join(out)


def full(tables: dict[str, DataFrame]) -> str:
    """Tables with, per column, type, distinct count, range and samples."""
    out = []
    for name in sorted(t for t in tables if not t.startswith("_")):
        df = tables[name]
        prof = profile(df).collect()
        out.append(f"## {name}: {prof[0]['n_rows'] if prof else 0} rows")
        for r in prof:
            sample = ", ".join(values_of(df, r["column"], 5)) if r["type"] == "string" else ""
            out.append(f"- {r['column']} ({r['type']}): {r['n_distinct']} distinct, {r['n_null']} null, {r['low']} .. {r['high']}" + (f"; e.g. {sample}" if sample else ""))
    return "\n".join(out)


def single(df: DataFrame, name: str = "data") -> str:
    """One table with range and mean of its numbers and three sample rows."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    means = df.agg(*[F.avg(f"`{c}`").alias(c) for c in numbers]).first() if numbers else {}
    lines = [full({name: df})] + [f"- mean of {c}: {means[c]:,.2f}" for c in numbers if means[c] is not None]
    return "\n".join([*lines, *(str(r.asDict()) for r in df.limit(3).collect())])


def dictionary(labels: dict[str, dict[str, str]]) -> str:
    """A data dictionary in Markdown."""
    return "\n\n".join(f"## {t}\n\n| column | label |\n|-|-|\n" + "\n".join(f"| {c} | {x} |" for c, x in cols.items()) for t, cols in labels.items())
