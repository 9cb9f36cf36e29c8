"""Files as DataFrames: finding them, scanning them by name, coercing and writing."""

from __future__ import annotations

import csv
import glob
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.columns import coerce_int, coerce_text, epoch_ms_date
from tallyforge.pack import Source

COERCIONS = {"int": coerce_int, "epoch_ms_date": epoch_ms_date, "text": coerce_text}


def source_files(source: Source, data_dir: str) -> list[tuple[int | None, str]]:
    """(year, path) of a source's files in order; missing years are skipped.

    A range of years needs ``{year}`` in the path; without one the path is taken as a name or pattern.
    """
    if source.years:
        if "{year}" not in source.path:
            raise ValueError(f"a range of years needs {{year}} in the path: {source.path}")
        first, last = source.years
        named = [(y, os.path.join(data_dir, source.path.format(year=y))) for y in range(first, last + 1)]
        return [(y, p) for y, p in named if os.path.exists(p)]
    return [(None, p) for p in sorted(glob.glob(os.path.join(data_dir, source.path)))]


def scan_csv(spark: SparkSession, paths: list[str], keep_zero_padded: bool = True) -> DataFrame:
    """CSV files with their own headers and inferred types, united by name; what a file lacks is null.

    Each file is scanned on its own: a scan of several files takes columns by position.  Columns with zero-padded
    numbers stay text, so codes keep their zeros.  A column whose types differ between files is text.
    """
    out: DataFrame | None = None
    for p in paths:
        df = spark.read.csv(p, header=True, inferSchema=True, quote='"', escape='"', multiLine=False)
        if keep_zero_padded:
            numeric = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long")]
            if numeric:
                raw = spark.read.csv(p, header=True, inferSchema=False, quote='"', escape='"')
                padded = raw.agg(*[F.max(F.col(_q(c)).rlike(r"^0\d+$")).alias(f"c{i}") for i, c in enumerate(numeric)]).first()
                text = {c for i, c in enumerate(numeric) if padded[f"c{i}"]}
                if text:
                    schema = ", ".join(f"{_q(f.name)} {'string' if f.name in text else f.dataType.simpleString()}" for f in df.schema)
                    df = spark.read.csv(p, header=True, schema=schema, quote='"', escape='"')
        out = df if out is None else union_by_name(out, df)
    if out is None:
        raise FileNotFoundError("no files to scan")
    return out


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by column name; what one lacks is null, differing types become text unless both are numbers."""
    numbers = ("integer", "long", "double")
    ta, tb = ({f.name: f.dataType.typeName() for f in d.schema} for d in (a, b))
    for c in set(ta) & set(tb):
        if ta[c] != tb[c]:
            kind = "double" if ta[c] in numbers and tb[c] in numbers and "double" in (ta[c], tb[c]) else "long" if ta[c] in numbers and tb[c] in numbers else "string"
            a, b = a.withColumn(c, F.col(_q(c)).cast(kind)), b.withColumn(c, F.col(_q(c)).cast(kind))
    return a.unionByName(b, allowMissingColumns=True)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames; identity entries and absent columns are skipped."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k != v and k in df.columns})


def coerce(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Columns by their rule (int, epoch_ms_date, text); unknown rules raise."""
    for c, rule in rules.items():
        if rule not in COERCIONS:
            raise ValueError(f"unknown coercion {rule!r} of {c}")
        if c in df.columns:
            df = df.withColumn(c, COERCIONS[rule](F.col(_q(c))))
    return df


def append(existing: DataFrame | None, new: DataFrame, source: Source) -> DataFrame:
    """``new`` under ``existing``: a union source may not bring unknown columns, a mapped source's extra columns go."""
    if existing is None:
        return new
    extra = [c for c in new.columns if c not in existing.columns]
    if extra and source.reader == "union":
        raise ValueError(f"columns the ledger doesn't have: {extra}")
    kinds = {f.name: f.dataType for f in existing.schema}
    cols = [F.col(_q(c)).try_cast(kinds[c]).alias(c) if c in new.columns else F.lit(None).cast(kinds[c]).alias(c) for c in existing.columns]
    return existing.unionByName(new.select(*cols))


def load_sources(spark: SparkSession, sources: list[Source], data_dir: str) -> DataFrame | None:
    """The ledger of all sources; the first source that has files sets its columns."""
    out: DataFrame | None = None
    for s in sources:
        if s.reader not in ("union", "mapped"):
            raise ValueError(f"unknown reader {s.reader!r}")
        paths = [p for _, p in source_files(s, data_dir)]
        if not paths:
            continue
        df = coerce(rename(scan_csv(spark, paths), s.rename).drop(*s.drop), s.coerce)
        out = append(out, df, s)
    return out


# ---- sinks ----


def write_single_file(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """One CSV or NDJSON file, in place at once: written beside its name and then renamed."""
    part = path + ".part"
    shutil.rmtree(part, ignore_errors=True)
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(part) if fmt == "csv" else writer.json(part)
    (made,) = glob.glob(os.path.join(part, "part-*"))
    os.replace(made, path)
    shutil.rmtree(part, ignore_errors=True)
    return path


def write_folder(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> str:
    """A folder of files; the commit protocol makes it appear whole.  The way for data of any size."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(path)
    return path


def write_map(path: str, rows: list[tuple[str, str]]) -> None:
    """A canonical map as a file to be reviewed: header, LF line ends."""
    with open(path + ".part", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(("source", "canonical"))
        w.writerows(rows)
    os.replace(path + ".part", path)


def keep_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns that there are, in the given order."""
    return df.select(*[_q(c) for c in columns if c in df.columns])
