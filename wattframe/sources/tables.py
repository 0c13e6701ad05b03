"""Readers with column checks, writers, and catalog reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions import clean


class MissingColumns(ValueError):
    """A table lacks columns its reader requires."""


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def read_table(spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: str | None = None,
               required: Sequence[str] = (), columns: Sequence[str] | None = None,
               timestamps: Sequence[str] = (), **options) -> DataFrame:
    """Scan a table, check its columns, project at the scan and parse text timestamps."""
    if fmt == "csv":
        options = {"header": True, **options}
    reader = spark.read.format(fmt).options(**options)
    df = require_columns((reader.schema(schema) if schema else reader).load(path), required)
    if columns is not None:
        df = require_columns(df, columns).select(*columns)
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in timestamps}) if timestamps else df


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*", fmt: str = "parquet",
                schema: str | None = None, required: Sequence[str] = (), **options) -> DataFrame:
    """All files of one schema that match ``pattern``, with the file name as a column. Empty files add no rows."""
    if fmt == "csv":
        options = {"header": True, **options}
    reader = spark.read.format(fmt).options(pathGlobFilter=pattern, recursiveFileLookup=True, **options)
    df = (reader.schema(schema) if schema else reader).load(folder)
    return require_columns(df, required).select("*", F.col("_metadata.file_name").alias("file_name"))


def file_attributes(name: Column, months: Mapping = clean.MONTH_WORDS, zones: Mapping = clean.ZONE_WORDS) -> list[Column]:
    """Year, month and zone read from a file name, whose encoding is repaired first."""
    name = clean.repair_encoding(name)
    year = F.regexp_extract(name, r"(20\d\d)", 1)
    return [year.try_cast("int").alias("year"), clean.match_keyword(name, months).alias("month"),
            clean.match_keyword(name, zones).alias("zone")]


def available_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def fuzzy_column(df: DataFrame, words: Sequence[str]) -> str | None:
    """First column whose lower-cased name contains one of the words."""
    return next((c for c in df.columns if any(w in c.lower() for w in words)), None)


def rename_fuzzy(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename the found columns to the keys of ``wanted``; absent ones become NULL."""
    found = {new: fuzzy_column(df, words) for new, words in wanted.items()}
    return df.select(*[(F.col(old) if old else F.lit(None)).alias(new) for new, old in found.items()])


def json_arrays_to_rows(df: DataFrame, payload: str, arrays: Mapping[str, str], path: str | None = None) -> DataFrame:
    """Rows from a JSON object of parallel arrays; ``arrays`` maps array names to element types."""
    inner = "struct<" + ",".join(f"{n}:array<{t}>" for n, t in arrays.items()) + ">"
    parsed = F.from_json(payload, f"struct<{path}:{inner}>" if path else inner)
    obj = parsed[path] if path else parsed
    zipped = F.arrays_zip(*[obj[n].alias(n) for n in arrays])
    keep = [c for c in df.columns if c != payload]
    return df.select(*keep, F.inline(zipped)).toDF(*keep, *arrays)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def replace_slice(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the slices whose key values occur in ``df``; other slices of the table stay as they are."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def build_metadata(df: DataFrame, lists: Mapping[str, str], built_at: bool = True, most: int = 10_000) -> DataFrame:
    """Key/value rows: number of rows and the distinct values of some columns.

    A list is one text, so a column with more than ``most`` values is refused with an error, before more of them are gathered.
    """
    text = F.array_join(F.transform(F.array_sort("_v"), lambda x: x.cast("string")), ",")
    out = df.agg(F.count("*").cast("string").alias("value")).select(F.lit("n_rows").alias("key"), "value")
    for key, c in lists.items():
        few = df.select(F.col(c).alias("_c")).distinct().limit(most + 1).agg(F.collect_set("_c").alias("_v"))
        told = F.raise_error(F.lit(f"column {c} has more than {most} values"))
        out = out.unionByName(few.select(F.lit(key).alias("key"), F.when(F.size("_v") <= most, text).otherwise(told.cast("string")).alias("value")))
    if built_at:
        out = out.unionByName(df.sparkSession.range(1).select(F.lit("built_at").alias("key"), F.current_timestamp().cast("string").alias("value")))
    return out


def build_manifest(tables: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows, first and last time per group of each table: name -> (table, group column, time column)."""
    parts = [df.groupBy(F.col(g).cast("string").alias("grp"))
             .agg(F.count("*").alias("n_rows"), F.min(t).cast("timestamp_ntz").alias("first_ts"),
                  F.max(t).cast("timestamp_ntz").alias("last_ts"))
             .select(F.lit(name).alias("tbl"), "grp", "n_rows", "first_ts", "last_ts")
             for name, (df, g, t) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog_profile(tables: Mapping[str, DataFrame], total: str | None = None) -> DataFrame:
    """Rows per table and type and NULL count per column, one aggregate per table; ``total`` names a last row over all tables."""
    parts = []
    for name, df in tables.items():
        types = dict(df.dtypes)
        one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("column_type"),
                                   F.col(c).alias("n_null")) for c in df.columns])
        parts.append(one.select(F.lit(name).alias("tbl"), F.col("_n").alias("n_rows"),
                                F.lit(len(types)).alias("n_columns"), F.inline(cells)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if total is None:
        return out
    each = out.groupBy("tbl").agg(F.first("n_rows").alias("n_rows"), F.first("n_columns").alias("n_columns"), F.sum("n_null").alias("n_null"))
    whole = each.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_columns").cast("int").alias("n_columns"), F.sum("n_null").alias("n_null"))
    return out.unionByName(whole.select(F.lit(total).alias("tbl"), "*", *[F.lit(None).cast("string").alias(c) for c in ("column_name", "column_type")]))


def preview(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """First ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def pick_sheet(cells: DataFrame, file: str, sheet: str, pos: str, words: Sequence[str]) -> DataFrame:
    """Cells of the first sheet per file whose name contains a word, else of the first sheet."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(sheet), F.lit(w))
    best = (cells.groupBy(file).agg(F.min(F.struct((~hit).alias("miss"), F.col(pos).alias("p"))).alias("_b"))
            .select(file, F.col("_b.p").alias(pos)))
    return cells.join(best, [file, pos], "left_semi")
