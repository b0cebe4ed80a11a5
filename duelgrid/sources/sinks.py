"""File sinks (ids A21-A23)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType


def write_text_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV with doubled quotes."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A22."""
    df.write.mode("overwrite").json(path)


#: Partition column of a table that lies by years.
YEAR = "on_year"


def write_years(df: DataFrame, path: str, day: str = "date") -> DataFrame:
    """A table in one folder per year of its day (rows without a day have their own), and the table as it is then.
    Writing again replaces the years that the rows fall in and leaves the others' files alone."""
    dated = df.withColumn(YEAR, F.year(day))
    # dealt by spans of eight days: a range would need the rows computed once more to find its bounds
    (dated.repartition(YEAR, F.floor(F.dayofyear(day) / 8)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(YEAR).parquet(path))
    return df.sparkSession.read.schema(StructType(df.schema.fields).add(YEAR, IntegerType())).parquet(path)


def years_between(table: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """A by-year table from `first` to `last`, both included; only these years' folders are read."""
    if first is not None:
        table = table.filter(F.col(YEAR) >= first)
    if last is not None:
        table = table.filter(F.col(YEAR) <= last)
    return table.drop(YEAR)


#: Hash buckets of an append-only table.
BUCKETS = 32


def unseen(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key that the bucketed table lacks."""
    fresh = df.dropDuplicates(keys).repartition(BUCKETS, *keys)
    return fresh.join(table.select(*keys).hint("merge"), keys, "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str], spark: SparkSession) -> None:
    """Append rows whose key is not there yet; running it twice changes nothing.  The table lies in hash buckets of
    its keys, sorted within each, so that only the new rows are shuffled to be compared with it."""
    name = "appended_" + hashlib.sha256(path.encode()).hexdigest()[:16]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {BUCKETS} BUCKETS LOCATION '{path}'")
    kept = unseen(df, spark.table(name), keys).checkpoint()  # the table may not be read while it is written
    kept.select(df.columns).write.mode("append").bucketBy(BUCKETS, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)
