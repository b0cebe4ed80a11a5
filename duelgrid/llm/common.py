"""What the operators of this folder share: column choice, kept tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.session import ensure_checkpoint_dir

#: Rows turned into Python objects at once; Arrow batches themselves stay columnar.
SLICE = 256


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, by position of the exact name, so that extra columns whose names differ
    only in case (or repeat a name that an operator makes) do no harm; of a repeated name the first counts."""
    place = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{place[n]}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Kept:
    """Tables written once to the folder that spark.checkpoint.dir names and read again: lineage is cut on
    storage that every executor sees, and the reread table has a size the optimizer can judge joins by."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_one(self, number: int) -> None:
        """Remove a table, once nothing reads it any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def typed(column, kind: pa.DataType) -> pa.Array:
    """A column of the slice, cast if the input had another width, or one made of Python values."""
    if not isinstance(column, pa.Array):
        return pa.array(column, type=kind)
    return column if column.type == kind else column.cast(kind)


def map_slices(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow in slices of a bounded number of rows.  `work` is called once per task and returns the
    function that turns a slice into columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for part in slices(batches):
            made = each(part)
            yield pa.RecordBatch.from_arrays([typed(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
