"""Reading and writing Parquet data sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import Expr
from ..operators import positional
from ..plans import pruning
from ..plans.scan import ROW, listing, numbered


def read(spark: SparkSession, *paths: str, schema: str | T.StructType | None = None, evolve: bool = False) -> DataFrame:
    """Files, folders or globs as one table. With `evolve` the schemas of all
    files are merged: missing columns are null, columns go by name."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", evolve)
    return reader.parquet(*paths)


def with_provenance(df: DataFrame) -> DataFrame:
    """Adds file_index, by order of path, and file_row_number. df reads files."""
    spark = df.sparkSession
    files = sorted(r.f for r in df.select(F.col("_metadata.file_path").alias("f")).distinct().collect())
    table = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "__f string, file_index long")
    marked = df.withColumns({"__f": F.col("_metadata.file_path"), "file_row_number": F.col("_metadata.row_index")})
    return marked.join(F.broadcast(table), "__f").select(*df.columns, "file_index", "file_row_number")


_PARTS = {
    "years": lambda c: F.date_format(c, "yyyy"),
    "months": lambda c: F.date_format(c, "yyyy-MM"),
    "days": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "hours": lambda c: F.date_format(c, "yyyy-MM-dd-HH"),
}


def partition_value(transform: str) -> tuple[str, Column]:
    """Name and value of a partition column: `c`, `years(c)`, `months(c)`,
    `days(c)`, `hours(c)` or `bucket(n, c)`."""
    name, _, rest = transform.partition("(")
    if not rest:
        return name, F.col(name)
    args = [a.strip() for a in rest.rstrip(")").split(",")]
    if name == "bucket":
        return f"{args[1]}_bucket", F.pmod(F.hash(args[1]), F.lit(int(args[0])))
    return f"{args[0]}_{name[:-1]}", _PARTS[name](F.col(args[0]))


@dataclass(frozen=True)
class WriteSummary:
    path: str
    rows: int
    files: int


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists", zone_columns: list[str] | None = None) -> WriteSummary:
    """Writes a data set, in folders by the partition transforms, and for
    zone_columns its zone map beside it (path + "_zones"). The summary counts
    the rows and files of this write; rows are counted on the way."""
    parts = [partition_value(t) for t in partition_by or []]
    made = df.withColumns({n: v for n, v in parts if n not in df.columns})
    spark = df.sparkSession
    before = 0
    if mode == "append":
        try:
            before = len(spark.read.parquet(path).inputFiles())
        except AnalysisException:
            pass  # nothing is there yet
    seen = Observation()
    writer = made.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    (writer.partitionBy(*(n for n, _ in parts)) if parts else writer).parquet(path)
    back = spark.read.schema(made.schema).parquet(path)
    if zone_columns:
        pruning.zone_map(back, zone_columns).write.mode("overwrite").parquet(f"{path.rstrip('/')}_zones")
    return WriteSummary(path, seen.get["rows"], len(back.inputFiles()) - before)


def truncate(spark: SparkSession, path: str) -> None:
    """Leaves a data set of no rows, of the same columns."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


class Dataset:
    """A data set of files with the usual handles."""

    def __init__(self, spark: SparkSession, *paths: str, filter: Expr | None = None):
        self.spark, self.paths, self._filter = spark, paths, filter

    @property
    def frame(self) -> DataFrame:
        df = self.spark.read.parquet(*self.paths)
        return df if self._filter is None else df.where(self._filter.bind(df))

    @property
    def schema(self) -> T.StructType:
        return self.frame.schema

    def count_rows(self) -> int:
        return self.frame.count()

    def filter(self, e: Expr) -> Dataset:
        return Dataset(self.spark, *self.paths, filter=e if self._filter is None else self._filter & e)

    def head(self, n: int) -> pa.Table:
        return self.frame.limit(n).toArrow()

    def taken(self, indices: list[int]) -> DataFrame:
        """pos and the rows at the indices, which count all rows; a filter then
        leaves out those that don't meet it."""
        rows = positional.take(numbered(self.spark, list(self.paths)), ROW, indices)
        return (rows if self._filter is None else rows.where(self._filter.bind(rows))).drop(ROW)

    def take(self, indices: list[int]) -> pa.Table:
        return self.taken(indices).orderBy("pos").drop("pos").toArrow()

    def to_batches(self, rows: int = 8192) -> Iterator[pa.RecordBatch]:
        """Batches of at most `rows` rows in turn, all of the frame's schema;
        they cross to the driver as Arrow, one partition at a time."""
        df = self.frame

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch.slice(at, rows))
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()])], ["ipc"])

        for row in df.mapInArrow(packed, "ipc binary").toLocalIterator():
            yield from pa.ipc.open_stream(row.ipc)

    def can_prune(self, e: Expr, zones: str) -> bool:
        """Whether the zone map at `zones` proves that e keeps nothing of the set."""
        return pruning.keep(self.spark.read.parquet(zones), e).isEmpty()

    def splits(self) -> list[Dataset]:
        return self.get_fragments()

    def to_table(self, columns: list[str] | None = None) -> pa.Table:
        return (self.frame.select(*columns) if columns else self.frame).toArrow()

    def get_fragments(self) -> list[Dataset]:
        return [Dataset(self.spark, f, filter=self._filter) for f in listing(self.spark, list(self.paths))]

    def statistics(self, table: str) -> DataFrame:
        """Registers the set as a table and has its columns analysed."""
        self.frame.write.mode("overwrite").saveAsTable(table)
        self.spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
        return self.spark.sql(f"DESCRIBE EXTENDED {table}")
