"""Shared storage, Arrow mapping and text helpers used by every operator here.

Intermediate results that are used more than once are written as Parquet into
the folder that all executors share (``spark.checkpoint.dir``), so a lost
executor costs at most the tasks it was running.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only an unset folder in local mode,
    where there is a single machine, gets one below the temp folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/larkspur-shared"


class Scratch:
    """Tables of one operator run in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df and returns the reread table: lineage ends here, and the
        optimizer learns the table's true size."""
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(nullable(df.schema)).parquet(self.path(table))

    def keep(self, *tables: str) -> None:
        """Deletes all tables but these."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        self.drop(*(name for f in found if (name := f.getPath().getName()) not in tables))

    def drop(self, *tables: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(conf).delete(path, True)


#: Bits of a filter at most (32 MB in broadcast), and for each key.
FILTER_BITS, BITS_A_KEY = 1 << 28, 16
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps


def split_in(rows: DataFrame, key: Column, keys: DataFrame, most: int = FILTER_BITS) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose 64-bit key is in `keys` (one column) with about one in
    BITS_A_KEY of the others, and all other rows, by a bitmap that is broadcast:
    these needn't take part in a join with the keys. (rows, None) if the bitmap
    would have over `most` bits."""
    bits = _BITMAP
    n = keys.count()
    while bits < BITS_A_KEY * n:
        bits *= 2
    if bits > most:
        return rows, None
    at = lambda c: F.pmod(c, F.lit(bits))
    spot = at(F.col(keys.columns[0]))
    maps = keys.groupBy(F.shiftright(spot, 15).alias("_chunk")).agg(F.bitmap_construct_agg(spot.bitwiseAND(F.lit(_BITMAP - 1))).alias("_map"))
    tried = rows.withColumn("_at", at(key)).join(F.broadcast(maps), F.shiftright("_at", 15) == F.col("_chunk"), "left")
    low = F.col("_at").bitwiseAND(F.lit(_BITMAP - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(low, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), low.bitwiseAND(F.lit(7)))), F.lit(2)) == 1, F.lit(False))
    return tried.where(hit).select(*rows.columns), tried.where(~hit).select(*rows.columns)


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, most: int = FILTER_BITS) -> DataFrame:
    """The first part of split_in: what a join that follows has to shuffle."""
    return split_in(rows, key, keys, most)[0]


def nullable(schema: StructType) -> StructType:
    out = StructType()
    for field in schema:
        out.add(field.name, field.dataType, True)
    return out


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names: null text
    counts as empty, and other columns, whatever their names, are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def tidy() -> None:
    """Gives memory that this worker holds but doesn't use back to the machine;
    workers live on, and several share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow that hands fn slices of at most `rows` rows, so that the
    Python side's memory doesn't depend on the batch size of the session."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
        tidy()

    return df.mapInArrow(run, schema)


#: Texts of these characters only take the fast word path of the tokenizers:
#: ASCII and Latin-1 letters and signs whose classes no Unicode version moved,
#: without control characters, superscript digits and fractions.
PLAIN = re.compile("[\t\n\r -~¡-©«-±´¶-¸»¿-ÿ–—‘’“”…€]*")


def is_plain(text: str) -> bool:
    return (text.isascii() and text.isprintable()) or PLAIN.fullmatch(text) is not None
