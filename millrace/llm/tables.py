"""Intermediate tables in the shared folder, and batches of texts inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import checkpoint_folder

BROADCAST_ROWS = 1_000_000  # a table of ids with at most this many counted rows (tens of MB) may be broadcast
SLICE = 4 << 20  # bytes of text that a task turns into Python values at a time


class Scratch:
    """Parquet tables in a folder of their own below ``spark.checkpoint.dir``, deleted when the block ends.

    They cut lineage and survive lost executors. What must outlive the block goes through ``session.write_and_read``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
        self.count = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast only if it was counted and is small."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def labelled_sample(texts: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(id, text, label): at most ``bound`` labelled rows of texts (id, text), one for each of the ids with the lowest hashes.

    An id with several labels has the more frequent one, 1 if both are; of rows that share an id the text with the lowest
    hash counts. Null ids and null labels are left out."""
    known = labels.where("id is not null and label is not null").groupBy("id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(bound)
    with_label = texts.join(small(chosen), "id")
    return with_label.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "label")


def text_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id`` and ``text`` only, the text as UTF-8 bytes and empty where it is null."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows whose strings and binaries have about ``most`` bytes together, one row at least.

    Arrow batches hold thousands of rows; as Python values, input and output at once, they would take many times that."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple | None]], schema: str) -> DataFrame:
    """One output row for each input row through Arrow batches. ``make`` runs once a task and returns the row function,
    which gets the input columns in order and returns the output columns in order (None: no row)."""

    def make_part() -> Callable[..., list[tuple]]:
        each = make()
        return lambda *columns: [row for row in map(each, *columns) if row is not None]

    return map_parts(df, make_part, schema)


def map_parts(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str) -> DataFrame:
    """The same with a function of whole columns: it gets those of a slice of the rows and returns a list of rows."""
    spark_schema = DataFrameSchema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, kinds = make(), spark_schema.arrow()
        for batch in batches:
            for part in slices(batch):
                made = each(*[c.to_pylist() for c in part.columns])
                values = list(zip(*made)) if made else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(v), type=k.type) for v, k in zip(values, kinds)], schema=pa.schema(kinds)
                )

    return df.mapInArrow(run, schema)


class DataFrameSchema:
    """The Arrow fields of a DDL schema of the plain types used here."""

    KINDS = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
        "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
        "array<double>": pa.list_(pa.float64()),
    }

    def __init__(self, ddl: str):
        self.pairs = [part.strip().split(" ", 1) for part in ddl.split(",")]

    def arrow(self) -> list[pa.Field]:
        return [pa.field(name, self.KINDS[kind.strip()]) for name, kind in self.pairs]
