"""Folders of document files as rows."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Extensions taken in, and those whose bytes are text.
SUPPORTED = ("pdf", "docx", "doc", "txt")
PLAIN = ("txt",)

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
TURNS = 4  # listing tasks for a core; Spark's own number, 10,000, is mostly their overhead


def file_extension(path: str | Column) -> Column:
    """Text after the last dot, lower case."""
    path = F.col(path) if isinstance(path, str) else path
    return F.lower(F.element_at(F.split(path, "[.]"), -1))


def decode_utf8(content: str | Column) -> Column:
    """Bytes -> text, leaving out what is not valid UTF-8."""
    content = F.col(content) if isinstance(content, str) else content
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def write_documents(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder ``key=value`` for each value, with the text of every row and a line's end as one file. ``path`` is new.

    Below ``file:``, tasks write the files themselves: Hadoop without its native library starts a process for the permissions of each
    folder, each file and its checksums there. That folder is one all executors share, as for Spark's writer, which writes to
    all other stores. A file has its name once it is whole, and a task that runs again writes the same ones."""
    local = re.match("file:(?://[^/]*)?(/.*)", path)
    if not local or not isinstance(df.schema[key].dataType, T.IntegralType):
        # tasks put their files in place themselves; otherwise the driver would move them one by one at the end
        writer = df.select(key, text).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        return writer.partitionBy(key).text(path)
    top = local[1]
    os.makedirs(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get(), Counter()
        for batch in batches:
            for value, content in zip(batch.column(0), batch.column(1)):
                folder = f"{top}/{key}={'__HIVE_DEFAULT_PARTITION__' if value.as_py() is None else value.as_py()}"
                name = f"part-{task.partitionId():05d}-{seen[folder]:03d}.txt"
                seen[folder] += 1
                os.makedirs(folder, exist_ok=True)
                unfinished = f"{folder}/.{name}.{task.taskAttemptId()}"  # hidden from readers
                with open(unfinished, "wb") as f:
                    f.write((content.as_py() or b"") + b"\n")
                os.replace(unfinished, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["files"])

    df.select(key, F.col(text).cast("binary")).mapInArrow(run, "files long").agg(F.sum("files")).collect()


def read_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One row per file: path, extension, supported flag, bytes. Unsupported files are flagged, not dropped.
    The file source skips files of zero bytes; they come from a listing, with no bytes in them."""
    most = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(most), TURNS * spark.sparkContext.defaultParallelism)))
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    finally:
        spark.conf.set(LISTING, most)
    files = found.select("path", "content").unionByName(_empty_files(found))
    extension = file_extension("path")
    return files.select(
        "path", extension.alias("extension"), extension.isin(*SUPPORTED).alias("supported"), "content"
    )


def _empty_files(found: DataFrame) -> DataFrame:
    """The files that Spark's own listing has and its reader leaves out, as locations with escapes until the end. Names stay in
    the driver's JVM, which holds the listing anyway; neither names nor sizes are asked for one by one."""
    spark, java = found.sparkSession, found.sparkSession._jvm
    listed = java.scala.collection.immutable.ArraySeq.unsafeWrapArray(found._jdf.inputFiles())
    names = DataFrame(spark._jsparkSession.createDataset(listed, java.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    names = names.withColumnRenamed("value", "_at")
    plain = F.url_decode(F.replace("_at", F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(plain, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")
    return names.select(path.alias("path")).join(found.select("path"), "path", "left_anti").withColumn("content", F.lit(b""))


def document_text(files: DataFrame) -> DataFrame:
    """Text of the plain-text files; other supported formats arrive as pieces from the caller's own parser."""
    text = F.when(F.col("extension").isin(*PLAIN), decode_utf8("content"))
    return files.select("path", "extension", "supported", text.alias("text"))
