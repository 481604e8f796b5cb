"""Tables in and out: CSV, JSON, Parquet, catalog tables and JDBC."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from millrace.session import write_and_read

JDBC_BATCH = 1_000


CSV = {"escape": '"'}  # quotes inside a quoted text are doubled


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV with a header row. Pass a schema for large inputs: inference reads the data one more time.

    Quoted line breaks are part of the text, as ``write_csv`` writes them (as line feeds, whatever they were), and files are
    still read in byte ranges: the number of quotes before a range says whether it begins inside a text. Quotes stand around
    whole fields and are doubled inside; an unclosed one makes the rest of its file one record. ``multi_line=False`` saves
    looking for breaks in files known to have none.
    """
    if not multi_line:
        reader = spark.read.options(header=True, **CSV)
        return reader.option("inferSchema", True).csv(path) if schema is None else reader.schema(schema).csv(path)
    found = write_and_read(csv_records(spark, path))
    rows = found.filter("not head").select("value")
    if schema is None:
        first = found.filter("head").agg(F.min("value")).first()[0]
        names = next(csv.reader([first], strict=False)) if first else []
        kinds = spark.read.options(inferSchema=True, **CSV).csv(rows.rdd.map(lambda r: r.value)).schema.fields
        kinds = {i: f.dataType for i, f in enumerate(kinds)}
        schema = T.StructType([T.StructField(name, kinds.get(i, T.StringType())) for i, name in enumerate(names)])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not schema.fields:
        return spark.createDataFrame([], schema)
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return rows.select(F.from_csv("value", ddl, CSV).alias("_row")).select("_row.*")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(value, head): the records of CSV files as text, and whether one is the first of its file; blank lines left out.

    Lines are read in byte ranges. A line with an odd number of quotes opens or closes a quoted text. Each range reports
    whether it turns the state round, a window over the ranges of a file gives the state each begins in, and then every range
    knows which of its lines begin a record. Only lines of records with breaks are gathered, by the range and number of
    their record; a record that goes on from an earlier range finds it by a second window over ranges.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))
    lines = lines.withColumn("_odd", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2)
    ranges = write_and_read(lines.groupBy("_f", "_b").agg(F.sum("_odd").alias("_turns"), F.min("_m").alias("_top")))
    before = W.partitionBy("_f").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    state = ranges.withColumn("_state", F.coalesce(F.sum("_turns").over(before), F.lit(0)) % 2)
    state = state.withColumn("_at", F.row_number().over(W.partitionBy("_f").orderBy("_b")))
    placed = lines.join(F.broadcast(state), ["_f", "_b"])  # one row a range
    head = ((F.col("_at") == 1) & (F.col("_m") == F.col("_top"))).alias("head")
    if not ranges.agg(F.sum("_turns")).first()[0]:
        return _clean_records(placed.select("value", head))
    own = W.partitionBy("_f", "_b").orderBy("_m")
    inside = (F.col("_state") + F.coalesce(F.sum("_odd").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) % 2 == 1
    marked = placed.select("*", head, inside.alias("_inside"))
    number = F.sum(F.when(F.col("_inside"), 0).otherwise(1)).over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = write_and_read(marked.select("value", "head", "_f", "_b", "_m", "_odd", "_inside", number.alias("_n")))
    whole = marked.filter("not _inside and _odd = 0").select("value", "head")
    starts = marked.groupBy("_f", "_b").agg(F.max("_n").alias("_n"))
    last = F.last(F.when(F.col("_n") > 0, F.struct(F.col("_b").alias("b"), F.col("_n").alias("n"))), ignorenulls=True).over(before)
    homes = starts.select("_f", "_b", last.alias("_home"))
    parts = marked.filter("_inside or _odd = 1").join(F.broadcast(homes), ["_f", "_b"])  # one row a range
    key = F.when(F.col("_n") > 0, F.struct(F.col("_b").alias("b"), F.col("_n").alias("n"))).otherwise(F.col("_home"))
    joined = parts.groupBy("_f", key.alias("_key")).agg(
        F.array_sort(F.collect_list(F.struct("_b", "_m", "value"))).alias("_parts"), F.max("head").alias("head"))
    return _clean_records(whole.unionByName(joined.select(F.array_join("_parts.value", "\n").alias("value"), "head")))


def _clean_records(records: DataFrame) -> DataFrame:
    value = F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), "\r$", "")
    return records.select(value.alias("value"), "head").filter(F.trim("value") != "")


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, array: bool = True
) -> DataFrame:
    """JSON rows. ``array=True`` reads files that hold one JSON array; ``False`` reads splittable JSON lines."""
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def run_sql(
    spark: SparkSession, text: str, args: Mapping[str, object] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """SQL text with bound ``:name`` parameters over catalog tables, or over frames given as ``{name}``."""
    return spark.sql(text, args=dict(args or {}), **dict(tables or {}))


def jdbc_table(spark: SparkSession, url: str, table_or_query: str, **options: str) -> DataFrame:
    """A table or query of an external database. Connection settings always come from the caller; give
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read in parallel."""
    key = "query" if table_or_query.lstrip().lower().startswith("select") else "dbtable"
    return spark.read.format("jdbc").option("url", url).option(key, table_or_query).options(**options).load()


def write_jdbc(df: DataFrame, url: str, table: str, columns: Sequence[str] | None = None, **options: str) -> None:
    """Append to an external table in batches."""
    out = df.select(*columns) if columns else df
    settings = {"batchsize": str(JDBC_BATCH), **options}
    out.write.format("jdbc").option("url", url).option("dbtable", table).options(**settings).mode("append").save()


def save_typed_table(df: DataFrame, name: str, schema: T.StructType, mode: str = "overwrite") -> None:
    """Create or replace a table with declared column types. Columns missing from ``df`` are NULL."""
    _conform(df, schema).write.mode(mode).saveAsTable(name)


def append_columns(df: DataFrame, name: str, columns: Sequence[str]) -> None:
    """Append some columns to an existing table; its other columns are NULL in the new rows."""
    schema = df.sparkSession.table(name).schema
    _conform(df.select(*columns), schema).write.mode("append").saveAsTable(name)


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV part files with a header, one per partition."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_snapshot(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Type-preserving copy."""
    df.write.mode(mode).parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
