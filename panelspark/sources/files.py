"""Sources and sinks: ragged text tables, JSON lines, databases, manifests, resumable appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_ragged(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t", short_rows: str = "pad", header: bool = True) -> DataFrame:
    """An unquoted delimited file, every column text. Short rows are padded with NULL (``pad``) or left out (``drop``).

    Lines are split here and not by the CSV reader, whose notion of a malformed row changes with the columns a
    query happens to read.
    """
    if short_rows not in ("pad", "drop"):
        raise ValueError("short_rows is pad or drop")
    lines = spark.read.text(path)
    parts = F.split("value", "\\Q" + sep + "\\E", -1)
    out = lines.select(parts.alias("p")).where(F.size("p") <= len(columns)) if short_rows == "drop" else lines.select(parts.alias("p"))
    if short_rows == "drop":
        out = out.where(F.size("p") == len(columns))
    out = out.select(*[F.nullif(F.get("p", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])
    return out.where(~F.coalesce(F.col(f"`{columns[0]}`") == columns[0], F.lit(False))) if header else out


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A query against a database by JDBC, in ``parts`` ranges of a numeric key if one is named."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(title, offset) of an index of offset:id:title lines, compressed or not; the last offset of each title."""
    p = F.split("value", ":", 3)
    rows = spark.read.text(path).where(F.size(p) == 3).select(p[2].alias("title"), p[0].try_cast("long").alias("offset"))
    return rows.groupBy("title").agg(F.max("offset").alias("offset"))


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a log of finished keys leaves to do."""
    return todo.join(done.select(key), key, "left_anti")


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append the rows whose keys a Parquet table lacks; how many."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(list(keys))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    from panelspark.plans.shared import cut

    fresh = cut(fresh)
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path``, built first where there is none that finished."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return b.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
