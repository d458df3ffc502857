"""Shared helpers of the training-data operators: input normal form, scratch tables in the shared
folder, and joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package
from ..sources.tables import read_table

#: The white space of every contract here: space and \t \n \v \f \r.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A null doc_id is ordered after every other one.
LAST_ID = 9223372036854775807
#: A key with at least this share of the rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_of(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_of(column: str = "doc_id") -> Column:
    """Null ids are ordered last."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(LAST_ID))


def original_id(column: str = "doc_id") -> Column:
    return F.when(F.col(column) != LAST_ID, F.col(column))


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def keep_rows(docs: DataFrame, wanted: DataFrame, key: Column, repeated: bool) -> DataFrame:
    """The rows of ``docs`` whose id (see :func:`id_of`) and ``key``, an expression over their text,
    are in ``wanted`` (doc_id, key); with ``repeated`` pairs, one row of each pair. Rows are packed,
    so ``docs`` may have any other columns."""
    rows = docs.select(F.struct("*").alias("row"), id_of().alias("doc_id"), key.alias("key"))
    kept = rows.join(wanted.select("doc_id", "key"), ["doc_id", "key"], "left_semi")
    return (kept.dropDuplicates(["doc_id", "key"]) if repeated else kept).select("row.*")


def has_repeats(rows: DataFrame, *names: str) -> bool:
    """Whether any doc_id, or its combination with the columns ``names``, occurs twice."""
    return bool(rows.groupBy("doc_id", *names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


class Scratch:
    """Tables of one run in the shared folder. Writing one cuts the lineage: a lost executor's
    work is read again from there. ``drop`` removes tables that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/tokenlens/llm/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of many rows with one row per key. ``groups[size]`` is the number of rows of the
    key and ``total`` the sum over all keys, so at most 1 / HOT_SHARE keys can be hot: those are
    joined by broadcast, wherever their rows are; all others have few rows each and are shuffled."""
    hot = F.col(size) >= F.lit(max(2, int(total * HOT_SHARE)))
    few, rest = groups.where(hot), groups.where(~hot)
    spread = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(few), keys).unionByName(spread)
