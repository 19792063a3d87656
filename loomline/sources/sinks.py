"""Writers: compressed parquet, CSV, cached queries, resumable appends, merges with earlier output, ordered and nested JSON."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, in folders ``by`` columns if given; rows of a folder are brought together first so that it has few files."""
    w = (df.repartition(*by) if by else df).write.mode(mode).option("compression", compression)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def cached_query(spark: SparkSession, path: str, run: Callable[[], DataFrame], after: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The table at ``path``; where there is none, the query's result after post-processing, written there first."""
    if not _there(spark, f"{path}/_SUCCESS"):
        df = run()
        write_parquet(after(df) if after else df, path)
    return spark.read.parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not at ``path`` yet, and returns how many there were; a broken-off run can be repeated."""
    spark = df.sparkSession
    fresh = df
    if _there(spark, path):
        fresh = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    before = spark.read.parquet(path).count() if _there(spark, path) else 0
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def merged(prior: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Earlier rows, which win where keys agree, and the new ones beside them."""
    return prior.unionByName(new.join(prior.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def write_ordered_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines in a total order; range partitions keep it without one task for all."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_nested_json(df: DataFrame, path: str, key: str, fields: Sequence[str]) -> None:
    """One JSON object per row: the key and an object of the fields."""
    df.select(F.to_json(F.struct(F.col(key), F.struct(*fields).alias("context"))).alias("value")).write.mode("overwrite").text(path)


def shard(df: DataFrame, key: str, n: int, i: int) -> DataFrame:
    """The i-th of n parts of the rows by a hash of the key."""
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(n)) == i)
