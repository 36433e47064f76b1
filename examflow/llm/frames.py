"""Small helpers shared by the operators: written tables, names, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examflow.session import scratch_path, ship_package, table_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs a re-read of shared files only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str, name: str, buckets: int) -> DataFrame:
    """As ``written``, dealt by ``key`` into buckets, so that later joins on ``key``
    read the rows where they lie instead of shuffling them again. With as many
    buckets as shuffle partitions, rows that come from a join on ``key`` lie in the
    right bucket already, and a bucket is one file."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = "t_" + path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved now; the name is not needed any more, the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable bytes are their own, the others
    follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def python_ready(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dense_rank(df: DataFrame, group: list[str], key: Column, order: list, out: str,
               buckets: int) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each ``group``, without one task per group.

    Rows are dealt to ``buckets`` by the hash of ``key``; the counts per (group,
    bucket), a narrow table, give each bucket its first number, and only the rows
    of one (group, bucket) are sorted together.
    """
    b = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df = df.withColumn("_bucket", b)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = df.withColumn("_place", F.row_number().over(inside) - 1)
    return (
        numbered.join(firsts, [*group, "_bucket"])
        .withColumn(out, (F.col("_before") + F.col("_place")).cast("long"))
        .drop("_bucket", "_before", "_place")
    )
