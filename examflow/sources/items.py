"""Benchmark items: schema, Parquet scan, subset catalog and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import SUBSETS

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("subset", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("A", T.StringType()),
        T.StructField("B", T.StringType()),
        T.StructField("C", T.StringType()),
        T.StructField("D", T.StringType()),
        T.StructField("E", T.StringType()),
        T.StructField("F", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("explanation", T.StringType()),
    ]
)


def load_items(
    spark: SparkSession, path: str, split: str | None = None, subsets: list[str] | None = None
) -> DataFrame:
    """Scan an items table stored as Parquet partitioned by ``subset``/``split``.

    The filters sit right on the scan, so Spark prunes partitions and pushes
    the rest into the Parquet reader.
    """
    df = spark.read.schema(ITEM_SCHEMA).parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    if subsets is not None:
        df = df.where(F.col("subset").isin(subsets))
    return df


def write_items(
    items: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 200_000
) -> None:
    """Partitioned by subset and split, a large partition in several files of about
    ``rows_per_file``: rows are dealt by (subset, split, bucket of the id), and the
    number of buckets follows the largest (subset, split)."""
    rows = items.select(*[f.name for f in ITEM_SCHEMA.fields])
    sizes = rows.groupBy("subset", "split").agg(F.count(F.lit(1)).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    buckets = max(1, -(-(largest or 0) // rows_per_file))
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets))
    (
        rows.repartition(max(1, -(-(total or 0) // rows_per_file)) + buckets, F.col("subset"), F.col("split"), bucket)
        .write.mode(mode)
        .partitionBy("subset", "split")
        .parquet(path)
    )


def subset_catalog(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The catalog of known subsets as a one-column table."""
    names = SUBSETS if names is None else names
    return spark.createDataFrame([(n,) for n in names], "subset string")


def catalog_of(items: DataFrame) -> DataFrame:
    """The subsets that actually occur in an items table."""
    return items.select("subset").distinct()


def parse_subsets(spec: str) -> list[str] | None:
    """``'ALL'`` → None (no filter); else the comma list, each name stripped.

    Duplicates are removed keeping the first occurrence: a repeated subset
    would only be evaluated again with the same result.
    """
    if spec == "ALL":
        return None
    seen: dict[str, None] = {}
    for name in spec.split(","):
        seen.setdefault(name.strip(), None)
    return list(seen)


def requested_table(spark: SparkSession, spec: str, catalog: DataFrame) -> DataFrame:
    """Requested subset names (``'ALL'`` = the whole catalog)."""
    names = parse_subsets(spec)
    if names is None:
        return catalog.select("subset")
    return spark.createDataFrame([(n,) for n in names], "subset string")


def unknown_subsets(spark: SparkSession, spec: str, catalog: DataFrame) -> DataFrame:
    """Requested names missing from the catalog (an empty name counts as missing)."""
    return requested_table(spark, spec, catalog).join(catalog, "subset", "left_anti")


def validate_subsets(spark: SparkSession, spec: str, catalog: DataFrame) -> list[str] | None:
    """Raise before any work when a requested subset is not in the catalog."""
    names = parse_subsets(spec)
    if names is None:
        return None
    missing = [r["subset"] for r in unknown_subsets(spark, spec, catalog).collect()]
    if missing:
        raise ValueError(f"{missing[0]!r} is not an available subset")
    return names


def select_subsets(items: DataFrame, names: list[str] | None) -> DataFrame:
    return items if names is None else items.where(F.col("subset").isin(names))
