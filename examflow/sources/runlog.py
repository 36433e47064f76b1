"""The response log: JSON lines, one folder per subset and run.

The log is the materialisation point of a run. Responses are written first
and everything downstream (scores, reports, resume) reads the log back, so a
responder is never evaluated twice by two Spark actions, and a task retried
after an executor loss cannot double-count: Spark's file commit protocol
publishes only the output of committed task attempts.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import replace_model_slash

TARGET_BYTES = 128 * 1024 * 1024  # of text in a log file
NAMED_BYTES = 128 * 1024 * 1024  # of a log that one task puts in one file

# key order of a log line
LOG_FIELDS = ["id", "prompt", "full_response", "gold_answer"]
LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("full_response", T.StringType()),
        T.StructField("gold_answer", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("subset", T.StringType()),
    ]
)


def empty_log(spark: SparkSession) -> DataFrame:
    # known to be empty before it runs: nothing is shuffled to meet it
    return spark.createDataFrame([], LOG_SCHEMA).where(F.lit(False))


def read_log(
    spark: SparkSession, path: str, subsets: list[str] | None = None, fmt: str = "json"
) -> DataFrame:
    """Read a log folder; a missing folder is an empty log.

    A malformed JSON line fails the read (FAILFAST) instead of turning into
    a row of nulls. ``fmt="parquet"`` reads a columnar log, where scoring
    never touches the (large) prompt column.
    """
    try:
        reader = spark.read.schema(LOG_SCHEMA).option("basePath", path)
        if fmt == "json":
            df = reader.option("mode", "FAILFAST").json(path)
        else:
            df = reader.format(fmt).load(path)
        # resolve eagerly so that a missing path is caught here
        df.schema  # noqa: B018
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return empty_log(spark)
        raise
    if subsets is not None:
        df = df.where(F.col("subset").isin(subsets))
    return df


def _log_rows(df: DataFrame, run_id: str | None) -> DataFrame:
    run = F.col("run_id") if "run_id" in df.columns else F.lit(run_id).cast("string")
    return df.select(*LOG_FIELDS, run.alias("run_id"), "subset")


def _writer(df: DataFrame, mode: str, fmt: str):
    w = df.write.mode(mode).partitionBy("subset", "run_id")
    if fmt == "json":
        return w.option("ignoreNullFields", "false").format("json")
    return w.format(fmt)


def sized_by_subset(df: DataFrame, target_rows: int, key: str = "id", target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Lay rows out so a partitioned write makes files of about ``target_rows``, or of
    about ``target_bytes`` of text if that is less: a task sorts what it writes.

    A plain partitioned write from N tasks that each hold every subset makes
    N x subsets small files. Here each subset gets as many hash buckets as its
    rows or bytes ask for (one small row per subset to the driver) and rows are
    shuffled on ``(subset, bucket)``:
    about one file per bucket, and a large subset is still spread over many
    tasks. ``df`` should be materialised (a staged table), as it is read
    twice.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0).cast("long"))
    counts = df.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()
    if not counts:
        return df
    buckets = {r["subset"]: max(1, -(-r["n"] // target_rows), -(-r["bytes"] // target_bytes))
               for r in counts if r["subset"] is not None}
    per_subset = F.create_map(*[x for s, b in buckets.items() for x in (F.lit(s), F.lit(b))])
    bucket = F.pmod(F.xxhash64(F.col(key)), F.coalesce(per_subset[F.col("subset")], F.lit(1)))
    return df.repartition(max(1, sum(buckets.values())), F.col("subset"), bucket)


def append_log(
    df: DataFrame,
    path: str,
    run_id: str | None = None,
    fmt: str = "json",
    target_rows_per_file: int | None = 200_000,
) -> None:
    """Append lines (UTF-8, unescaped, null fields written as null)."""
    rows = _log_rows(df, run_id)
    if target_rows_per_file:
        rows = sized_by_subset(rows, target_rows_per_file)
    _writer(rows, "append", fmt).save(path)


def overwrite_log(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    subsets: list[str],
    run_id: str | None = None,
    fmt: str = "json",
    target_rows_per_file: int | None = 200_000,
    only_run: bool = False,
) -> None:
    """Replace the log of exactly the given subsets; other subsets are untouched.
    With ``only_run``, only the lines of ``run_id`` in them: other runs stay.

    Dynamic partition overwrite only replaces partitions that receive rows,
    so what is to go and gets no rows is emptied explicitly. ``df``
    should be materialised (``evaluate`` passes its staged responses): the
    subsets it holds are read from it once more, on the ``subset`` column
    alone.
    """
    rows = _log_rows(df, run_id).where(F.col("subset").isin(subsets))
    if target_rows_per_file:
        rows = sized_by_subset(rows, target_rows_per_file)
    _writer(rows, "overwrite", fmt).option("partitionOverwriteMode", "dynamic").save(path)
    written = {(r["subset"], r["run_id"]) for r in rows.select("subset", "run_id").distinct().collect()}
    for name, run, where in _partitions(spark, path):
        if name in subsets and (name, run) not in written and (not only_run or run == run_id):
            _fs(spark, path)[0].delete(where, True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path


def _partitions(spark: SparkSession, path: str) -> list[tuple]:
    """(subset, run, folder) of a log, from a directory listing (no data read).
    Folder names are escaped as %XX."""
    fs, Path = _fs(spark, path)
    found = fs.globStatus(Path(f"{path.rstrip('/')}/subset=*/run_id=*")) or []
    out = []
    for st in found:
        names = [unquote(p.getName().split("=", 1)[1]) for p in (st.getPath().getParent(), st.getPath())]
        run = None if names[1] == "__HIVE_DEFAULT_PARTITION__" else names[1]
        out.append((names[0], run, st.getPath()))
    return out


def list_subsets(spark: SparkSession, path: str) -> list[str]:
    """Subsets present in a log folder."""
    return sorted({name for name, _, _ in _partitions(spark, path)})


def _named_subset() -> Column:
    """The subset that a ``<subset>_out.jsonl`` file or folder is named after."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)_out\.jsonl(/[^/]*)?$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_named_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs kept as one ``<subset>_out.jsonl`` per subset, a file or a folder of files, in
    the same schema."""
    fields = T.StructType([f for f in LOG_SCHEMA.fields if f.name not in ("subset", "run_id")])
    fs, Path = _fs(spark, path)
    named = f"{path.rstrip('/')}/*_out.jsonl"
    reader = spark.read.schema(fields).option("mode", "FAILFAST")
    lines = reader.json(named) if fs.globStatus(Path(named)) else reader.option("pathGlobFilter", "*_out.jsonl").json(path)
    return lines.select(*LOG_FIELDS, F.lit(None).cast("string").alias("run_id"), _named_subset().alias("subset"))


def write_named_log(df: DataFrame, path: str, subset: str, one_file_bytes: int = NAMED_BYTES) -> None:
    """The lines of one subset as ``<subset>_out.jsonl`` in ``path``, for readers of that
    layout: one file or, past ``one_file_bytes``, a folder of that name whose files hold
    the lines in order. Every task writes its own lines; one task puts a small log together."""
    spark = df.sparkSession
    fs, Path = _fs(spark, path)
    scratch = f"{path.rstrip('/')}/_named-{uuid.uuid4().hex[:8]}"
    parts, whole = f"{scratch}/parts", f"{scratch}/whole"
    df.select(*LOG_FIELDS).write.option("ignoreNullFields", "false").json(parts)
    target = Path(f"{path.rstrip('/')}/{subset}_out.jsonl")
    if fs.exists(target):
        fs.delete(target, True)
    if fs.getContentSummary(Path(parts)).getLength() > one_file_bytes:
        fs.rename(Path(parts), target)
    else:
        lines = spark.read.schema("value string").text(parts).select(
            "value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"))
        lines.coalesce(1).sortWithinPartitions("_file", "_start", "_line").select("value").write.text(whole)
        fs.rename(fs.globStatus(Path(f"{whole}/part-*"))[0].getPath(), target)
    fs.delete(Path(scratch), True)


def read_mixed_logs(spark: SparkSession, path: str, subsets: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(log, torn): one log from both layouts under ``path``, the partitioned one and
    ``<subset>_out.jsonl`` files (or folders of files) beside it, told apart by where a
    line's file lies.

    A writer that died leaves the start of a line at the end of its file. Such a line,
    the only one of its file that is no JSON, goes to ``torn(file, line)`` and its item is
    answered again; any other line that is no JSON fails the read.
    """
    fs, Path = _fs(spark, path)
    root = path.rstrip("/")
    parts = []
    fields = [f for f in LOG_SCHEMA.fields if f.name not in ("subset", "run_id")]
    bad = T.StructField("_bad", T.StringType())
    layouts = [
        (f"{root}/subset=*", False),
        (f"{root}/*_out.jsonl", True),
    ]
    schema = T.StructType([*fields, bad])
    for where, flat in layouts:
        if not fs.globStatus(Path(where)):
            continue
        # lines as text: a query on the unreadable lines alone is not allowed on JSON files
        lines = (spark.read if flat else spark.read.option("basePath", root)).schema(
            "value string" if flat else "value string, run_id string, subset string").text(where)
        row = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        rows = lines.where(F.trim("value") != "").select(
            row.alias("r"), F.col("_metadata.file_path").alias("_file"),
            *([F.lit(None).cast("string").alias("run_id"), _named_subset().alias("subset")] if flat else ["run_id", "subset"])
        ).select("r.*", "_file", "run_id", "subset")
        parts.append(rows.select(*[f.name for f in LOG_SCHEMA], "_file", "_bad"))
    if not parts:
        return empty_log(spark), spark.createDataFrame([], "file string, line string")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if subsets is not None:
        rows = rows.where(F.col("subset").isin(subsets))
    # lines that are no JSON, a handful; counted by file
    broken = rows.where(F.col("_bad").isNotNull()).groupBy("_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("_bad").alias("line"))
    start = F.col("line").startswith("{") & ~F.col("line").endswith("}")
    torn = broken.select(
        F.when((F.col("n") == 1) & start, F.col("_file")).otherwise(
            F.raise_error(F.concat(F.lit("a line is no JSON in "), "_file"))).alias("file"), "line")
    torn.write.format("noop").mode("overwrite").save()
    return rows.where(F.col("_bad").isNull()).drop("_bad", "_file"), torn


def logged_ids(log: DataFrame) -> DataFrame:
    """The distinct ``(subset, id)`` pairs already answered."""
    return log.select("subset", "id").distinct()


def pending(prompts: DataFrame, log: DataFrame) -> DataFrame:
    """Items not yet in the log. A null id would match no line and be answered
    again at every resume, so it is refused."""
    checked = F.when(F.col("id").isNull(), F.raise_error(F.lit("an item has no id")).cast("string")).otherwise(F.col("id"))
    prompts = prompts.withColumn("id", checked)
    return prompts.join(logged_ids(log), ["subset", "id"], "left_anti")


def run_dir(model, backend, cot, log_dir=None) -> Column:
    """Log folder of a run: ``log_dir`` if given, else ``log/<model>`` with a
    ``_logits`` (probability backend) or ``_cot`` suffix."""

    def c(x):
        return F.col(x) if isinstance(x, str) else x

    suffix = (
        F.when(c(backend) == "hf", F.lit("_logits"))
        .when(c(cot), F.lit("_cot"))
        .otherwise(F.lit(""))
    )
    default = F.concat(F.lit("log/"), replace_model_slash(c(model)), suffix)
    return default if log_dir is None else F.coalesce(F.nullif(c(log_dir), F.lit("")), default)
