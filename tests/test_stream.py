"""Streaming report: equals the batch report, and grows as files land."""

from pyspark.sql import functions as F

from examflow.operators.scoring import report, score
from examflow.sources import testdata as td
from examflow.sources.runlog import append_log, read_log
from examflow.streaming.score_stream import stream_report_once


def _as_dict(df):
    return {r.subset: (r.n, r.n_correct, round(r.avg_score, 12)) for r in df.collect()}


def test_stream_matches_batch_and_resumes(spark, sf_small, scratch):
    items = td.exam_items(spark, sf_small)
    log = td.log_rows_of(items)
    path, out, ckpt = scratch("slog"), scratch("srep"), scratch("sckpt")
    first = log.where(F.col("subset") != "en")
    append_log(first, path, run_id="a")
    got1 = _as_dict(stream_report_once(spark, path, out, ckpt))
    assert got1 == _as_dict(report(score(read_log(spark, path), "direct")))
    # a second batch of files arrives; the same checkpoint picks up only those
    append_log(log.where(F.col("subset") == "en"), path, run_id="b")
    got2 = _as_dict(stream_report_once(spark, path, out, ckpt))
    assert got2 == _as_dict(report(score(log, "direct")))


def test_stream_dedupe_option(spark, sf_small, scratch):
    items = td.exam_items(spark, sf_small)
    log = td.log_rows_of(items)
    path = scratch("dlog")
    append_log(log, path, run_id="a")
    got = _as_dict(stream_report_once(spark, path, scratch("drep"), scratch("dckpt"), dedupe=True))
    distinct = log.dropDuplicates(["subset", "id"])
    assert got == _as_dict(report(score(distinct, "direct")))


def test_stream_over_parquet_log(spark, sf_small, scratch):
    items = td.exam_items(spark, sf_small)
    log = td.log_rows_of(items)
    path = scratch("plog")
    append_log(log, path, run_id="a", fmt="parquet")
    got = _as_dict(
        stream_report_once(spark, path, scratch("prep"), scratch("pckpt"), mode="cot", fmt="parquet")
    )
    assert got == _as_dict(report(score(log, "cot")))


def test_dedupe_by_run_with_bounded_state(spark, scratch):
    """Repeats within a run count once, in two runs twice; a key leaves the state after the
    horizon, and its late repeat is found in what was written."""
    import json
    import os

    from examflow.streaming.score_stream import deduped_report, first_lines, scored_stream

    path, seen, ckpt = scratch("slog").removeprefix("file:"), scratch("seen"), scratch("ckpt")

    def land(run, ids, age):
        folder = f"{path}/subset=s/run_id={run}"
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/part-{len(os.listdir(folder))}-{age}.json"
        with open(name, "w") as f:
            for i in ids:
                f.write(json.dumps({"id": i, "prompt": "p", "full_response": "A)", "gold_answer": "A"}) + "\n")
        when = 1_700_000_000 - age
        os.utime(name, (when, when))

    def report():
        rows = deduped_report(spark, path, seen, ckpt, horizon="10 minutes").collect()
        return {(r.run_id, r.subset): r.n for r in rows}

    land("r1", [f"i{k}" for k in range(50)], 100_000)
    land("r1", ["i0", "i1"], 99_990)  # within the horizon: the state holds them
    land("r2", ["i0"], 99_980)
    assert report() == {("r1", "s"): 50, ("r2", "s"): 1}
    land("r2", [f"j{k}" for k in range(5)], 1000)
    assert report() == {("r1", "s"): 50, ("r2", "s"): 6}
    land("r2", ["k0"], 10)
    land("r1", ["i3", "i4", "new"], 5)  # long after: only the anti-join knows them
    assert report() == {("r1", "s"): 51, ("r2", "s"): 7}
    # the state holds the keys of the horizon, not all that were seen
    query = (scored_stream(spark, path, "direct", True, horizon="10 minutes").writeStream.outputMode("append")
             .option("checkpointLocation", ckpt).foreachBatch(first_lines(spark, seen)).trigger(availableNow=True).start())
    query.awaitTermination()
    land("r2", ["k1"], 0)
    query = (scored_stream(spark, path, "direct", True, horizon="10 minutes").writeStream.outputMode("append")
             .option("checkpointLocation", ckpt).foreachBatch(first_lines(spark, seen)).trigger(availableNow=True).start())
    query.awaitTermination()
    sizes = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert sizes and sizes[-1] <= 10
