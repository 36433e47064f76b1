"""Answers survive a run that breaks off, and each is asked for once."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from stand_ins import LetterResponder

from examflow.operators.replay import Replay, attach_recorded, recorded_calls
from examflow.plans.evaluate import RunPaused, evaluate
from examflow.sources import testdata as td
from examflow.sources.runlog import pending, read_log, read_mixed_logs, write_named_log

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_killed_run_resumes_from_its_buckets(sf_small, tmp_path):
    """The process dies after half of the buckets; the next run asks only for the rest."""
    script = os.path.join(ROOT, "tests", "fault", "abort_run.py")
    env = {**os.environ, "CALLS": str(tmp_path / "calls")}
    args = [sys.executable, script, ROOT, sf_small, str(tmp_path / "log")]
    os.makedirs(env["CALLS"])
    first = subprocess.run([*args, "2"], capture_output=True, text=True, timeout=600, env=env)
    assert first.returncode == 9, first.stderr[-3000:]
    assert not [d for d in os.listdir(tmp_path / "log") if d.startswith("subset=")]
    half = sorted(os.listdir(env["CALLS"]))
    second = subprocess.run([*args, "-1"], capture_output=True, text=True, timeout=600, env=env)
    assert second.returncode == 0, second.stderr[-3000:]
    summary = json.loads(second.stdout.strip().splitlines()[-1])
    calls = sorted(os.listdir(env["CALLS"]))
    assert summary["logged"] == summary["distinct"] == summary["items"]
    assert 0 < len(half) < summary["items"] and summary["asked"] == summary["items"] - len(half)
    # a file an item and call: none was called twice
    assert len(calls) == summary["items"] and len({c.rsplit("-", 1)[0] for c in calls}) == summary["items"]


def test_paused_run_goes_on_and_counts_once(spark, sf_small, scratch):
    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("run")
    n = sets.test.where("subset = 'en'").count()
    with pytest.raises(RunPaused):
        evaluate(spark, sets, LetterResponder, path, k=0, subsets="en", run_id="p", commits=4, most_commits=1)
    assert read_log(spark, path).count() == 0
    res = evaluate(spark, sets, LetterResponder, path, k=0, subsets="en", run_id="p", commits=4)
    log = read_log(spark, path)
    assert 0 < res.staged.count() < n and log.count() == log.select("id").distinct().count() == n
    # what was logged is not taken again, by the same run or by one that overwrites
    again = evaluate(spark, sets, LetterResponder, path, k=0, subsets="en", run_id="p")
    assert again.staged.count() == 0 and read_log(spark, path).count() == n
    fresh = evaluate(spark, sets, LetterResponder, path, k=0, subsets="en", run_id="p", overwrite=True)
    assert fresh.staged.count() == n and read_log(spark, path).count() == n


def test_failed_calls_of_a_paused_run_are_asked_again(spark, sf_small, scratch):
    class Never:
        def __init__(self, **_):
            pass

        def __call__(self, prompt):
            raise ConnectionError("down")

    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("run")
    with pytest.raises(RunPaused):
        evaluate(spark, sets, Never, path, k=0, subsets="es", run_id="p", commits=2, most_commits=1, max_tries=1)
    res = evaluate(spark, sets, LetterResponder, path, k=0, subsets="es", run_id="p", commits=2)
    n = sets.test.where("subset = 'es'").count()
    assert res.staged.count() == n == read_log(spark, path).count()


def test_dropped_row_raises_and_items_are_scanned_once(spark, sf_small, scratch, monkeypatch):
    import examflow.plans.evaluate as E

    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("run")
    original = E.respond
    monkeypatch.setattr(E, "respond", lambda *a, **k: original(*a, **k).where(F.col("id") != "es-3").where("seq % 2 = 0"))
    with pytest.raises(RuntimeError, match="not every item came back"):
        evaluate(spark, sets, LetterResponder, path, k=0, subsets="es")
    assert read_log(spark, path).count() == 0
    # what is asked and what came back is counted on written tables: the items' source is
    # read by the job that writes the open items alone
    monkeypatch.setattr(E, "respond", original)
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    items = sets.all.where("subset = 'es'")
    counted = td.ExamItems(items.mapInArrow(seen, items.schema), sets.dev)
    evaluate(spark, counted, LetterResponder, scratch("run"), k=0, subsets="ALL")
    assert scans.value == items.count()


def test_replay_of_a_hot_recording(spark):
    """A third of the items takes one recording, which is split by weight."""
    items = spark.range(3000).select(F.lit("s").alias("subset"), F.col("id").cast("string").alias("id"),
                                     F.col("id").alias("seq"), F.lit("q").alias("prompt"))
    turns = spark.createDataFrame(
        [(c, t, r, f"{c}-{t}") for c in range(5) for t, r in enumerate(("user", "assistant"))]
        + [(9, 0, "user", "x"), (5, 1, "assistant", "late"), (5, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    key = F.when(F.col("seq") % 3 == 0, F.lit(0)).otherwise(F.col("seq") % 11).cast("long")
    asked = attach_recorded(items, recorded_calls(turns), key, spread=F.col("id"), rows_per_task=200)
    assert "__salt" in asked._jdf.queryExecution().toString()
    from examflow.operators.respond import respond

    got = {int(r.id): (r.full_response, r.attempts, r.error) for r in respond(asked, Replay, max_tries=3, aside=("calls",)).collect()}
    assert len(got) == 3000
    for i, (text, attempts, error) in got.items():
        c = 0 if i % 3 == 0 else i % 11
        if c < 5:
            assert (text, attempts, error) == (f"{c}-1", 2, None)
        elif c == 5:
            assert (text, attempts) == ("late", 2)
        else:
            assert text is None and attempts == 3 and ("no call" in error or "no answer" in error)


def test_mixed_layouts_and_a_torn_line(spark, sf_small, scratch):
    sets = td.exam_item_sets(spark, sf_small)
    path = scratch("run")
    evaluate(spark, sets, LetterResponder, path, k=0, subsets="fr", run_id="a")
    n = {r["subset"]: r["count"] for r in sets.test.groupBy("subset").count().collect()}
    lines = [json.dumps({"id": f"es-x{i}", "prompt": "p", "full_response": "A)", "gold_answer": "A"}) for i in range(3)]
    real = sets.test.where("subset = 'es'").select("id").first().id
    lines.append(json.dumps({"id": real, "prompt": "p\n", "full_response": "B)\n　", "gold_answer": "B"}, ensure_ascii=False))
    flat = os.path.join(path.removeprefix("file:"), "es_out.jsonl")
    with open(flat, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n" + lines[0][: len(lines[0]) // 2])
    rows, torn = read_mixed_logs(spark, path)
    assert {r["subset"]: r["count"] for r in rows.groupBy("subset").count().collect()} == {"fr": n["fr"], "es": 4}
    assert [r.line for r in torn.collect()] == [lines[0][: len(lines[0]) // 2]]
    assert rows.where(F.col("id") == real).first().full_response == "B)\n　"
    res = evaluate(spark, sets, LetterResponder, path, k=0, subsets="es, fr", run_id="b", mixed_log=True)
    assert res.staged.count() == n["es"] - 1  # the real id of the flat file is not asked again
    assert {r.subset: r.n for r in res.report.collect()} == {"fr": n["fr"], "es": n["es"] + 3}
    # a broken line that no dying writer leaves
    with open(flat, "w", encoding="utf-8") as f:
        f.write("no json\n" + "\n".join(lines))
    with pytest.raises(Exception, match="no JSON"):
        read_mixed_logs(spark, path)


def test_named_log_round_trip(spark, scratch):
    path = scratch("flat")
    df = spark.createDataFrame([("1", "p", None, "A"), ("2", "é\n", "x", "B")], "id string, prompt string, full_response string, gold_answer string")
    write_named_log(df, path, "a b+c")
    rows, torn = read_mixed_logs(spark, path)
    assert sorted((r.id, r.prompt, r.full_response, r.subset) for r in rows.collect()) == [
        ("1", "p", None, "a b+c"), ("2", "é\n", "x", "a b+c")]
    assert torn.count() == 0 and pending(df.withColumn("subset", F.lit("a b+c")), rows).count() == 0
    empty, none = read_mixed_logs(spark, scratch("nothing"))
    assert empty.count() == none.count() == 0


def test_large_named_log_is_a_folder_of_files(spark, scratch):
    """No task writes a large log alone; both readers take the folder as the one log."""
    from examflow.sources.runlog import read_named_logs

    path = scratch("flat")
    df = spark.range(0, 400, 1, 4).select(
        F.col("id").cast("string").alias("id"), F.lit("p").alias("prompt"), F.lit("A)\n").alias("full_response"), F.lit("A").alias("gold_answer"))
    write_named_log(df, path, "a b+c", one_file_bytes=1000)
    parts = [f for f in os.listdir(os.path.join(path.removeprefix("file:"), "a b+c_out.jsonl")) if f.startswith("part-")]
    assert len(parts) == 4
    for rows in (read_mixed_logs(spark, path)[0], read_named_logs(spark, path)):
        assert {(r.subset, int(r.id), r.full_response) for r in rows.collect()} == {("a b+c", i, "A)\n") for i in range(400)}
    # a small one replaces it: one file, lines in order
    write_named_log(df, path, "a b+c")
    with open(os.path.join(path.removeprefix("file:"), "a b+c_out.jsonl"), encoding="utf-8") as f:
        assert [json.loads(line)["id"] for line in f] == [str(i) for i in range(400)]
    write_named_log(df.limit(0), path, "none")
    assert read_named_logs(spark, path).where("subset = 'none'").count() == 0


def test_large_bucket_is_asked_where_it_lies(spark, sf_small, scratch):
    """Open items that fill files enough are not shuffled again; work has no explanations."""
    import glob

    sets = td.exam_item_sets(spark, sf_small)
    written = lambda: set(glob.glob(os.path.join(os.path.dirname(scratch("x")).removeprefix("file:"), "examflow-open-items-*")))
    before = written()
    spread = td.ExamItems(sets.all.repartition(8), sets.dev)
    res = evaluate(spark, spread, LetterResponder, scratch("run"), k=0, run_id="a")
    assert res.staged.count() == sets.test.count()
    new, = written() - before
    assert not {"explanation", "split"} & set(spark.read.parquet(new).columns)
