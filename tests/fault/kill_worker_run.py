"""Run an evaluation where one responder task dies mid-way on its first
attempt (its Python worker exits); Spark retries the task. Prints a JSON
summary of the resulting log."""

import json
import os
import sys

sys.path.insert(0, sys.argv[1])

from pyspark import TaskContext  # noqa: E402

from examflow.plans.evaluate import evaluate  # noqa: E402
from examflow.session import get_session, scratch_path  # noqa: E402
from examflow.sources import testdata as td  # noqa: E402
from examflow.sources.runlog import read_log  # noqa: E402


class DiesOnce:
    def __init__(self, **_):
        self.calls = 0

    def __call__(self, prompt):
        self.calls += 1
        ctx = TaskContext.get()
        if ctx.partitionId() == 0 and ctx.attemptNumber() == 0 and self.calls == 5:
            os._exit(1)  # the worker process dies, as on a lost executor
        return chr(65 + len(prompt) % 4) + ")"


spark = get_session("local[4,3]", app="examflow-fault", **{"spark.sql.shuffle.partitions": "4"})
sets = td.exam_item_sets(spark, sys.argv[2])
path = scratch_path(spark, "fault")
res = evaluate(spark, sets, DiesOnce, path, k=2, partitions=4, run_id="f")
log = read_log(spark, path)
ids = [r.id for r in log.select("id").collect()]
print(json.dumps({
    "logged": len(ids),
    "distinct": len(set(ids)),
    "items": sets.test.count(),
    "report_n": sum(r.n for r in res.report.collect()),
}))
spark.stop()
