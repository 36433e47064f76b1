"""An evaluation that leaves a file for each call and kills its own driver once a given
number of buckets is committed (-1: never)."""

import json
import os
import sys
import uuid

sys.path.insert(0, sys.argv[1])

from examflow.plans.evaluate import evaluate  # noqa: E402
from examflow.session import get_session  # noqa: E402
from examflow.sources import testdata as td  # noqa: E402
from examflow.sources.progress import Progress  # noqa: E402
from examflow.sources.runlog import read_log  # noqa: E402

commit, limit, folder = Progress.commit, int(sys.argv[4]), os.environ["CALLS"]


def stopping(self, rows, number):
    if len(self.own) == limit:
        os._exit(9)
    commit(self, rows, number)


class Notes:
    def __init__(self, **_):
        pass

    def attempt(self, request, number):
        open(os.path.join(folder, f"{request['item']}-{uuid.uuid4().hex}"), "w").close()
        return "A)"


Progress.commit = stopping
spark = get_session("local[2]", app="examflow-abort", **{"spark.sql.shuffle.partitions": "2"})
sets = td.exam_item_sets(spark, sys.argv[2])
# the id goes beside the prompt under a name of its own
items = td.ExamItems(sets.all.withColumn("item", sets.all["id"]), sets.dev)
res = evaluate(spark, items, Notes, sys.argv[3], k=1, run_id="f", commits=4, aside=("item",))
ids = [r.id for r in read_log(spark, sys.argv[3]).select("id").collect()]
print(json.dumps({"logged": len(ids), "distinct": len(set(ids)), "items": sets.test.count(), "asked": res.staged.count()}))
spark.stop()
