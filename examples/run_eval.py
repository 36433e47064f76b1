"""A complete evaluation run, end to end, printing the per-subset means.

    python examples/run_eval.py [sf_dir] [--cot] [--k N] [--subsets a,b]

Items come from the test tables (exam views of `documents`); the responder replays
the recorded turns of `conversations` in place of a model client. Run it twice with the
same log folder to see resume: the second run calls nothing and reports from
the log.
"""

from __future__ import annotations

import argparse
import os
import sys
from pprint import pprint

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from examflow.operators.replay import Replay  # noqa: E402
from examflow.plans.catalog import recorded_call_items  # noqa: E402
from examflow.plans.evaluate import evaluate  # noqa: E402
from examflow.session import get_session, scratch_path  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("sf_dir", nargs="?", default="/root/testdata/sf0.01")
    ap.add_argument("--cot", action="store_true")
    ap.add_argument("--k", type=int, default=5)
    ap.add_argument("--subsets", default="ALL")
    ap.add_argument("--log", default=None, help="log folder (default: a new one in the shared folder)")
    args = ap.parse_args()

    spark = get_session()
    log = args.log or scratch_path(spark, "example-log")
    items = recorded_call_items(spark, args.sf_dir)
    run = evaluate(
        spark,
        items,
        Replay,
        log,
        mode="cot" if args.cot else "direct",
        k=args.k,
        subsets=args.subsets,
        backend="vllm",
        aside=("calls",),
    )
    print("log:", log)
    pprint(run.as_dict())
    spark.stop()


if __name__ == "__main__":
    main()
