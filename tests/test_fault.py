"""A responder task that loses its worker mid-way is retried by Spark, and
the log still holds exactly one line per item (no partial or duplicate
output from the failed attempt)."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_lost_worker_is_retried_without_duplicates(sf_small):
    script = os.path.join(ROOT, "tests", "fault", "kill_worker_run.py")
    out = subprocess.run(
        [sys.executable, script, ROOT, sf_small],
        capture_output=True,
        text=True,
        timeout=600,
    )
    assert out.returncode == 0, out.stderr[-3000:]
    summary = json.loads(out.stdout.strip().splitlines()[-1])
    assert summary["logged"] == summary["distinct"] == summary["items"] == summary["report_n"]
