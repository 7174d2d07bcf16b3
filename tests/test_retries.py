"""Tasks that die on their first attempt (a lost executor) are retried by Spark;
results must be unchanged and nothing duplicated."""

import json
import subprocess
import sys
from pathlib import Path


def test_jobs_survive_task_retries(tmp_path):
    script = Path(__file__).parent / "scripts" / "retry_job.py"
    proc = subprocess.run(
        [sys.executable, str(script), str(tmp_path / "ckpt")], capture_output=True, text=True, timeout=600
    )
    assert proc.returncode == 0, proc.stderr[-3000:]
    summary = json.loads(proc.stdout.strip().splitlines()[-1])
    assert summary == {"numbering_ok": True, "extraction_ok": True, "rows": 40}
