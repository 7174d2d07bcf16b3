"""The usage example of the README, run as written in a fresh process started
in a scratch folder (relative paths resolve against the JVM's start folder)."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_readme_usage_example(tmp_path):
    code = re.search(r"## Usage\s+```python\n(.*?)```", (ROOT / "README.md").read_text(encoding="utf-8"), re.S).group(1)
    (tmp_path / "data.csv").write_text("name,age,city\n  Alice ,30,Paris\nBob,0,Lyon\nBob,0,Lyon\nCharlie,35, Marseille \n",
                                       encoding="utf-8")
    check = (
        "\nrows = sorted(tuple(r) for r in spark.read.parquet('out').collect())\n"
        "print(rows)\nspark.stop()\n"
    )
    script = tmp_path / "example.py"
    script.write_text(f"import sys\nsys.path.insert(0, {str(ROOT)!r})\n" + code + check, encoding="utf-8")
    proc = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert proc.returncode == 0, proc.stderr[-3000:]
    assert proc.stdout.strip().splitlines()[-1] == str([("Alice", 30.0, "Paris"), ("Bob", 32.5, "Lyon"), ("Charlie", 35.0, "Marseille")])
    assert (tmp_path / "recipe.json").is_file() and (tmp_path / "reports" / "clean.html").is_file()
