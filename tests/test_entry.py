"""The contract works without the optional text-preparation folder."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_text_preparation(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "postsignal", tmp_path / "postsignal", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, len(set(o) - set(q)))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    count, pipeline, strangers = out.stdout.split()
    assert int(count) > 80 and pipeline == "False" and strangers == "0", out.stderr[-500:]
