"""The library must work without the training-data package."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; print(sorted(e.queries())); e.oracle_sql()"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    assert "findings_grouped" in out.stdout and "op1_" not in out.stdout and "pipeline" not in out.stdout


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "sheetlark")):
        for name in names:
            if name.endswith(".py") and "llm" not in os.path.relpath(folder, ROOT).split(os.sep):
                with open(os.path.join(folder, name)) as file:
                    assert not re.search(r"\bllm\b", file.read()), name
