"""The contract file stands without the optional text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_imports_without_the_text_operators(tmp_path, pipeline):
    for name in ("laborlake", "catalog"):
        shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    given = [n for n in ("__spark_entry__.py", "corpus_pipeline.py") if os.path.exists(f"{ROOT}/{n}")]
    for name in given if pipeline else given[:1]:
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    count, texts = out.stdout.split()[-2:]
    assert int(count) > 50 and texts == "False"
