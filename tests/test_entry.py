"""The entry module with and without the removable corpus part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import json, __spark_entry__ as e
print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))
"""


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_corpus_part(tmp_path, also):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    # the copy goes in front of what the caller has on its path, so that installed libraries stay in reach
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(copy), *(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT)])}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert '"change_detection"' in done.stdout and '"pipeline"' not in done.stdout and '"op1_' not in done.stdout
    # the tests that stay are collected without the part, and some of them run
    tests = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert tests.returncode == 0, tests.stdout
    some = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_catalog.py", "-k", "entry_and_registry or change_detection or canonical"], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert some.returncode == 0, some.stdout
