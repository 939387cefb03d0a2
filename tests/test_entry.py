"""The driver contract holds without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = """
import sys
if len(sys.argv) > 1:
    sys.modules[sys.argv[1]] = None  # importing it fails
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q)
print(len(q), sum(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in q))
"""


def _count(cwd, *args):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", COUNT, *args], cwd=cwd, env=env, capture_output=True, text=True, check=True)
    return tuple(map(int, out.stdout.split()))


def test_queries_without_the_subpackage_or_its_libraries(tmp_dir):
    bare = os.path.join(tmp_dir, "bare")
    os.makedirs(bare)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), bare)
    shutil.copytree(os.path.join(ROOT, "shoplens"), os.path.join(bare, "shoplens"), ignore=shutil.ignore_patterns("llm", "__pycache__"))
    total, of_llm = _count(bare)
    assert total > 100 and of_llm == 0
    assert _count(ROOT, "xxhash") == (total, 0)
