"""The driver's entry without the training-data operators, and without libraries that only these use."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
CODE = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r} or name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
q = set(e.queries())
print(len(q), sum(n[2:3].isdigit() for n in q), "pipeline" in q, set(e.oracle_sql()) <= q)
"""


@pytest.mark.parametrize("names", [["xxhash"], ["regex"], ["webloom.llm", "corpus_pipeline"], ["webloom.llm"]])
def test_the_core_works_without(names):
    out = subprocess.run([sys.executable, "-c", CODE.format(names=names)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, ops, pipeline, twins = out.stdout.split()
    assert int(n) > 100 and twins == "True" and (pipeline == "False" and ops == "0" or names == ["regex"])


def test_a_missing_core_module_is_an_error():
    out = subprocess.run([sys.executable, "-c", CODE.format(names=["webloom.operators.budget"])], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "budget" in out.stderr
