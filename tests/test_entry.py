"""The entry module has to work without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
WITHOUT = """
import sys
from importlib.abc import MetaPathFinder

class Gone(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("ledgerlens.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)

import importlib.util
found = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name.startswith(("ledgerlens.llm", "corpus_pipeline")) else found(name, *a)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "client_features_rt" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_training_data_operators():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
