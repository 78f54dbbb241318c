"""The registry works with and without the corpus subpackage."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

WITHOUT = """
import importlib.util, sys
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name.startswith("weftline.llm") or name == "corpus_pipeline" else real(name, package)
import __spark_entry__ as e
names = e.queries()
assert "hybrid_retrieval" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= set(names)
assert not any(m.startswith("weftline.llm") for m in sys.modules)
"""


def test_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=REPO, check=True)


def test_names_and_columns_are_unique():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert len(names) == len(set(names)) and len(names) > 50
