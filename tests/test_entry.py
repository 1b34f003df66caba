from __future__ import annotations

import subprocess
import sys

import __spark_entry__

from .conftest import ROOT


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_needs_the_removable_parts(tmp_path):
    """Without the operators of training data and the pipeline all else imports."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("weft.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and set(e.queries()) == set(e.oracle_sql())
assert not [m for m in sys.modules if m.startswith("weft.llm")]
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)
