import os
import subprocess
import sys

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.abspath(e.__file__))


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
