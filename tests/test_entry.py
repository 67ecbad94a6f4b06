import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_imports_the_subpackage():
    code = "import sys, sieveline.plans.queries, sieveline.streaming.stateless; assert not [m for m in sys.modules if m.startswith('sieveline.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "sample_hash"]
    assert df.count() > 0
