"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import compare  # noqa: E402

from lumenspan.registry import ORACLES, QUERIES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, connection, name):
    problem, _ = compare.difference(QUERIES[name](spark, SF_DIR), connection.sql(ORACLES[name]))
    assert problem is None


def test_other_queries_work_without_what_the_text_part_needs():
    code = "import sys; sys.modules.update(zstandard=None, xxhash=None); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert [int(n) for n in out] == [len(QUERIES), len(ORACLES)]
