"""Queries of the subpackage against their SQL, and that the rest stands without it."""

import subprocess
import sys
from pathlib import Path

import pytest

from conftest import SF
from sightline.llm.catalog import ORACLES, QUERIES
from sightline.plans.compare import compare, connect

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_are_there():
    import __spark_entry__

    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    status, detail = compare(spark, SF, name, QUERIES, ORACLES, duck)
    assert status == ("same" if name in ORACLES else "rows"), detail


def test_the_pipeline_alone_may_be_missing():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert 'op1_decontaminate' in e.queries() and 'pipeline' not in e.queries()\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry_works_without_the_subpackage():
    code = (
        "import sys; sys.modules['sightline.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert 'a19_rejection_counts' in e.queries() and 'pipeline' not in e.queries()\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
