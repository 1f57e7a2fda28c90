"""Every registered query against its SQL answer, and the shape of its plan.

`compare` also refuses plans that join all pairs.
"""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from parity import compare, connect
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_answer(spark, con, name):
    got, want = compare(spark, con, SF, name, QUERIES[name], entry.oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_has_an_answer():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


def run_python(code: str, *paths: str) -> None:
    env = os.environ | {"PYTHONPATH": os.pathsep.join(paths)}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=paths[0], timeout=120)


def test_queries_and_answers_need_no_jar(tmp_path):
    """Registering reads neither Spark's jars nor anything beside the pyspark package."""
    run_python("import glob, zipfile\n"
               "def no(*a, **k): raise AssertionError(a)\n"
               "glob.glob = zipfile.ZipFile = no\n"
               "import __spark_entry__ as e\n"
               "assert len(e.queries()) > 70 and len(e.oracle_sql()) > 70", ROOT)


def test_entry_works_without_the_optional_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    run_python("import __spark_entry__ as e\nassert 'hybrid_rrf' in e.queries() and 'pipeline' not in e.queries()\n"
               "from workload.queries import APPROXIMATE\n"
               "assert set(e.queries()) - set(APPROXIMATE) == set(e.oracle_sql())", str(tmp_path / "repo"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["bm25_search", "keyword_search", "native_search"])
def test_scoring_moves_only_the_best(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    head = text[:text.index("Bucketed: true")]
    assert head.count("Exchange hashpartitioning") == 1
    assert head.index("Exchange hashpartitioning(query_id") > head.index("WindowGroupLimit")
    assert "dynamicpruning" in text


def test_title_lookup_is_pushed_down(spark):
    assert "EqualTo(p_name,red widget)" in plan(entry.queries()["title_lookup"](spark, SF))
