"""The entry module without its optional part, and without a library that the part needs."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

RUN = """
import warnings
warnings.simplefilter("ignore")
{before}
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert {condition}, sorted(e.queries())
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert e.queries()["range_sum"](s, "/root/testdata/sf0.001").count() == 1
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize(
    ("gone", "before", "condition"),
    [
        (["tidegauge/llm", "tests/llm", "corpus_pipeline.py"], "", "'pipeline' not in e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"),
        (["tidegauge/llm", "tests/llm"], "", "'pipeline' not in e.queries() and 'rollup_hour' in e.oracle_sql()"),
        ([], "import sys; sys.modules['ahocorasick'] = None", "'pipeline' in e.queries() and 'op4_substring_dedup' not in e.queries()"),
        ([], "import sys; sys.modules['xxhash'] = None", "'pipeline' not in e.queries() and 'op4_substring_dedup' not in e.queries()"),
    ],
)
def test_entry_without(tmp_path, gone, before, condition):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for x in gone:
        p = tmp_path / "repo" / x
        shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": str(tmp_path / "repo")}
    out = subprocess.run([sys.executable, "-c", RUN.format(before=before, condition=condition)], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
