"""The entry point with and without the optional folders."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

PROBE = """
import __spark_entry__ as e
from barloom.session import build_session
names = set(e.queries())
assert not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) == names
spark = build_session("local[2]", "probe", 2)
print("rows", e.queries()["d4_open_dates"](spark, "%s").count())
""" % SF


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_library_without_the_optional_folder(tmp_path, pipeline_stays):
    absent = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline_stays else ["corpus_pipeline.py"]))
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=absent)
    assert os.path.exists(copy / "corpus_pipeline.py") == pipeline_stays
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[-1]) > 0
