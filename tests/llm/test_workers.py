"""The operators where the package is not installed on the workers."""

import os
import subprocess
import sys

import pytest

FOLDER = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from vulnlake.session import get_session
from vulnlake.llm import queries
spark = get_session("local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"}})
def absent(rows):
    import importlib.util
    yield importlib.util.find_spec("vulnlake") is None
assert all(spark.sparkContext.parallelize(range(4), 4).mapPartitions(absent).collect()), "the workers can import the package"
for name in {names!r}:
    frame = queries.QUERIES[name](spark, {folder!r})
    print(name, len(frame.collect()), len(frame.columns), flush=True)
"""
#: Those whose main path runs in Python workers.
NAMES = ["op4_chat_format", "op5_warc_round_trip", "op7_embedding_dedup", "op8_jaccard_join", "op10_toxicity", "op11_periodic_runs", "op12_suffix_dedup",
         "op13_token_alignment"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
def test_queries_need_no_package_on_the_workers(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=REPO, names=NAMES, folder=FOLDER))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == NAMES
