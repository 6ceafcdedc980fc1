"""The operators when Python workers cannot import this repository."""

import os
import subprocess
import sys

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
NAMES = ["op3_lm_score", "op4_line_dedup", "op5_quality", "op6_near_dedup", "op8_nearest", "op9_decontaminate", "op10_packing",
         "op11_chat", "op12_prefix_trie"]


def test_tasks_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    script = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from voltrail.session import build_session\n"
        "spark = build_session('elsewhere', 'local[4]', **{'spark.sql.shuffle.partitions': '4'})\n"
        f"for name in {NAMES!r}: print('rows', name, e.queries()[name](spark, {SMALL!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.count("rows op") == len(NAMES), done.stderr[-3000:]
