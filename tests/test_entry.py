"""The core stands alone: without the text operators everything else imports and is registered."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n == 'pipeline' or n[:2] == 'op' and n[2].isdigit() for n in e.queries()))"


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"], ["markerloom/llm/emptied"]])
def test_core_without_text_operators(tmp_path, also):
    """Without the folders; without the pipeline too; and with a folder that was emptied only."""
    hidden = shutil.ignore_patterns(".git", "__pycache__", "llm", *[n for n in also if n.endswith(".py")])
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=hidden)
    for name in also:
        if not name.endswith(".py"):
            (copy / name).mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    count, sql, text = map(int, out.stdout.split())
    core = [n for n in entry.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]
    assert (count, text) == (len(core), 0)
    assert sql == len([n for n in entry.oracle_sql() if n in core])
