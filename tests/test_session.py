"""Where shared tables go."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tidemark.session import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from pyspark.sql import SparkSession
from tidemark.session import materialize, shared_dir
b = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{dir}")
s = b.getOrCreate()
t = materialize(s.range(10))
assert t.count() == 10
print("DIR", shared_dir(s), t.inputFiles()[0])
"""


def run(folder):
    out = subprocess.run([sys.executable, "-c", CODE.format(dir=folder)], capture_output=True, text=True, cwd=ROOT, timeout=300)
    line = [x for x in out.stdout.splitlines() if x.startswith("DIR")]
    assert line, out.stderr[-2000:]
    return line[0].split()[1:]


def test_configured_folder_is_used_and_emptied_at_the_end(tmp_path):
    folder, file = run(str(tmp_path))
    assert folder == str(tmp_path) and file.startswith(f"file://{tmp_path}")
    assert not [p for p in os.listdir(tmp_path) if p.startswith("tidemark")]


def fake(master):
    sc = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: None)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: default))


def test_without_setting_only_a_local_session_gets_a_folder():
    local = fake("local[2]")
    assert os.path.isdir(shared_dir(local)) and shared_dir(local) == shared_dir(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake("yarn"))
