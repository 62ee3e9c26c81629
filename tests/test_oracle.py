"""A sample of the registered queries against their SQL on the smallest tables."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAMPLE = ["state_asof", "planning_scope", "checkpoint_state", "strict_history", "split_rolling", "roc_auc", "youden", "bootstrap_paired", "jackknife_group", "arm_metrics", "optimal_thresholds"]


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130


def test_sample_matches_sql():
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "check.py"), "0.001", *SAMPLE], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stdout
