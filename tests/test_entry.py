"""The driver's contract module."""

import os
import subprocess
import sys


def test_it_imports_without_a_session():
    """Queries are listed before any session exists."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
            "from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None; "
            "assert len(q) > 150 and set(o) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
