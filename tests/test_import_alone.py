"""The entry has to import where no session is running."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_entry_imports_without_a_session():
    code = "import __spark_entry__ as E; assert len(E.queries()) >= len(E.oracle_sql()) > 0"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True,
                          timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
