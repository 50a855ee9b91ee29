"""The entry module stands when the optional subpackage cannot be imported."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_panel_queries_register_where_an_optional_import_fails():
    code = "import sys; sys.modules['tidepool.llm.queries'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bars_daily' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
