import subprocess
import sys

import __spark_entry__ as entry


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) >= 180 and int(out[1]) >= 175


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["item_id", "chunk_id", "final", "rank"] and frame.count() > 0
