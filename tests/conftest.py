import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("quarry-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quarry-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("FATAL")
    yield s
    s.stop()


STORE_DDL = ("cache_key string, scanner string, scanner_name string, file string, doc_id bigint, "
             "status string, content_hash string, prompt_hash string, thinking string, "
             "tools_mode string, result string")


def store_rows(spark, rows):
    """rows: (scanner, file, status, result_json) -> result-store DataFrame."""
    from quarry import registry as R
    full = []
    for i, (sid, f, st, res) in enumerate(rows):
        full.append((f"k{i}", sid, R.SCANNER_BY_ID[sid][1], f, i, st, "c" * 16, "p" * 16,
                     "off", "off", res))
    return spark.createDataFrame(full, STORE_DDL)
