import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use themselves.
CLASHING = ("size bigint, score double, kept string, fp bigint, row bigint, shard bigint, "
            "th bigint, n_words bigint, host string, spans string, quality string, _row bigint")


@pytest.fixture(scope="session")
def make_docs(spark):
    """rows of (doc_id, text[, source[, lang]]) -> documents; clashing adds other columns."""
    def make(rows, clashing=False):
        full = []
        for r in rows:
            doc_id, text, source, lang = (*r, "s0", "en")[:4] if len(r) == 2 else (*r, "en")[:4]
            full.append((doc_id, text, lang, source, len(text or "")))
        ddl = DDL
        if clashing:
            n = CLASHING.count(",") + 1
            full = [(*r, *[None] * n) for r in full]
            ddl = f"{DDL}, {CLASHING}"
        return spark.createDataFrame(full, ddl)
    return make


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from quarry.session import ship_package
    ship_package(spark)
