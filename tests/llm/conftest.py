import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_texts import ODD_TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, each twice under different ids, one row repeated, one without an id; columns that clash."""
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD_TEXTS + ODD_TEXTS)]
    rows += [rows[3], (None, "One. Two, three!", "de"), (1 << 60, "alone", "de")]
    rows = [(i, t, lang, f"src{n % 2}", n, n, "x") for n, (i, t, lang) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, fp long, keep_id long, row string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
