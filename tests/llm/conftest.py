import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """A document table from ``(doc_id, text)`` pairs, with columns whose names operators might use."""
    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, key long, group string, version string, stats string"
        return spark.createDataFrame([(i, t, "en", None, len(t or ""), 1, "g", None, "s") for i, t in rows], schema)

    return build


@pytest.fixture(scope="session")
def small(spark):
    """The smallest tables."""
    if not Path(SMALL).is_dir():
        pytest.skip("no test tables here")
    return lambda table: spark.read.parquet(f"{SMALL}/{table}.parquet")
