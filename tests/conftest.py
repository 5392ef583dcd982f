import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from shroud.session import local_session

    s = local_session("*", shuffle_partitions=8, app="shroud-tests")
    yield s
    s.stop()


@pytest.fixture
def redact_one(spark):
    """Redact a list of texts (optionally with config) and return rows by id."""
    from shroud import api

    def run(texts, config=None, normalize="nfkc"):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        rows = api.redact(df, "id", "text", config, normalize=normalize, with_vault=True).collect()
        return {r.id: r for r in rows}

    return run
