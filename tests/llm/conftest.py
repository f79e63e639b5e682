import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from gaugeline.llm.ship import ship

    ship(spark)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages", "embeddings", "labels")}
