import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def frame(spark):
    """DataFrame from rows and a DDL schema."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


def rows(df, *columns):
    """Rows as sorted tuples, decimals shown as float."""
    from decimal import Decimal

    def plain(v):
        return float(v) if isinstance(v, Decimal) else v

    picked = df.select(*columns) if columns else df
    return sorted((tuple(plain(v) for v in r) for r in picked.collect()), key=lambda r: tuple(map(str, r)))


def shuffle_files(spark):
    """Names of the shuffle files that the session holds on disk."""
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (held.apply(i).getName() for i in range(held.size()))
    return {n for n in names if n.startswith("shuffle_")}


def none_left(spark, before):
    """Whether the shuffle files that came since ``before`` are gone; they go a moment after their query."""
    import time

    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    return not shuffle_files(spark) - before
