from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cuespan.sequence import MAX_TRACK_ROWS_SETTING, PIECES_SETTING  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(params=[False, True], ids=["plain", "pieces"])
def hot(request, spark):
    """Both ways through ordered columns and folds: whole tracks, and tracks in pieces."""
    spark.conf.set(MAX_TRACK_ROWS_SETTING, "3" if request.param else "4000000")
    spark.conf.set(PIECES_SETTING, "5")
    yield request.param
    spark.conf.unset(MAX_TRACK_ROWS_SETTING)
    spark.conf.unset(PIECES_SETTING)


def rows(df, *order):
    """Rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.select(*(order or df.columns)).collect()), key=repr)
