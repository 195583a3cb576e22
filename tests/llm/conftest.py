from __future__ import annotations

import pytest

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "one two three four five six seven eight nine"),
    (8, "one two three four five six seven eight nine"), (9, "ONE two three four five six seven eight nine"),
    (10, "Ärger É straße " * 40), (11, "x" * 20_000), (12, "long words again and " * 5_000), (13, "\n\n\n"),
    (14, "\x00\x01 nul \x7f bytes"), (15, "𝔘𝔫𝔦 code 漢字 😀 end"),
    (16, "one two three four five six seven eight ten\none two three four five six seven eight nine"),
]


@pytest.fixture
def odd(spark):
    """Nulls, blanks, very long texts and copies, with columns whose names clash with those in use."""
    rows = [(i, t, "slot", "keep", i, 0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, shard string, kept string, length bigint, size int")


@pytest.fixture
def none(odd):
    return odd.where("false")


@pytest.fixture
def repeated(odd):
    """Each row twice, and two without an id."""
    lost = odd.where("doc_id in (4, 7)").selectExpr("cast(null as bigint) doc_id", "text", "shard", "kept", "length", "size")
    return odd.unionByName(odd).unionByName(lost)


def documents(spark, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
