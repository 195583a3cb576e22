"""Quality, packing, decontamination, shards and the pipeline."""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cuespan.llm import decontaminate, packing, quality, queries, shards
from tests.llm import brute
from tests.llm.conftest import ODD, documents, pairs


def labels_of(spark, sf="0.01"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet")


def test_quality_on_held_out_rows(spark):
    docs, labels = documents(spark, "0.01"), labels_of(spark)
    got = quality.quality_scores(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == h for d, h in got["held_out"].items())
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    real = labels.toPandas().set_index("doc_id")["quality"]
    held = got[got["held_out"]].join(real, how="inner")
    assert (held["predicted"] == held["quality"]).mean() > 0.95


def test_held_out_labels_are_not_used(spark):
    docs, labels = documents(spark), labels_of(spark, "0.001")
    flipped = labels.withColumn("quality", F.when(quality.fold_of(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.quality_scores(docs, x).toPandas().sort_values("doc_id") for x in (labels, flipped))
    assert np.allclose(a["score"], b["score"])


def test_quality_odd_rows(spark, odd, none, repeated):
    labels = labels_of(spark, "0.001")
    assert quality.quality_scores(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0
    rows = quality.quality_scores(repeated, labels).collect()
    assert len(rows) == 2 * len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0.5 for r in quality.quality_scores(odd, labels.where("false")).collect())
    assert quality.keep_good(odd, labels.where("false")).columns == odd.columns


def test_isotonic_pools():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 3, 1, 4, 4.0]), np.array([4, 4, 4, 4, 4.0]))
    assert (np.diff(y) >= 0).all() and len(y) == 3


def test_pieces_and_places(spark, odd):
    slow = Tokenizer.from_file(queries.TOKENIZER)
    special = spark.createDataFrame([(50, "a <|endoftext|> b"), (51, "tabs\t   é́ \x85 ﬀ")], "doc_id bigint, text string")
    for docs in (odd.select("doc_id", "text").unionByName(special), documents(spark)):
        rows = packing.packed(docs, queries.TOKENIZER, queries.RANKS).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["doc_id"]].append(r)
        for d, t in pairs(docs):
            ids = slow.encode(t or "", add_special_tokens=False).ids + [2]
            parts = sorted(by.pop(d), key=lambda r: r["piece"])
            assert [p["piece"] for p in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // 1024)
            at = 0
            for i, p in enumerate(parts):
                own = ids[at:at + p["length"]]
                assert p["start"] == at and (p["length"] == 1024 or i == 0)
                assert p["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
                at += p["length"]
            assert at == len(ids)
        assert not by
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024


@pytest.mark.parametrize("name,counts", [
    ("uniform", {s: 40 for s in range(1, 1024)}), ("few", {300: 7, 400: 5, 1000: 2}), ("one", {513: 9}), ("small", {1: 5000}),
    ("halves", {512: 11, 511: 10, 2: 3}), ("skewed", {**{s: 3 for s in range(5, 900, 7)}, 341: 5000}),
])
def test_plan_packs_all(name, counts):
    runs = packing.plan(counts)
    made = Counter()
    for times, chosen in runs:
        assert sum(s * n for s, n in chosen.items()) <= 1024
        for s, n in chosen.items():
            made[s] += times * n
    assert made == Counter(counts)
    big = sum(n for s, n in counts.items() if s > 512)
    least = max(big, -(-sum(s * n for s, n in counts.items()) // 1024))
    assert sum(t for t, _ in runs) <= 1.01 * least + 2 if name != "skewed" else sum(t for t, _ in runs) <= 1.02 * least + 2


def test_packing_odd_rows(none, repeated):
    assert packing.packed(none, queries.TOKENIZER).count() == 0
    rows = packing.packed(repeated, queries.TOKENIZER, queries.RANKS).collect()
    assert sum(r["doc_id"] == 2 for r in rows) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


BENCH = [(1, " ".join(f"q{i}" for i in range(20))), (2, "Short Item here"), (3, None), (4, ""), (10, "one"),
         (5, "same same same same same same same same same same same same same same")]


def test_contamination_equals_loop(spark, odd):
    own = [(60, "Q0 q1,q2.q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 tail"), (61, "so SHORT item here short item here and on"),
           (62, "same " * 40), (63, " ".join(f"q{i}" for i in range(12))), (64, "pad " * 300 + BENCH[0][1])]
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id bigint, text string"))
    for d, b in ((docs, bench), (documents(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))):
        got = {r["doc_id"]: tuple(r)[2:] for r in decontaminate.contamination(d, b).collect()}
        assert got == brute.contamination(pairs(d), [tuple(r) for r in b.select("item_id", "text").collect()])
        clean = {i for i, r in got.items() if not r[-1]}
        left = decontaminate.drop_contaminated(d, b)
        assert {r[0] for r in left.select("doc_id").collect()} == clean and left.columns == d.columns


def test_index_in_blocks_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c a x b"), (2, "b a")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("a",), ("b",), ("x",)], "term string")
    whole, cut = (decontaminate.positional_index(docs, terms, block_terms=n) for n in (100, 1))
    key = lambda df: sorted((r["term"], r["doc_id"], tuple(r["positions"])) for r in df.collect())
    assert key(whole) == key(cut) and ("a", 1, (0, 3)) in key(whole) and ("", 1, (6,)) in key(whole)
    near = decontaminate.proximity_matches(whole, spark.createDataFrame([("a", "x")], "term string, other string"), 2)
    assert [(r["doc_id"], r["start"], r["end"]) for r in near.collect()] == [(1, 3, 4)]


def test_contamination_odd_rows(spark, odd, none, repeated):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(repeated, bench).count() == 2 * len(ODD) + 2
    assert decontaminate.contamination(odd, bench.where("false")).where("contaminated").count() == 0


@pytest.mark.parametrize("times", [1, 2, 3])
def test_contamination_of_repeated_rows(spark, times):
    """Each row as often as not: the verdict is that of the row alone."""
    bench = spark.createDataFrame(BENCH[:2], "item_id bigint, text string")
    own = [(1, "pad pad " + BENCH[0][1]), (2, "short item here"), (3, "short words"), (4, "item and item"), (5, None),
           (6, " ".join(f"q{i}" for i in range(12))), (7, "q0 q1 q2 " + "pad " * 10)]
    want = brute.contamination(own, BENCH[:2])
    docs = spark.createDataFrame(own * times, "doc_id bigint, text string")
    got = Counter((r["doc_id"], *tuple(r)[2:]) for r in decontaminate.contamination(docs, bench).collect())
    assert got == Counter({(d, *r): times for d, r in want.items()}) and want[1][-1] and want[2][-1] and not want[3][-1]
    left = Counter(r[0] for r in decontaminate.drop_contaminated(docs, bench).collect())
    assert left == {d: times for d, r in want.items() if not r[-1]}


def _shard(doc_id, count, seed=shards.SEED):
    """The shard with the highest hash, by a plain loop."""
    def chained(s):
        at = xxhash.xxh64_intdigest(struct.pack("<i", s), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))
        at = at if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), at)
        return at - (at >> 63 << 64)
    return max(range(count), key=chained)


def test_shards_equal_loop(spark, odd, repeated, none, tmp_path):
    for i, (docs, rows) in enumerate(((none, 0), (odd, len(ODD)), (repeated, 2 * len(ODD) + 2), (documents(spark), 200))):
        got = shards.shard_report(docs, str(tmp_path / f"out{i}"), bucket_rows=7).collect()
        assert len(got) == rows
        want = Counter((d, len((t or "").encode()) + 1, brute.crc(t or ""), "key", _shard(d, 8), _shard(d, 9)) for d, t in pairs(docs))
        assert Counter((*tuple(r)[:5], r["grown_shard"]) for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 8)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_order_of_shards_depends_on_rows_and_seed_only(spark):
    def places(docs, **how):
        return {r["row"]["doc_id"]: (r["shard"], r["bucket"], r["at"]) for r in shards.shuffled(docs, bucket_rows=7, **how).collect()}

    docs, first = documents(spark), places(documents(spark))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        assert places(docs.repartition(3)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert places(docs, seed=7) != first
    kept = defaultdict(list)
    for d, (s, b, at) in first.items():
        kept[s, b].append((at, d))
    assert any([d for _, d in sorted(rows)] != sorted(d for _, d in rows) for rows in kept.values())


def test_rows_that_repeat_are_dealt_over_buckets(spark):
    same = spark.range(400).selectExpr("cast(null as bigint) doc_id", "'same' text")
    found = Counter(r["bucket"] for r in shards.shuffled(same, shards=2, bucket_rows=20).collect())
    assert sum(found.values()) == 400 and len(found) > 5 and max(found.values()) < 100


def test_written_shards_read_back(spark, odd, tmp_path):
    wide = odd.withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r")).withColumn("bucket", F.lit(3))
    shards.write_shards(wide, str(tmp_path / "out"))
    back = shards.read_shards(spark, str(tmp_path / "out"), wide.schema).select("row.*")
    assert back.columns == wide.columns
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, wide.collect()))


def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        before, after = dict(pairs(docs)), dict(pairs(kept))
        assert after.items() <= before.items() and len(after) >= 0.6 * len(before)
        if name == "exact dedup":
            texts = defaultdict(list)
            for d, t in before.items():
                texts[brute.lower(t)].append(d)
            assert set(after) == {max(ids) for ids in texts.values()}
        if name == "near dedup":
            groups = defaultdict(set)
            for d, (_, c) in brute.simhash_components(list(before.items())).items():
                groups[c].add(d)
            assert all(len(ids & set(after)) <= 1 for ids in groups.values())
        if name == "decontamination":
            bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {d for d, r in brute.contamination(list(before.items()), bench).items() if not r[-1]}
        docs = kept
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in rows} == set(dict(pairs(docs)))


def test_pipeline_on_empty_table(spark, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0
