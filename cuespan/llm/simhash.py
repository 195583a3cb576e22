"""Near-duplicates by SimHash fingerprints, filtered by a table of pivot distances; near copies verified by shingles."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.components import components
from cuespan.llm.texts import LOWER_BYTES, by_batch, key_filter, parted, rows_of, text_key, whole
from cuespan.session import written

SEED = 42
PIVOTS = 24
#: The fingerprints by which ``drop_near_copies`` proposes pairs: (width, seed); width 0 stands for distinct words.
KINDS = ((3, SEED), (0, SEED), (0, SEED + 1))
BITS = 64
#: Near copies share this part of their distinct runs of SHINGLE words.
SIMILAR = 0.8
SHINGLE = 5
#: Bands of least hashes: two texts that share 0.8 of their shingles miss all of them with a chance of 1 in 10 000.
BANDS = 24
BAND_ROWS = 5
#: So many times as many centres in each turn.
GROWTH = 8
#: Cells of a sketch, in words of 64 bits.
CELLS = 1024
_CHUNK = 100_000
_ROWS = 1024


def _fingerprint(features: list[bytes], seed: int) -> int:
    """Bit i is set if it is set in over half of the features' hashes."""
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(features), _CHUNK):
        hashes = np.array([digest(f, seed=seed) for f in features[at:at + _CHUNK]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(features), bitorder="little").view("<i8")[0])


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of ``width`` words with repeats; the whole sequence where there are fewer words."""
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*(words[i:] for i in range(width)))]


def fingerprints(docs: DataFrame, kinds: tuple[tuple[int, int], ...] = ((3, SEED),), text: str = "text") -> DataFrame:
    """``(doc_id, text_key, prints)`` per row: a 64-bit fingerprint for each ``(width, seed)`` of ``kinds``.

    Features are the word shingles of ``width`` with repeats; for width 0, the distinct words. A text without
    words, and a null text, has fingerprint 0.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for value in batch.column(2):
            words = value.as_py().encode().translate(LOWER_BYTES).split()
            found.append([_fingerprint(shingles(words, w) if w else list(set(words)), s) for w, s in kinds])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_key", "prints"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", text_key(text).alias("text_key"), whole(text).alias("text")), make,
                    f"doc_id {id_type}, text_key bigint, prints array<bigint>")


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: random ones, from a fixed seed."""
    return [int(x) for x in np.random.default_rng(SEED).integers(-(2**63), 2**63 - 1, count, np.int64)]


def pivot_table(prints: DataFrame, count: int = PIVOTS) -> DataFrame:
    """Adds ``near``: the Hamming distances to the pivots, a byte each, eight to a long."""
    far = [F.bit_count(F.col("print").bitwiseXOR(F.lit(p))).cast("bigint") for p in pivots(count)]
    packed = []
    for at in range(0, count, 8):
        word = F.lit(0).cast("bigint")
        for i, distance in enumerate(far[at:at + 8]):
            word = word.bitwiseOR(F.shiftleft(distance, 8 * i))
        packed.append(word)
    return prints.withColumns({f"near{i}": word for i, word in enumerate(packed)})


def _may_be_near(left: str, right: str, count: int, radius: int) -> Column:
    """No coordinate of two rows of the pivot table differs by more than ``radius``: by the
    triangle inequality, all pairs within it pass."""
    passes = F.lit(True)
    for i in range(count):
        a, b = (F.shiftright(F.col(f"{side}.near{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255)) for side in (left, right))
        passes = passes & (F.abs(a - b) <= radius)
    return passes


def _masks(radius: int) -> list[int]:
    """Each choice of 3 blocks out of radius + 3, as a signed mask of its bits: prints that differ
    in at most ``radius`` bits agree on all bits of one choice at least."""
    blocks = radius + 3
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    found = [sum(chosen) for chosen in combinations(parts, 3)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def near_pairs(prints: DataFrame, radius: int = 3, count: int = PIVOTS) -> DataFrame:
    """``(kind, a, b)`` with a < b: all pairs of distinct ``print`` values of a ``kind`` within ``radius`` bits, each once.

    Pairs meet where they share the bits of one choice of blocks (about half of all 64, so chance
    meetings stay rare at any size). The pivot table, made once per fingerprint, discards a meeting by
    its largest coordinate difference; what is left is verified bit by bit and reported for the first
    choice only.
    """
    masks = _masks(radius)
    table = written(pivot_table(prints.select("kind", "print").distinct(), count))
    choices = F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("print").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    keyed = table.withColumn("key", F.explode(choices)).select(
        (F.col("kind") * len(masks) + F.col("key.choice")).alias("choice"), "key.bits", "kind", "print",
        *[f"near{i}" for i in range(-(-count // 8))])
    differ = F.col("l.print").bitwiseXOR(F.col("r.print"))
    first = F.lit(len(masks))
    for i, m in reversed(list(enumerate(masks))):
        first = F.when(differ.bitwiseAND(F.lit(m)) == 0, i).otherwise(first)
    return (
        keyed.alias("l").join(keyed.alias("r"), (F.col("l.choice") == F.col("r.choice")) & (F.col("l.bits") == F.col("r.bits"))
                              & (F.col("l.print") < F.col("r.print")) & _may_be_near("l", "r", count, radius)
                              & (F.bit_count(differ) <= radius) & (first == F.col("l.choice") % len(masks)))
        .select("l.kind", F.col("l.print").alias("a"), F.col("r.print").alias("b"))
    )


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3, text: str = "text") -> DataFrame:
    """``(doc_id, text_key, print, component_id)`` per row: its fingerprint, and the smallest doc_id that
    can be reached from it over fingerprints at most ``radius`` bits apart.

    Texts without words share fingerprint 0 and are linked like any others. Null texts count as empty.
    Rows may repeat. A null doc_id takes part, and is a component's id only if it has no other. No
    rows give no rows. Other columns are not read.
    """
    found = written(fingerprints(docs, ((width, SEED),), text).select("doc_id", "text_key", F.col("prints")[0].alias("print")))
    firsts = written(found.groupBy("print").agg(F.min("doc_id").alias("first")).withColumn("kind", F.lit(0)))
    rooted = written(components(near_pairs(firsts, radius).select("a", "b")))
    in_groups = written(firsts.join(rooted, F.col("print") == F.col("node")).select("print", "first", "root"))
    lowest = in_groups.groupBy("root").agg(F.min("first").alias("component_id"))
    grouped = in_groups.join(lowest, "root").select("print", "component_id")
    alone = firsts.join(rooted, F.col("print") == F.col("node"), "left_anti").select(
        "print", F.col("first").alias("component_id"))
    # Both sides are tables, so that a print with very many rows can be split.
    return found.join(written(grouped.unionByName(alone)), "print").select("doc_id", "text_key", "print", "component_id")


def band_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(band, bucket, text_key)``: for each distinct text, ``BANDS`` hashes of ``BAND_ROWS`` least hashes of its runs of
    ``SHINGLE`` words. Texts without words share all buckets."""
    rng = np.random.default_rng(SEED)
    times = rng.integers(0, 2**63, BANDS * BAND_ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, BANDS * BAND_ROWS, np.int64).astype(np.uint64)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, digest = np.zeros((batch.num_rows, BANDS), np.int64), xxhash.xxh64_intdigest
        for i, value in enumerate(batch.column(1)):
            words = value.as_py().encode().translate(LOWER_BYTES).split()
            hashes = np.array(list({digest(f) for f in shingles(words, SHINGLE)}) or [0], np.uint64)
            # The upper half of a product depends on all bits of the hash; the lower one does not.
            least = [((part[:, None] * times + plus) >> np.uint64(20)).min(0) for part in np.split(hashes, range(_ROWS, len(hashes), _ROWS))]
            rows = np.min(least, 0).astype("<u8").reshape(BANDS, -1)
            found[i] = [xxhash.xxh64_intdigest(r.tobytes()) >> 1 for r in rows]
        owner = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)), pa.array(found.ravel()),
             batch.column(0).take(owner)], ["band", "bucket", "text_key"])

    return by_batch(docs.select(text_key(text).alias("text_key"), whole(text).alias("text")), make,
                    "band int, bucket bigint, text_key bigint").distinct()


def sketch_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(sketch_key, sketch)`` for each distinct text: its number ``n`` of distinct runs of ``SHINGLE`` words, and ``w0``, ``w1``, …,
    a bit for each of ``CELLS`` cells of hashes that some run falls into."""
    names = [f"w{i}" for i in range(CELLS // 64)]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, counts, digest = np.zeros((batch.num_rows, CELLS), np.uint8), [], xxhash.xxh64_intdigest
        for i, value in enumerate(batch.column(1)):
            runs = _runs(value.as_py())
            counts.append(len(runs))
            cells[i, [digest(r) % CELLS for r in runs]] = 1
        words = np.packbits(cells, axis=1, bitorder="little").view("<i8")
        held = [pa.array(counts, pa.int64()), *(pa.array(np.ascontiguousarray(w)) for w in words.T)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(held, ["n", *names])], ["sketch_key", "sketch"])

    fields = ", ".join(f"{name}: bigint" for name in ["n", *names])
    keyed = docs.select(text_key(text).alias("sketch_key"), whole(text).alias("text")).dropDuplicates(["sketch_key"])
    return by_batch(keyed, make, f"sketch_key bigint, sketch struct<{fields}>")


def _may_be_similar(one: Column, two: Column, least: float) -> Column:
    """Whether two texts can share ``least`` of their runs, by their sketches. A cell that only one text has holds a run that the
    other has not, so all pairs that can be verified pass."""

    def apart(a: Column, b: Column) -> Column:
        return sum((F.bit_count(a[f"w{i}"].bitwiseAND(F.bitwise_not(b[f"w{i}"]))) for i in range(CELLS // 64)), F.lit(0))

    common = F.least(one["n"] - apart(one, two), two["n"] - apart(two, one))
    return common >= F.lit(least) * (one["n"] + two["n"] - common)


def similar_pairs(pairs: DataFrame, docs: DataFrame, least: float = SIMILAR, text: str = "text") -> DataFrame:
    """Those of ``pairs`` ``(a, b)`` of text keys whose texts share ``least`` or more of their distinct runs of
    ``SHINGLE`` words, by the runs themselves. Two texts without words are alike."""
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("__end")).distinct())
    texts = written(
        docs.select(text_key(text).alias("__key"), whole(text).alias("text"))
        .join(ends, F.col("__key") == F.col("__end"), "left_semi").dropDuplicates(["__key"]))
    left, right = (texts.select(F.col("__key").alias(f"__{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(left, F.col("a") == F.col("__a")).join(right, F.col("b") == F.col("__b")).select("a", "b", "text_a", "text_b")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok, last, known = [], None, set()
        for b, one, two in zip(batch.column(1), batch.column(2), batch.column(3)):
            # Rows come in the order of b.
            if b.as_py() != last:
                last, known = b.as_py(), _runs(two.as_py())
            own = _runs(one.as_py())
            common = len(own & known)
            ok.append(common >= least * (len(own) + len(known) - common))
        return pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    return by_batch(both, make, "a bigint, b bigint")


def _runs(text: str) -> set[bytes]:
    return set(shingles(text.encode().translate(LOWER_BYTES).split(), SHINGLE))


def _print_groups(docs: DataFrame, kinds: tuple[tuple[int, int], ...], radius: int, text: str) -> DataFrame:
    """``(band, bucket, text_key)``: texts whose fingerprints of one kind are equal, or reach each other over steps of at most
    ``radius`` bits; the kinds come after the bands."""
    prints = written(fingerprints(docs, kinds, text).select("text_key", F.posexplode("prints").alias("kind", "print")).distinct())
    near = written(near_pairs(prints.select("kind", "print"), radius))
    named = [F.struct("kind", F.col(x).alias("print")).alias(x) for x in "ab"]
    rooted = written(components(near.select(*named)).select("node.kind", "node.print", F.col("root.print").alias("root")))
    ends = rooted.select(F.col("kind").alias("__kind"), F.col("print").alias("__print"), "root")
    return prints.join(ends, (F.col("kind") == F.col("__kind")) & (F.col("print") == F.col("__print")), "left").select(
        (F.col("kind") + BANDS).alias("band"), F.coalesce("root", "print").alias("bucket"), "text_key")


def similar_components(docs: DataFrame, kinds: tuple[tuple[int, int], ...] = KINDS, radius: int = 3, text: str = "text") -> DataFrame:
    """``(node, root)`` of text keys that verified links join: see ``drop_near_copies``.

    Buckets are what bands of least hashes and groups of fingerprints bring together. In each turn, some texts of a bucket
    are its centres, first one, then about 8 times as many each time. Those that are not of a centre's component
    are verified against it; a centre has then met all others and leaves the bucket. A bucket that has come to one
    component is done. So a group of copies takes pairs in proportion to its size, and texts that only look alike are
    done after few turns. The first centre is chosen by one order for all buckets, so that buckets with the same texts
    propose the same pairs. Pairs whose sketches show that they share too few runs are not proposed.
    """
    found = written(band_table(docs, text).unionByName(_print_groups(docs, kinds, radius, text)))
    shared = written(found.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    open_ = written(found.join(shared, ["band", "bucket"]).select("band", "bucket", "text_key", F.col("text_key").alias("root")))
    met_somewhere = written(open_.select("text_key").distinct())
    sketches = written(sketch_table(
        docs.select(text_key(text).alias("text_key"), whole(text).alias("text")).join(met_somewhere, "text_key", "left_semi")))
    tried = rooted = None
    turn = 0
    while True:
        rank = F.xxhash64("text_key", F.lit(turn)).bitwiseAND(F.lit((1 << 31) - 1))
        ranked = open_.withColumn("rank", rank)
        sizes = written(ranked.groupBy("band", "bucket").agg(F.min(F.struct("rank", "text_key")).alias("first"), F.count("*").alias("n")))
        ranked = ranked.join(sizes, ["band", "bucket"]).withColumn(
            "chosen", (F.col("text_key") == F.col("first.text_key")) | (F.col("rank") * F.col("n") < (GROWTH**turn - 1) * (1 << 31)))
        ranked = written(ranked.join(sketches, F.col("text_key") == F.col("sketch_key")).select(
            "band", "bucket", "text_key", "root", "chosen", "sketch"))
        centres = ranked.where("chosen").select(
            "band", "bucket", F.col("text_key").alias("centre"), F.col("root").alias("centre_root"), F.col("sketch").alias("centre_sketch"))
        met = ranked.join(centres, ["band", "bucket"])
        pairs = met.where((F.col("root") != F.col("centre_root")) & _may_be_similar(F.col("sketch"), F.col("centre_sketch"), SIMILAR)).select(F.greatest("text_key", "centre").alias("a"), F.least("text_key", "centre").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = written(similar_pairs(pairs, docs, SIMILAR, text))
        if rooted is None:
            rooted = written(components(new))
        elif not new.isEmpty():
            # What is known of components stands for the links they come from.
            rooted = written(components(new.unionByName(rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))))
        named = written(
            ranked.where("not chosen").select("band", "bucket", "text_key").join(rooted, F.col("text_key") == F.col("node"), "left")
            .select("band", "bucket", "text_key", F.coalesce("root", "text_key").alias("root")))
        mixed = written(named.groupBy("band", "bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").drop("x", "y"))
        if mixed.isEmpty():
            return rooted
        open_ = written(named.join(mixed, ["band", "bucket"]))
        turn += 1


def drop_near_copies(docs: DataFrame, kinds: tuple[tuple[int, int], ...] = KINDS, radius: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with one row, that of the smallest doc_id, for each group of near copies, columns as they are, whatever their
    names.

    Texts are linked if they share 0.8 or more of their distinct runs of five words, A-Z in lower case; every link is
    verified on the texts. Pairs are proposed by fingerprints of ``kinds`` within ``radius`` bits and by bands of least
    hashes. Groups are what links reach. Null texts count as empty, and all texts without words are one group; rows
    that repeat a doc_id and its text leave one row; no rows give no rows.

    A filter of the texts whose groups have several rows tells which rows may have to go. All others stay where they are.
    """
    rooted = similar_components(docs, kinds, radius, text)
    short = docs.select("doc_id", text_key(text).alias("text_key")).join(rooted, F.col("text_key") == F.col("node"), "left").select(
        F.struct(F.isnull("doc_id").alias("lost"), "doc_id", "text_key").alias("row"), F.coalesce("root", "text_key").alias("root"))
    groups = written(short.groupBy("root").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    texts = written(
        groups.select("root", "first").join(rooted, "root", "left").select(F.coalesce("node", "root").alias("own"), "first")
        .unionByName(groups.select(F.col("root").alias("own"), "first")).distinct())
    rows = docs.select(rows_of(docs), text_key(text).alias("text_key"))
    copied, alone = parted(rows, key_filter(texts, "own"), "text_key")
    one = Window.partitionBy("text_key").orderBy(F.lit(1))
    is_first = F.col("own").isNull() | (F.col("text_key") == F.col("first.text_key")) & F.col("row.doc_id").eqNullSafe(F.col("first.doc_id"))
    met = copied.join(texts, F.col("text_key") == F.col("own"), "left").where(is_first).withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return alone.select("row.*").unionByName(met.select("row.*"))
