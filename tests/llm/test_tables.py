"""Collocations, manifests and BPE against plain loops, and on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuespan.llm import bpe, collocations, merkle, queries
from tests.llm import brute
from tests.llm.conftest import ODD, documents

SPECIAL = [
    (50, "a <|endoftext|> b<|endoftext|><|endoftext|>"), (51, "tabs\t   é́ \x85 ﬀ"), (52, "it's we'll 'S 12٣ ​　x  \n\n y ' s"),
    (53, "<|endoftext|"), (54, " <|endoftext|> "),
]


def lang_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string")


def phrases(rows, support=10, longest=3, top=2000):
    """Counts in dictionaries, products in Python's integers."""
    f, total = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.lower(text)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        found = []
        for p, a in frequent.items():
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            around = any(100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in frequent.items() if len(q) > len(p))
            if not around:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def told(found):
    return sorted(tuple(r) for r in found.select(*COLUMNS).collect())


def test_collocations_equal_a_loop(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.select("doc_id", "lang", "text").collect()]
    assert told(collocations.collocations(docs)) == phrases(rows)


@pytest.mark.parametrize("shards, longest, support", [(1, 3, 4), (3, 4, 4), (9, 2, 10), (40, 5, 6)])
def test_collocations_by_other_parameters(spark, shards, longest, support):
    rows = [(i, ("en", None, "de")[i % 3], "a b c d e. a b! A b c d e f, g a b c d e; x y x y x y x" + " a b c d e" * (i % 4)) for i in range(12)]
    rows += [(99, "en", "the copy of one " * 30)] * 20
    found = collocations.collocations(lang_rows(spark, rows), support=support, longest=longest, shards=shards)
    assert told(found) == phrases(rows, support, longest)


def test_a_phrase_spread_evenly_over_shards_is_found(spark):
    rows = [(i, "en", f"alone{i} new york number{i}") for i in range(10)]
    assert [r[2:4] for r in told(collocations.collocations(lang_rows(spark, rows)))] == [("new york", 10)]


def test_collocations_rank_ties_and_keep_the_best(spark):
    rows = [(i, "en", "b c! a b? é z; Z z") for i in range(10)]
    assert told(collocations.collocations(lang_rows(spark, rows), top=2)) == phrases(rows, top=2)
    assert len(told(collocations.collocations(lang_rows(spark, rows)))) == 4


def test_collocation_scores_pass_64_bits(spark):
    big = 2_000_000_000
    counts = spark.createDataFrame(
        [("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big)], "lang string, size int, phrase string, f bigint")
    assert collocations.scored(counts, 3).first()["score"] == 1000000 * big * big // (6 * big * big)


def test_collocations_odd_rows(spark, odd, none, repeated):
    langs = F.when(F.col("doc_id") % 2 == 0, "en")
    for docs in (odd, repeated):
        rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.withColumn("lang", langs).collect()]
        assert told(collocations.collocations(docs.withColumn("lang", langs))) == phrases(rows)
    assert collocations.collocations(none.withColumn("lang", langs)).count() == 0


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root, and each leaf's siblings as (left, right) by level."""
    paths, place, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(place):
            low = at // 8 * 8
            paths[i].append((level[low:at], level[at + 1:low + 8]))
        level = [h(level[i:i + 8]) for i in range(0, len(level), 8)]
        place = [at // 8 for at in place]
    return level[0], paths


def manifest(rows):
    """Sorted result rows of ``(doc_id, source, lang, n_chars, text)``."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for row in rows:
        leaf = h(enc(v) for v in row)
        chosen = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        other = (*row[:4], brute.lower(row[4]) if chosen and row[4] is not None else row[4])
        by[row[2]].append((row[0], leaf, h(enc(v) for v in other)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        done[lang] = tree([x[1] for x in by[lang]])
    if not langs:
        return []
    root, tops = tree([done[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        subroot, paths = done[lang]
        for (doc, leaf, shown), path in zip(by[lang], paths):
            fold, proof = shown, []
            for left, right in path + top:
                fold = h(left + [fold] + right)
                proof += left + right
            out.append((doc, leaf, subroot, root, h(proof), fold, fold == root))
    return sorted(out, key=repr)


FIELDS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def manifest_rows(spark, rows, tmp_path, name):
    folder = tmp_path / name
    spark.createDataFrame(rows, FIELDS).write.parquet(str(folder / "documents.parquet"))
    return sorted((tuple(r) for r in queries.op12_manifest(spark, str(folder)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (2,), (8, 1), (9, 64, 3), (65, 0, 8), (600, 1, 20)])
def test_manifest_equals_a_loop(spark, tmp_path, sizes):
    rows = [(1000 * k + i, "web" if i % 3 else None, (None, "de", "en")[k], i, f"Text NUMBER {i}" if i % 5 else None)
            for k, n in enumerate(sizes) for i in range(n)]
    assert manifest_rows(spark, rows, tmp_path, "t") == manifest(rows)


def test_manifest_with_many_trees(spark, tmp_path):
    rows = [(i, "s", f"l{i % 100}", 1, "ABC") for i in range(230)]
    assert manifest_rows(spark, rows, tmp_path, "t") == manifest(rows)


def test_manifest_shuffles_large_tables_of_ancestors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    rows = [(i, "s", ("en", "de")[i % 7 == 0], 1, f"T{i}") for i in range(700)]
    assert manifest_rows(spark, rows, tmp_path, "t") == manifest(rows)


def test_manifest_odd_rows(spark, tmp_path):
    rows = [(i, None, "en", None, t) for i, t in ODD]
    assert manifest_rows(spark, rows, tmp_path, "odd") == manifest(rows)
    twice = rows + rows + [(None, "a", None, 1, "Lost"), (None, "a", None, 1, "Lost"), (None, "b", "", 1, "")]
    assert manifest_rows(spark, twice, tmp_path, "twice") == manifest(twice)
    assert manifest_rows(spark, [], tmp_path, "none") == []


def test_manifest_leaves_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "t", "x", 7, "y")], FIELDS + ", tree string, at int, `a.b` string")
    assert [tuple(r[:1]) for r in merkle.manifest(docs, carry={"tree": F.col("tree")}).collect()] == [(1,)]


def coded(docs, table_words, frequent):
    found = bpe.decode(bpe.encode(docs, queries.TOKENIZER, table_words=table_words, frequent=frequent), queries.TOKENIZER)
    return found.withColumn("sha", bpe.ids_sha256("ids")).collect()


@pytest.mark.parametrize("table_words, frequent", [(4_000_000, 0), (0, 1_000_000), (0, 50), (0, 0)])
def test_bpe_equals_the_library(spark, odd, table_words, frequent):
    slow = Tokenizer.from_file(queries.TOKENIZER)
    special = spark.createDataFrame(SPECIAL, "doc_id bigint, text string")
    for docs in (odd.select("doc_id", "text").unionByName(special), documents(spark).select("doc_id", "text")):
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        rows = coded(docs, table_words, frequent)
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
        for r in rows:
            want = slow.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert list(r["ids"]) == want
            assert r["decoded"] == slow.decode(want, skip_special_tokens=False) == texts[r["doc_id"]]
            assert r["sha"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("table_words", [4_000_000, 0])
def test_bpe_odd_rows(spark, none, repeated, table_words):
    assert coded(none, table_words, 0) == []
    rows = coded(repeated, table_words, 3)
    assert len(rows) == 2 * len(ODD) + 2
    texts = {brute.sha(t or ""): t or "" for _, t in ODD}
    assert all(r["decoded"] in texts.values() for r in rows)


@pytest.mark.parametrize("table_words, frequent", [(4_000_000, 0), (0, 3)])
def test_bpe_packs_and_decodes_in_one_step(spark, odd, none, table_words, frequent):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(SPECIAL, "doc_id bigint, text string"))
    both = bpe.encode(docs, queries.TOKENIZER, table_words=table_words, frequent=frequent, packed=True, decoded=True)
    want = {(r["doc_id"], r["text_key"]): (np.array(r["ids"], "<u4").tobytes(), r["decoded"]) for r in coded(docs, table_words, frequent)}
    assert {(r["doc_id"], r["text_key"]): (bytes(r["ids"]), r["decoded"]) for r in both.collect()} == want
    assert bpe.encode(none, queries.TOKENIZER, table_words=table_words, packed=True, decoded=True).collect() == []


def test_bpe_query_needs_one_python_worker_a_task(spark):
    plan = queries.op13_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_each_distinct_word_is_encoded_once(spark, odd):
    words = {r["word"]: r["n"] for r in bpe.word_table(odd.unionByName(odd), queries.TOKENIZER).collect()}
    counts = Counter(w for _, t in ODD for w in bpe.splitter(queries.TOKENIZER)(t or ""))
    assert words == {w: 2 * n for w, n in counts.items()}


def test_decode_of_any_ids(spark):
    slow = Tokenizer.from_file(queries.TOKENIZER)
    lists = [[], [50256], [128, 161, 162], [222, 50256, 222], list(range(300))]
    docs = spark.createDataFrame(list(enumerate(lists)) + [(9, None)], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(docs, queries.TOKENIZER).collect()}
    assert got == {i: slow.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)} | {9: ""}


def test_words_are_cut_as_the_library_cuts_them():
    slow = Tokenizer.from_file(queries.TOKENIZER)
    for text in ("a  b \n c\n\n d ", " lead", "x\t y \t", "it's  'S ", "   ", "", "1 2,3 ä-é z", "two words'll do", "漢 字 a"):
        assert bpe.splitter(queries.TOKENIZER)(text) == [text[a:b] for _, (a, b) in slow.pre_tokenizer.pre_tokenize_str(text)]


def test_texts_are_looked_up_some_at_a_time(monkeypatch):
    monkeypatch.setattr(bpe, "LOOKED_UP", 5)
    texts = pa.array(["abc", "", "d", "x" * 20, None, "ef", "ghij"])
    got = list(bpe._slices(texts))
    assert got[0][0] == 0 and got[-1][1] == len(texts) and all(a < b == c for (a, b), (c, _) in zip(got, got[1:]))
    assert all(b - a == 1 or sum(len(t.as_py() or "") for t in texts[a:b]) <= 5 for a, b in got)


def test_words_are_looked_up_by_themselves(spark, monkeypatch):
    words = ["a", " b", "long word", "é", "", "zz"]
    df = spark.createDataFrame([(w, np.arange(i, dtype="<u4").tobytes()) for i, w in enumerate(words)], "word string, ids binary")
    table = bpe._broadcast(df).value
    numbers = table.numbers([*words, "none", " b"])
    assert (numbers[:6] > 0).all() and numbers[6] == 0 and numbers[7] == numbers[1]
    ids, ends = table.spread(numbers[[5, 0, 2]])
    assert ids.tolist() == [0, 1, 2, 3, 4, 0, 1] and ends.tolist() == [5, 5, 7]
    assert bpe._broadcast(df.where("false")).value.numbers(["x"]).tolist() == [0]
