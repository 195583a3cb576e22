"""Exact, near, line and substring dedup against plain loops."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cuespan.llm import components, exact, lines, sentences, simhash
from tests.llm import brute
from tests.llm.conftest import ODD, documents, pairs


def test_simhash_equals_loop(spark, odd):
    for docs in (odd, documents(spark)):
        got = {r[0]: (f"{r['print'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.simhash_components(docs).collect()}
        assert got == brute.simhash_components(pairs(docs))


def test_simhash_links_chain(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 0b111, base ^ 0b111111, base ^ (0xF << 40), base ^ (1 << 63)]
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    df = spark.createDataFrame([(0, p) for p in signed], "kind int, print bigint")
    got = {frozenset(r) for r in simhash.near_pairs(df).select("a", "b").collect()}
    want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[i + 1:] if (a ^ b).bit_count() <= 3}
    assert got == want and len(want) == 3


def test_near_pairs_loses_none(spark):
    import random

    rnd, values = random.Random(3), set()
    for _ in range(40):
        p = rnd.getrandbits(64)
        for _ in range(6):
            q = p
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                q ^= 1 << b
            values.add(q - (1 << 64) if q >= 1 << 63 else q)
    df = spark.createDataFrame([(0, p) for p in values], "kind int, print bigint")
    got = Counter(tuple(r) for r in simhash.near_pairs(df).select("a", "b").collect())
    mask = (1 << 64) - 1
    want = Counter((a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 3)
    assert got == want


def test_components_of_path_star_and_cycle(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(202, 201), (201, 203), (203, 202), (5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 201: 201, 202: 201, 203: 201}
    assert got == want


def test_near_copies_leave_one(spark, odd, none, repeated):
    assert simhash.drop_near_copies(none).count() == 0
    out = simhash.drop_near_copies(repeated)
    assert out.columns == odd.columns
    ids = [r[0] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and not {2, 3, 13} & set(ids)
    text = " ".join(f"word{i}" for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, text.replace("word200", "other")), (3, " ".join(f"more{i}" for i in range(400)))],
                                 "doc_id bigint, text string")
    assert sorted(r[0] for r in simhash.drop_near_copies(docs).select("doc_id").collect()) == [1, 3]


def _near_groups(docs):
    """doc_id to the smallest of its group, all pairs compared by their five-word runs."""
    runs = {d: set(simhash.shingles(brute.lower(t).encode().split(), 5)) for d, t in docs}
    root = {d: d for d in runs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in runs:
        for b in runs:
            common = len(runs[a] & runs[b])
            if a < b and common >= 0.8 * (len(runs[a]) + len(runs[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in runs}


def test_near_copies_equal_loop(spark):
    """Scattered edits stay copies; another order of the same words and less likeness do not."""
    import random

    rnd, docs = random.Random(4), []
    for g in range(12):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([8, 60, 200, 400]))]
        docs += [base, rnd.sample(base, len(base))]
        for edits in (1, 2, 4, 6, 9, 14, 20):
            own = base[:]
            for at in rnd.sample(range(len(own)), min(edits, len(own) // 2)):
                own[at] = f"x{rnd.randrange(5000)}"
            docs.append(own)
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    out = simhash.drop_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string"))
    want = set(_near_groups(docs).values())
    assert {r[0] for r in out.select("doc_id").collect()} == want and 24 < len(want) < len(docs) - 12


def test_large_groups_of_near_copies_take_few_pairs(spark, monkeypatch):
    """One group of 2000 variants, a word or two apart from their text, and texts that share half of their words."""
    import random

    rnd = random.Random(5)
    base = [f"word{i}" for i in range(120)]

    def variant(words, n):
        words = list(words)
        for at in rnd.sample(range(len(words)), n):
            words[at] = f"other{rnd.random()}"
        return " ".join(words)

    rows = [(i, variant(base, 1 + i % 2)) for i in range(2000)]
    rows += [(5000 + i, " ".join(base[:60] + [f"own{i}x{j}" for j in range(60)])) for i in range(60)]
    tried = []
    verify = simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda pairs, *args: tried.append(pairs.count()) or verify(pairs, *args))
    left = {r[0] for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id").collect()}
    assert left == {0} | {5000 + i for i in range(60)}
    assert sum(tried) < 10 * len(rows)


CLASHES = ("__own", "__id", "__key", "a.b", "node", "root", "text_key", "TEXT_KEY2", "row", "digest", "keep_id", "own", "first", "nth", "__place",
           "bucket", "own_id", "own_key", "quality", "n", "group_size", "back`tick")


def test_texts_that_share_too_few_runs_are_not_proposed(spark, monkeypatch):
    """All texts share a bucket; of the pairs, those that could be similar are proposed, and all that are."""
    import random

    rnd = random.Random(5)
    shared = [f"s{i}" for i in range(150)]
    apart = [" ".join([*shared, *(f"t{n}x{i}" for i in range(150))]) for n in range(30)]
    near = [" ".join([*apart[0].split()[:-k], *(f"n{k}y{i}" for i in range(k))]) for k in range(20, 45)]
    texts = apart + near + ["", " ", "one two"]
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    known = {r.key: r.text for r in docs.select(simhash.text_key("text").alias("key"), "text").collect()}
    monkeypatch.setattr(simhash, "band_table", lambda d, text: d.select(
        F.lit(0).alias("band"), F.lit(0).cast("bigint").alias("bucket"), simhash.text_key(text).alias("text_key")).distinct())
    monkeypatch.setattr(simhash, "_print_groups", lambda d, kinds, radius, text: simhash.band_table(d, text).where("false"))
    proposed, verify = [], simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda pairs, *args: proposed.extend(map(tuple, pairs.collect())) or verify(pairs, *args))
    roots = {known[r.node]: r.root for r in simhash.similar_components(docs).collect()}
    runs = {t: simhash._runs(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if len(runs[a] & runs[b]) >= simhash.SIMILAR * len(runs[a] | runs[b]):
                assert roots[a] == roots[b]
    far = [p for p in proposed if len({known[k] for k in p} & set(apart[1:])) == 2]
    assert not far and len(set(roots.values())) < len(near)


def test_stages_keep_columns_of_any_name(spark):
    from cuespan.llm import decontaminate, quality

    rows = [(i, t, *[f"{name}-{i}" for name in CLASHES]) for i, t in ODD]
    kinds = ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {kinds}")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    bench = spark.createDataFrame([(1, "long words again and long words again and long words again")], "item_id bigint, text string")
    whole = {r[0]: tuple(r) for r in docs.collect()}
    for out in (quality.keep_good(docs, labels), exact.drop_exact_copies(docs), simhash.drop_near_copies(docs), decontaminate.drop_contaminated(docs, bench)):
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and all(whole[r[0]] == r for r in got)
    assert 12 not in {r[0] for r in decontaminate.drop_contaminated(docs, bench).select("doc_id").collect()}


def test_filters_of_keys_miss_none(spark):
    from cuespan.llm.texts import key_filter, parted

    docs = spark.range(5000).withColumnRenamed("id", "doc_id")
    inside, outside = parted(docs, key_filter(docs.where("doc_id % 7 = 0"), "doc_id"), "doc_id")
    ids = {r[0] for r in inside.collect()}
    assert set(range(0, 5000, 7)) <= ids and len(ids) < 800
    assert ids | {r[0] for r in outside.collect()} == set(range(5000)) and inside.count() + outside.count() == 5000


def test_simhash_odd_rows(none, repeated):
    assert simhash.simhash_components(none).count() == 0
    rows = simhash.simhash_components(repeated).collect()
    assert len(rows) == 2 * len(ODD) + 2
    assert {r["component_id"] for r in rows if r["doc_id"] is None} <= {4, 7}


@pytest.mark.parametrize("heavy,tracked", [(256, 8192), (2, 16)])
def test_exact_equals_loop(spark, odd, heavy, tracked):
    for docs in (odd, documents(spark)):
        groups = defaultdict(list)
        for d, t in pairs(docs):
            groups[brute.sha(brute.lower(t))].append(d)
        want = sorted((d, g, max(ids), len(ids), d == max(ids)) for g, ids in groups.items() for d in ids)
        assert sorted(tuple(r) for r in exact.exact_groups(docs, heavy=heavy, tracked=tracked).collect()) == want
        left = exact.drop_exact_copies(docs, heavy=heavy, tracked=tracked)
        assert left.columns == docs.columns
        assert sorted(r[0] for r in left.select("doc_id").collect()) == sorted(max(ids) for ids in groups.values())


def test_exact_odd_rows(odd, none, repeated):
    assert exact.exact_groups(none).count() == 0 and exact.drop_exact_copies(none).count() == 0
    once = sorted(r[0] for r in exact.drop_exact_copies(odd).select("doc_id").collect())
    assert sorted(r[0] for r in exact.drop_exact_copies(repeated).select("doc_id").collect()) == once
    assert exact.exact_groups(repeated).count() == 2 * len(ODD) + 2


def test_lines_equal_loop(spark, odd):
    for docs in (odd, documents(spark)):
        rows = pairs(docs)
        want = brute.kept_lines(rows)
        got = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs).collect()}
        assert {d: [int(x) for x in r["dropped"].split(",") if x] for d, r in got.items()} == want
        for d, t in rows:
            cut = (t or "").split("\n")
            assert got[d]["text"] == "\n".join(x for i, x in enumerate(cut) if i not in want[d])
            assert got[d]["n_lines"] == len(cut)


def test_lines_one_edit(spark):
    base = [f"w{i}" for i in range(12)]
    changed, more, less = base[:], base[:4] + ["new"] + base[4:], base[:7] + base[8:]
    changed[3] = "x"
    two = changed[:]
    two[9] = "y"
    swapped = base[:2] + [base[3], base[2]] + base[4:]
    texts = [" ".join(w) for w in (base, changed, more, less, two, swapped, ["z", *base[1:]], base[:-1], ["a"] * 9, ["a"] * 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: [int(x) for x in r["dropped"].split(",") if x] for r in lines.drop_repeated_lines(docs).collect()}
    assert got == brute.kept_lines(list(enumerate(texts)))
    assert got[1] == got[2] == got[3] == [0] and got[5] == []


def test_lines_odd_rows(none, repeated, spark):
    assert lines.drop_repeated_lines(none).count() == 0
    rows = lines.drop_repeated_lines(repeated).collect()
    assert len(rows) == 2 * len(ODD) + 2
    assert len({tuple(r) for r in rows if r["doc_id"] == 16}) == 1


def _repeats(docs, run=sentences.RUN, least=sentences.LEAST_WORDS):
    found, first = [], {}
    for d, t in sorted(docs):
        units = sentences.sentences(t or "")
        for span, a, b in sentences.spans(units, run, least):
            first.setdefault(span, (d, a))
            found.append((span, d, a, units[a][0], units[b][1]))
    gone = defaultdict(set)
    for span, d, a, start, end in found:
        if first[span] != (d, a):
            gone[d] |= set(range(start, end))
    return gone


def test_substrings_equal_loop(spark, odd):
    for docs in (odd, documents(spark)):
        rows = pairs(docs)
        want = _repeats(rows)
        texts = dict(rows)
        for r in sentences.remove_repeats(docs).collect():
            ranges = [tuple(map(int, x.split(":"))) for x in r["removed"].split(",") if x]
            gone = set().union(*(range(a, b) for a, b in ranges))
            assert {i for i in gone if not texts[r["doc_id"]][i].isspace()} == {
                i for i in want[r["doc_id"]] if not texts[r["doc_id"]][i].isspace()}
            assert r["n_removed"] == len(ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
            if not ranges:
                assert r["text"] == (texts[r["doc_id"]] or "")


def test_passages_are_caught(spark):
    import random

    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))

    def prose(n):
        return " ".join(word() + rnd.choice([""] * 9 + [".", ","]) for _ in range(n))

    for passage in (prose(60), " ".join(word() for _ in range(60))):
        docs = [(i, f"{prose(70)} {passage} {prose(50)}") for i in range(6)] + [(9, prose(200))]
        df = spark.createDataFrame(docs, "doc_id bigint, text string")
        out = {r["doc_id"]: r for r in sentences.remove_repeats(df).collect()}
        assert out[0]["n_removed"] == 0 and out[9]["n_removed"] == 0
        for i in range(1, 6):
            assert len(out[i]["text"].split()) <= 120 + 30 and out[i]["n_removed"] >= 1


@pytest.mark.parametrize("marks", [[""], [""] * 9 + [".", ","], [""] * 12 + [". "]])
def test_passages_inside_other_sentences(marks):
    """By brute force: of each passage of 51 words, over half is in runs that its copy has too."""
    import random

    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) + rnd.choice(marks) for _ in range(n))

    for _ in range(1500):
        passage = prose(51)
        one, two = ((f"{prose(rnd.randint(5, 30))} {passage}", prose(rnd.randint(5, 30))) for _ in range(2))
        places = []
        for before, after in (one, two):
            units = sentences.sentences(f"{before} {after}")
            places.append([(h, units[a][0], units[b][1]) for h, a, b in sentences.spans(units)])
        known, start = {h for h, *_ in places[0]}, len(two[0]) - len(passage)
        covered = set().union(*(range(a, b) for h, a, b in places[1] if h in known))
        starts = [start + i for i in range(len(passage)) if passage[i] != " " and (i == 0 or passage[i - 1] == " ")]
        assert 2 * sum(i in covered for i in starts) > 51


def test_substrings_odd_rows(none, repeated):
    assert sentences.remove_repeats(none).count() == 0
    rows = sentences.remove_repeats(repeated).collect()
    assert len(rows) == 2 * len(ODD) + 2


def test_no_python_on_native_paths(odd):
    for df in (exact.exact_groups(odd), lines.drop_repeated_lines(odd)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert odd.select(F.lit(1)).count()
