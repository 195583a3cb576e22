import random

from cuespan import sequence as seq
from cuespan.folds import Fold, fold_tracks
from tests.conftest import rows


def _table(spark, n=60, tracks=3, seed=1):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        # One track has most of the rows.
        track = 0 if rnd.random() < 0.6 else rnd.randrange(1, tracks)
        data.append((track, i, rnd.choice([None, rnd.randrange(100)]), rnd.randrange(10)))
    return data, spark.createDataFrame(data, "track bigint, n bigint, a bigint, b bigint").repartition(3)


def _by_hand(data):
    out = []
    for track in {d[0] for d in data}:
        mine = sorted(d for d in data if d[0] == track)
        for i, (_, n, a, b) in enumerate(mine):
            before, after = mine[:i], mine[i + 1 :]
            seen = [x[2] for x in before if x[2] is not None]
            coming = [x[2] for x in after if x[2] is not None]
            peak = [x[2] for x in before + [mine[i]] if x[2] is not None]
            out.append((
                track, n,
                mine[i - 1][2] if i else None,
                mine[i + 1][2] if after else None,
                i + 1,
                sum(x[3] for x in before) + b,
                sum(x[3] for x in before),
                max(peak) if peak else None,
                max(seen) if seen else None,
                a if a is not None else (seen[-1] if seen else None),
                seen[-1] if seen else None,
                a if a is not None else (coming[0] if coming else None),
                coming[0] if coming else None,
                min(x[3] for x in mine), max(x[3] for x in mine), sum(x[3] for x in mine),
            ))
    return sorted(out, key=repr)


def test_all_kinds_of_ordered_columns(spark, hot):
    data, df = _table(spark)
    got = seq.extend(
        df, ["n"],
        {
            "c1": seq.prev("a"), "c2": seq.following("a"), "c3": seq.position(), "c4": seq.total("b"),
            "c5": seq.total_before("b"), "c6": seq.peak("a"), "c7": seq.peak_before("a"), "c8": seq.last_seen("a"),
            "c9": seq.last_seen_before("a"), "c10": seq.next_seen("a"), "c11": seq.next_seen_after("a"),
            "c12": seq.whole_min("b"), "c13": seq.whole_max("b"), "c14": seq.whole_sum("b"),
        },
    )
    assert rows(got, "track", "n", *[f"c{i}" for i in range(1, 15)]) == _by_hand(data)


def test_size_check_sees_the_largest_track(spark, hot):
    _, df = _table(spark)
    assert seq.too_long(df) is hot


def test_shared_values_of_the_order_within_pieces(spark, hot):
    df = spark.createDataFrame([(1, i // 4, i) for i in range(40)], "track int, t int, i int")
    got = seq.extend(df, ["t", "i"], {"no": seq.position()})
    assert rows(got, "i", "no") == sorted(((i, i + 1) for i in range(40)), key=repr)


class _Clusters(Fold):
    """Closes a cluster when the distance to its first member exceeds 10."""

    def fresh(self):
        return None

    def step(self, state, row):
        (x,) = row
        if state is None:
            return [x, 1], []
        if x - state[0] > 10:
            return [x, 1], [tuple(state)]
        return [state[0], state[1] + 1], []

    def finish(self, state):
        return [tuple(state)] if state else []


def test_fold_in_pieces_equals_fold_of_whole_tracks(spark, hot):
    rnd = random.Random(3)
    data = [(rnd.choice([0, 0, 0, 1, 2]), x) for x in sorted(rnd.sample(range(600), 150))]
    want = []
    for track in (0, 1, 2):
        first, n = None, 0
        for x in [d[1] for d in data if d[0] == track]:
            if first is not None and x - first > 10:
                want.append((track, first, n))
                first, n = x, 0
            first, n = (x if first is None else first), n + 1
        want.append((track, first, n))
    df = spark.createDataFrame(data, "track int, x int").repartition(4)
    got = fold_tracks(df, _Clusters(), ["x"], ["x"], "first bigint, n bigint")
    assert rows(got) == sorted(want, key=repr)


def test_fold_whose_state_never_forgets(spark, hot):
    class Sum(Fold):
        def fresh(self):
            return 0

        def step(self, state, row):
            return state + row[0], [(row[0], state + row[0])]

    df = spark.createDataFrame([(7, i) for i in range(1, 31)], "track int, x bigint")
    got = fold_tracks(df, Sum(), ["x"], ["x"], "x bigint, total bigint")
    assert rows(got, "x", "total") == sorted(((i, i * (i + 1) // 2) for i in range(1, 31)), key=repr)
