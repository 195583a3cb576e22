"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.llm.texts import by_batch, give_back, key_filter, parted, whole
from cuespan.session import written

SEED = 42
FEATURES = 128
WIDTH = 4.0
RIDGE = 1.0
STEPS = 1024

_KINDS = np.zeros(256, np.int64)  # other bytes 0, and of those below
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r",
                                b"\n", b".?", b",;:'\"()-", b"!", b"#$%&*@^_~|<>{}[]\\/=+`"), 1):
    _KINDS[list(_bytes)] = _kind
_HIGH = np.arange(256) >= 128
STATISTICS = 20


def statistics(text: str) -> list[float]:
    """What a text looks like, whatever its language: sizes, shares of kinds of bytes, repetition. Zeros
    where a text has nothing to count."""
    raw = text.encode()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, words, lines = max(1, len(raw)), raw.split(), raw.split(b"\n")
    kinds = np.bincount(_KINDS, weights=seen, minlength=10) / size
    many = max(1, len(words))
    share = seen[seen > 0] / size
    plain = words[1:]
    capital = sum(w[:1].isupper() for w in plain)
    marked = sum(not (w[-1:].isalnum() or w[-1] >= 128) for w in words)
    odd = sum(w[-1:] in b"!#$%&*@^_~|<>{}[]\\/=+`" for w in words)
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(np.log1p(len(lines))),
        *kinds[1:].tolist(), float(seen[_HIGH].sum() / size), float(-(share * np.log(share)).sum()),
        len(raw) / many, len(set(words)) / many, len(set(lines)) / len(lines), capital / many, marked / many, odd / many,
    ]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATISTICS)


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, statistics)`` per row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(v.as_py()) for v in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "statistics"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", whole(text).alias("text")), make,
                    f"doc_id {kind}, statistics array<double>")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3: 1 is held out, 0 and 2 train. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(1)).cast("int")


class Fourier:
    """cos(Wx + b) of standardised statistics: inner products approximate a Gaussian kernel."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.centre, self.spread = centre, np.where(spread > 1e-9, spread, 1.0)
        self.slopes = random.normal(size=(STATISTICS, features)) / width
        self.shifts = random.uniform(0, 2 * np.pi, features)

    def __call__(self, statistics: np.ndarray) -> np.ndarray:
        x = np.clip((statistics - self.centre) / self.spread, -8, 8)
        waves = np.sqrt(2 / len(self.shifts)) * np.cos(x @ self.slopes + self.shifts)
        return np.hstack([waves, np.ones((len(x), 1))])


def isotonic(score: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted score steps: knots (score, share of good) of a rising line."""
    blocks: list[list[float]] = []
    for s, g, n in zip(score, good, count):
        blocks.append([s * n, g, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks)
    # A prior of one good and one bad row keeps shares off 0 and 1.
    return table[:, 0] / table[:, 2], (table[:, 1] + 0.5) / (table[:, 2] + 1)


class Model:
    """Statistics to a score from 0 to 1."""

    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray] | None) -> None:
        self.fourier, self.weights, self.knots = fourier, weights, knots

    def __call__(self, statistics: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(statistics), 0.5)
        return np.interp(self.fourier(statistics) @ self.weights, *self.knots)


def _solve(gram: np.ndarray, moment: np.ndarray, ridge: float) -> np.ndarray:
    return np.linalg.solve(gram + ridge * np.eye(len(gram)), moment)


def fit(samples: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model of ``samples`` ``(statistics, fold, quality)``, all rows used; ``fold`` tells the halves apart.

    Every partition sums its normal equations, Spark adds them up by cell, and the driver, which sees
    ``features`` squared numbers for each half, solves. Scores of each half by the other half's weights
    go into ``STEPS`` equal steps; their counts fit the isotonic curve. Without rows of both labels, all
    scores are 0.5.
    """
    each = [F.col("statistics")[i] for i in range(STATISTICS)]
    about = samples.agg(F.count("*"), F.avg("quality"), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    if not about[0] or about[1] in (0, 1):
        return Model(None, None, None)
    wave = Fourier(np.array(about[2:2 + STATISTICS]), np.array(about[2 + STATISTICS:]), features, width, seed)
    upper = np.triu_indices(features + 1)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z, folds, y = wave(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
            for fold in np.unique(folds).tolist():
                own = folds == fold
                sums[fold] = sums.get(fold, 0) + np.concatenate([(z[own].T @ z[own])[upper], z[own].T @ y[own]])
        for fold, total in sums.items():
            cell = np.arange(len(total), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full_like(cell, fold)), pa.array(cell), pa.array(total)], ["fold", "cell", "value"])

    cells = (
        samples.mapInArrow(equations, "fold int, cell int, value double")
        .groupBy("fold", "cell").agg(F.sum("value").alias("value")).toPandas()
    )
    n = len(upper[0])
    halves = {}
    for fold, part in cells.groupby("fold"):
        total = np.zeros(n + features + 1)
        total[part["cell"]] = part["value"]
        gram = np.zeros((features + 1, features + 1))
        gram[upper] = total[:n]
        halves[fold] = (gram + np.triu(gram, 1).T, total[n:])
    weights = _solve(sum(g for g, _ in halves.values()), sum(m for _, m in halves.values()), ridge)
    of_other = {}
    for fold in halves:
        others = [h for f, h in halves.items() if f != fold] or [halves[fold]]
        of_other[fold] = _solve(sum(g for g, _ in others), sum(m for _, m in others), ridge)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([of_other[f] for f in batch.column(1).to_pylist()])
            score = np.clip((wave(_matrix(batch.column(0))) * own).sum(1), -0.5, 1.5)
            step = np.round((score + 0.5) / 2 * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(2).cast(pa.int32())], ["step", "quality"])

    counts = (
        samples.mapInArrow(steps, "step int, quality int").groupBy("step")
        .agg(F.sum("quality").alias("good"), F.count("*").alias("n")).toPandas().sort_values("step")
    )
    knots = isotonic(counts["step"].to_numpy() / STEPS * 2 - 0.5, counts["good"].to_numpy(float), counts["n"].to_numpy(float))
    return Model(wave, weights, knots)


def training_rows(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the labelled rows that may be learned from."""
    return found.join(labels.select("doc_id", "quality").where("quality is not null"), "doc_id").select(
        "statistics", fold_of(F.col("doc_id")).alias("fold"), F.col("quality").cast("int").alias("quality")).where("fold <> 1")


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``; ``labels`` has ``doc_id, quality``.

    Null texts count as empty and are scored as such; rows may repeat and score alike; a null doc_id
    is scored and never learned from; without labels every score is 0.5. Only the text is an input of a
    score.
    """
    found = written(document_statistics(docs, text))
    model = fit(written(training_rows(found, labels)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(_matrix(batch.column(1))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows predicted to be bad, columns as they are. Null texts are judged as empty ones, repeated
    rows alike; without labels all rows stay; no rows give no rows."""
    # Statistics are made where the texts are; only they meet the labels.
    labelled, _ = parted(docs.select("doc_id", text), key_filter(labels, "doc_id"), "doc_id")
    model = fit(written(training_rows(document_statistics(labelled, text), labels)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scores = pa.array(model(np.array([statistics(t.as_py()) for t in texts]).reshape(-1, STATISTICS)))
        give_back()
        return scores

    return docs.where(score(whole(text)) >= 0.5)
