"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.llm.spans import count_of, matches, overlaps, places, written_out
from cuespan.llm.texts import whole
from cuespan.session import written

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Matches that are too short fail and hold no longer one, so the length may stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
RUN = "[A-Za-z0-9+/_=-]{12,}"
#: Identifiers: words of one case or with a capital, short numbers, and marks.
ORDINARY = "^(?:(?:[A-Z][a-z]++|[a-z]{3,}+|[A-Z]{2,}+(?![a-z])|[0-9]{1,8}+(?![0-9]))[+/_=-]*+)++$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 16
#: How many ordinary words there are for each secret: the ratio of likelihoods must exceed it.
ODDS = 10_000.0
RANDOM_SAMPLES = 20_000
#: How many pairs of a first character the single characters' shares count for.
BACK_OFF = 5.0


def base_kinds(text: Column) -> list[Column]:
    """The spans of each fixed pattern, in order."""
    assigned = F.filter(matches(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12)
    return [assigned, matches(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))), matches(text, HEX, 2)]


def random_samples(spark, count: int = RANDOM_SAMPLES) -> DataFrame:
    """``(value)``: strings of random hex digits, base64 characters, and capitals with digits; always the same."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(count, numPartitions=4).select(F.explode(F.array(
        F.left(digest, F.lit(40)), F.left(F.base64(F.unhex(digest)), F.lit(40)),
        F.translate(F.left(F.base64(F.unhex(digest)), F.lit(24)), ALPHABET[26:52], ALPHABET[:26]))).alias("value"))


def _pairs(value: Column) -> Column:
    """The numbers of all pairs of neighbouring characters."""
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.zip_with(F.slice(places, F.lit(1), F.length(value) - 1), F.slice(places, F.lit(2), F.length(value) - 1),
                      lambda a, b: a * len(ALPHABET) + b)


def fit_markov(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of each pair of characters, from ``(value, secret)``: a first-order model of each label
    that backs off to how common the second character is. Counts cover all samples; the driver sees one number for
    each pair and label."""
    pairs = samples.select("secret", F.explode(_pairs(F.col("value"))).alias("pair"))
    n = len(ALPHABET)
    counts = {label: [0.0] * (n * n) for label in (True, False)}
    for row in pairs.groupBy("secret", "pair").agg(F.count("*").alias("n")).collect():
        counts[row["secret"]][row["pair"]] += row["n"]
    logs = {}
    for label, c in counts.items():
        after = [0.5 + sum(c[j::n]) for j in range(n)]
        share = [x / sum(after) for x in after]
        known = [sum(c[i * n:(i + 1) * n]) for i in range(n)]
        logs[label] = [math.log((c[k] + BACK_OFF * share[k % n]) / (known[k // n] + BACK_OFF)) for k in range(n * n)]
    return [a - b for a, b in zip(logs[True], logs[False])]


def likelihood_ratio(value: Column, model: list[float]) -> Column:
    """Logarithm of how much likelier ``value`` is as a random string than as a word."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    return F.aggregate(_pairs(value), F.lit(0.0), lambda a, pair: a + F.get(table, pair))


def secrets(docs: DataFrame, text: str = "text", least: int = LEAST, odds: float = ODDS) -> DataFrame:
    """``(doc_id, base, added)`` per row: the spans of the fixed patterns, and others that the models take for secrets.

    Samples are runs of 12 or more of ``ALPHABET`` in all texts: secret where they overlap a fixed pattern's span,
    ordinary where they are an identifier (words, short numbers and marks); and generated random strings. A run of
    ``least`` characters or more that overlaps no such span and is no identifier is added if it is more than ``odds`` times likelier
    under the model of secrets. Overlaps are found by halving, not by comparing all spans.
    Null texts count as empty and have no spans; rows may repeat; no rows give no rows. Other columns are not read.
    """
    value = whole(text)
    kinds = ("assign", "access", "hex")
    found = written(docs.select("doc_id", *[c.alias(k) for k, c in zip(kinds, base_kinds(value))], matches(value, RUN, 3).alias("runs")))
    found = written(found.select("doc_id", *kinds, F.transform("runs", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"),
        overlaps(s, *kinds).alias("marked"), F.regexp_like(s["value"], F.lit(ORDINARY)).alias("plain"))).alias("runs")))
    samples = found.select(F.explode("runs").alias("s")).where("s.marked or s.plain").select("s.value", F.col("s.marked").alias("secret"))
    random = random_samples(docs.sparkSession).withColumn("secret", F.lit(True))
    model = fit_markov(samples.unionByName(random))
    added = F.filter("runs", lambda s: ~s["marked"] & ~s["plain"] & (s["end"] - s["start"] >= least)
                     & (likelihood_ratio(s["value"], model) > math.log(odds)))
    return found.select("doc_id", places(F.array_sort(F.concat(*kinds))).alias("base"), places(added).alias("added"))


def secret_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """``secrets`` as counts of the fixed kinds, a digest of their spans, and all spans as text."""
    base = written_out("base", KINDS)
    return secrets(docs, text).select(
        "doc_id", *[count_of("base", i).alias(f"n_{KINDS[i]}") for i in range(3)], F.sha2(base, 256).alias("base_sha256"),
        written_out(F.concat("base", "added"), KINDS).alias("spans"))

