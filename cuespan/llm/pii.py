"""Personal data: fixed patterns, and wider candidates that boosted trees choose from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.llm.spans import count_of, matches, overlaps, places, written_out
from cuespan.llm.texts import whole
from cuespan.session import written

KINDS = ("email", "ip", "card", "phone", "number", "address")
#: A match can begin only where a run of its first characters does or where the last match ended; saying so, and
#: giving nothing back once taken, keeps the search linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"
#: Generators of candidates: anything like a number with six digits or more, or with an at sign in it.
NUMBER = r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){5,}+"
ADDRESS = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9.-]++"
#: Words that say what follows, with a few that may stand between.
HINT = (r"(?i)(?<![a-z])(?:phone|telephone|tel|call|dial|fax|mobile|cell|card|visa|account|iban|ssn|passport|e-?mail|mail|contact)"
        r"(?:[^a-z]{1,3}(?:number|no|nr|at|is|me|us))?[^a-z]{0,8}$")
#: A candidate that such words announce, with so many digits or written as an address, is labelled as personal.
LEAST_DIGITS = 7
FEATURES = {"digits": 21, "marks": 16, "plus": 2, "at": 2, "groups": 7, "hint": 2, "joined": 4}
TREES = 40
RATE = 0.3
PRECISION = 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_kinds(text: Column) -> list[Column]:
    """The spans of each fixed pattern, in order."""
    digits = lambda s: F.length(_digits(s["value"]))
    emails = matches(text, EMAIL, 0, F.contains(text, F.lit("@")))
    ips = F.filter(matches(text, IP, 1), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.regexp_like(p, F.lit(_OCTET))))
    cards = F.filter(matches(text, CARD, 2), lambda s: digits(s).between(12, 19) & F.call_function("luhn_check", _digits(s["value"])))
    phones = F.filter(matches(text, PHONE, 3, F.contains(text, F.lit("+"))), lambda s: digits(s).between(9, 15))
    return [emails, ips, cards, phones]


def candidates(text: Column) -> Column:
    """Overlapping spans of both generators."""
    return F.concat(matches(text, NUMBER, 4), matches(text, ADDRESS, 5))


def features(s: Column) -> dict[str, Column]:
    """Format and context of a span, each a small whole number under its bound in ``FEATURES``."""
    v = s["value"]
    flag = lambda c: c.cast("int")
    return {
        "digits": F.least(F.length(_digits(v)), F.lit(20)),
        "marks": flag(F.contains(v, F.lit(" "))) + 2 * flag(F.contains(v, F.lit("."))) + 4 * flag(F.contains(v, F.lit("-")))
        + 8 * flag(F.contains(v, F.lit("("))),
        "plus": flag(F.startswith(v, F.lit("+"))), "at": flag(F.regexp_like(v, F.lit("[@\\[(]"))),
        "groups": F.least(F.size(F.split(v, "[^0-9A-Za-z]+")), F.lit(6)),
        "hint": flag(F.regexp_like(s["before"], F.lit(HINT))),
        "joined": flag(F.regexp_like(s["before"], F.lit("[0-9A-Za-z]$"))) + 2 * flag(F.regexp_like(s["after"], F.lit("^[0-9A-Za-z]"))),
    }


def _announced(s: Column) -> Column:
    """Whether the words before a candidate, or an at sign written out, say that it is personal."""
    told = F.regexp_like(s["before"], F.lit(HINT)) & ((s["kind"] == 5) | (F.length(_digits(s["value"])) >= LEAST_DIGITS))
    return told | (s["kind"] == 5) & F.regexp_like(s["value"], F.lit(r"(?i)[\[(]at[\])]\x20?[a-z0-9-]+\.[a-z]"))


def _cell(s: Column) -> Column:
    """All features as one number, under the product of their bounds (some 37 000)."""
    cell = F.lit(0)
    for name, value in features(s).items():
        cell = cell * FEATURES[name] + value
    return cell.cast("int")


def boost(cells: np.ndarray, yes: np.ndarray, count: np.ndarray, trees: int = TREES, rate: float = RATE) -> np.ndarray:
    """Gradient boosting of trees of two levels for the logistic loss, over distinct rows of ``cells`` (a column per
    feature) with ``yes`` out of ``count`` positive: the log-odds of every row."""
    score = np.full(len(cells), np.log((yes.sum() + 0.5) / (count.sum() - yes.sum() + 0.5)))
    splits = [(f, t) for f, bound in enumerate(FEATURES.values()) for t in range(bound - 1) if len(np.unique(cells[:, f] <= t)) == 2]
    sides = np.array([cells[:, f] <= t for f, t in splits]).reshape(len(splits), len(cells))

    def best(inside: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> np.ndarray | None:
        g, h = slope * inside, bend * inside
        left_g, left_h = sides @ g, sides @ h
        gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - g.sum() ** 2 / (h.sum() + 1)
        return sides[gain.argmax()] if len(gain) and gain.max() > 1e-9 else None

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = yes - count * p, count * p * (1 - p)
        root = best(np.ones(len(cells), bool), slope, bend)
        if root is None:
            break
        for inside in (root, ~root):
            cut = best(inside, slope, bend)
            for leaf in ((inside,) if cut is None else (inside & cut, inside & ~cut)):
                score[leaf] += rate * slope[leaf].sum() / (bend[leaf].sum() + 1)
    return score


def threshold(score: np.ndarray, yes: np.ndarray, count: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest score from which on, all higher ones together, at least ``precision`` of the rows are positive."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(yes[order]) / np.maximum(np.cumsum(count[order]), 1)
    last = np.append(np.diff(score[order]) != 0, True)
    good = np.flatnonzero((share >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else float("inf")


def _chosen_cells(spans: DataFrame, precision: float) -> list[int]:
    """Cells of features whose candidates are to be taken. Trees learn from one half of the documents, by a hash of
    the id, and the threshold is set on the other half."""
    grid = spans.groupBy("half", "cell").agg(F.sum("yes").alias("yes"), F.count("*").alias("n")).collect()
    cells = sorted({r["cell"] for r in grid})
    if not cells:
        return []
    yes, count = np.zeros((2, len(cells))), np.zeros((2, len(cells)))
    place = {c: i for i, c in enumerate(cells)}
    for r in grid:
        yes[r["half"], place[r["cell"]]] += r["yes"]
        count[r["half"], place[r["cell"]]] += r["n"]
    rest, columns = np.array(cells), []
    for bound in reversed(FEATURES.values()):
        columns.append(rest % bound)
        rest = rest // bound
    score = boost(np.array(columns[::-1]).T, yes[0], count[0])
    least = threshold(score, yes[1], count[1], precision)
    return [c for c, s in zip(cells, score) if s >= least]


def personal_data(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """``(doc_id, base, added)`` per row: the spans of the fixed patterns, and candidates taken beside them.

    Labels are weak. A candidate counts as personal if it overlaps a span of a fixed pattern, or if the words before it
    announce it (``HINT``) and it has ``LEAST_DIGITS`` digits or is an address. Counts of personal and other candidates by cell of
    the features cover all documents; the trees, fitted on these counts, and the calibrated threshold
    select cells, and candidates in them that overlap no fixed span are added; they may overlap each other.
    Null texts count as empty and have no spans; rows may repeat; no rows give no rows. Other columns are not read.
    """
    value = whole(text)
    kinds = KINDS[:4]
    found = written(docs.select("doc_id", *[c.alias(k) for k, c in zip(kinds, base_kinds(value))], candidates(value).alias("wide")))
    found = written(found.select("doc_id", places(F.array_sort(F.concat(*kinds))).alias("base"), F.transform("wide", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), _cell(s).alias("cell"),
        _announced(s).alias("told"), overlaps(s, *kinds).alias("valid"))).alias("wide")))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    spans = found.select(half, F.explode("wide").alias("s")).select("half", "s.cell", F.expr("s.valid or s.told").cast("int").alias("yes"))
    chosen = F.array(*[F.lit(c) for c in _chosen_cells(spans, precision)]).cast("array<int>")
    added = F.filter("wide", lambda s: ~s["valid"] & F.array_contains(chosen, s["cell"]))
    return found.select("doc_id", "base", places(added).alias("added"))


def personal_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """``personal_data`` as counts of the fixed kinds, a digest of their spans, and all spans as text."""
    return personal_data(docs, text).select(
        "doc_id", *[count_of("base", i).alias(f"n_{KINDS[i]}") for i in range(4)],
        F.sha2(written_out("base", KINDS), 256).alias("base_sha256"),
        written_out(F.concat("base", "added"), KINDS).alias("spans"))
