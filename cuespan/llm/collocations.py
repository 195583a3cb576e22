"""Collocations by SON partitioning: shards are mined at a lowered support; what one of them finds is counted in all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.texts import whole
from cuespan.session import written

#: What parts pieces, and beside the blank, words.
MARKS = ".,;:!?\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUPPORT = 10
LONGEST = 3
SHARDS = 4
HELD_PERCENT = 50
TOP = 2000
#: The filter of candidates has 2 to this power of bits, in rows of 64.
FILTER_BITS = 26
NO_LANG = "und"


def word_places(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """``(lang, shard, words, at)``: every word of every piece, with the words of its piece. Equal texts share a shard."""
    part = F.pmod(F.xxhash64(whole(text)), F.lit(shards)).cast("int")
    # One character stands for each kind of mark, as that is what splits fast.
    plain = F.translate(whole(text), _UPPER + MARKS + "\t", _UPPER.lower() + "\n" * len(MARKS) + " ")
    pieces = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), part.alias("shard"), F.explode(F.split(plain, "\n")).alias("piece"))
    worded = pieces.where("piece <> ''").select("lang", "shard", F.array_remove(F.split("piece", " "), "").alias("words"))
    return worded.select("lang", "shard", "words", F.posexplode("words").alias("at", "word")).drop("word")


def _phrase_hash(size: int, shards: int) -> Column:
    """A hash of the phrase of ``size`` words that begins here, less the bits that a shard's number takes; null where the
    piece ends before."""
    words = [F.get("words", F.col("at") + i) for i in range(size)]
    return F.when(words[-1].isNotNull(), F.shiftrightunsigned(F.xxhash64("lang", *words), _shard_bits(shards)))


def _shard_bits(shards: int) -> int:
    return max(1, (shards - 1).bit_length())


def local_supports(docs: DataFrame, support: int, shards: int, text: str) -> dict[int, int]:
    """Each shard's share, by bytes, of ``support``, rounded up. A phrase that stays below it in every shard stays
    below ``support`` in all."""
    part = F.pmod(F.xxhash64(whole(text)), F.lit(shards)).cast("int")
    size = {r[0]: r[1] for r in docs.groupBy(part).agg(F.sum(F.octet_length(whole(text)) + F.lit(1).cast("bigint"))).collect()}
    return {shard: -(-support * n // sum(size.values())) for shard, n in size.items()}


def candidate_filter(places: DataFrame, supports: dict[int, int], longest: int, shards: int, bits: int = FILTER_BITS) -> DataFrame:
    """``(bucket, mask)``: a bit for the hash of each phrase that some shard finds frequent.

    Every shard is mined completely: all its phrases are counted by hash. Hashes or bits that meet let more phrases
    pass, never fewer. There are 2 to the power of ``bits`` - 6 rows at most, whatever the input.
    """
    own = _shard_bits(shards)
    grams = places.select("shard", F.explode(F.array(*[_phrase_hash(n, shards) for n in range(2, longest + 1)])).alias("h")).where("h is not null")
    # One number for shard and hash: few bytes to sort and to send.
    counted = grams.select(F.shiftleft("h", own).bitwiseOR(F.col("shard").cast("bigint")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    shard = F.col("key").bitwiseAND(F.lit((1 << own) - 1))
    least = reduce(lambda rest, s: F.when(shard == s[0], s[1]).otherwise(rest), supports.items(), F.lit(1))
    p = F.shiftrightunsigned("key", own).bitwiseAND(F.lit((1 << bits) - 1))
    return written(
        counted.where(F.col("n") >= least).select(p.alias("p"))
        .select(F.shiftright("p", 6).alias("bucket"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
        .groupBy("bucket").agg(F.bit_or("bit").alias("mask")))


def phrase_counts(places: DataFrame, candidates: DataFrame, support: int, longest: int, shards: int, bits: int = FILTER_BITS) -> DataFrame:
    """``(lang, size, phrase, f)``: exact counts over all shards, of every word and of the candidates that have ``support``."""
    sizes = [F.struct(F.lit(1).alias("size"), F.lit(None).cast("bigint").alias("h"))]
    sizes += [F.struct(F.lit(n).alias("size"), _phrase_hash(n, shards).alias("h")) for n in range(2, longest + 1)]
    grams = (
        places.select("lang", "words", "at", F.inline(F.array(*sizes))).where("size = 1 or h is not null")
        .withColumn("p", F.col("h").bitwiseAND(F.lit((1 << bits) - 1))).withColumn("own", F.shiftright("p", 6))
    )
    passed = grams.join(F.broadcast(candidates), F.col("own") == F.col("bucket"), "left").where(
        "size = 1 or (mask & shiftleft(1L, cast(p & 63 as int))) <> 0")
    phrase = F.when(F.col("size") == 1, F.get("words", F.col("at"))).otherwise(
        F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " "))
    return written(
        passed.select("lang", "size", phrase.alias("phrase")).groupBy("lang", "size", "phrase").agg(F.count("*").alias("f"))
        .where((F.col("size") == 1) | (F.col("f") >= support)))


def _part(first: int, size) -> Column:
    """Words of ``phrase`` from the ``first``, 1 being the first of all."""
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def scored(counts: DataFrame, longest: int) -> DataFrame:
    """``(lang, phrase, a, k, l, r, score)`` of each candidate by its lowest-scoring cut. Products are exact up to 38 digits."""
    phrases = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = [F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), _part(1, k).alias("head"), _part(k + 1, F.col("size")).alias("tail")))
            for k in range(1, longest)]
    cut = phrases.select("lang", "phrase", "a", F.explode(F.array(*cuts)).alias("cut")).where("cut is not null").select(
        "lang", "phrase", "a", "cut.*")
    heads = counts.select(F.col("lang").alias("lang_l"), F.col("phrase").alias("part_l"), F.col("f").alias("l"))
    tails = counts.select(F.col("lang").alias("lang_r"), F.col("phrase").alias("part_r"), F.col("f").alias("r"))
    # Sorted and shuffled on both sides, so that a word that very many phrases share can be split.
    met = (
        cut.join(heads.hint("merge"), (F.col("lang") == F.col("lang_l")) & (F.col("head") == F.col("part_l")))
        .join(tails.hint("merge"), (F.col("lang") == F.col("lang_r")) & (F.col("tail") == F.col("part_r")))
    )
    score = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)))"
                   " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    return met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")).select(
        "lang", "phrase", "a", "best.*")


def _held(counts: DataFrame, longest: int) -> DataFrame:
    """``(lang, phrase, held)``: the count of the most frequent longer candidate around a phrase."""
    inner = [F.when((F.col("size") > n) & (F.col("size") >= first + n - 1), _part(first, n))
             for n in range(2, longest) for first in range(1, longest - n + 2)]
    longer = counts.where("size > 2").select("lang", "f", F.explode(F.array(*inner)).alias("inner"))
    return longer.where("inner is not null").groupBy(F.col("lang").alias("__lang"), F.col("inner").alias("__phrase")).agg(F.max("f").alias("held"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS,
                 held_percent: int = HELD_PERCENT, top: int = TOP, text: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``longest`` words.

    Texts, A-Z in lower case, are split into pieces at marks and line ends, and those into words at blanks and tabs.
    A phrase with ``support`` or more occurrences is a candidate. Its score is ``floor(1000000 a a / (l r))`` for the cut
    into ``l`` and ``r`` that scores lowest, ties to the earliest; ``n`` counts the language's words. A
    candidate inside a longer one that has ``held_percent`` of its count is dropped.

    Support is shared out over ``shards`` in proportion to their size, so a phrase below it in each is below it in all. Two
    passes over the texts: one mines the shards, the other counts exactly, of the phrases, only what they found.
    More shards than ``support`` would find everything. Null texts count as empty, null languages as ``und``;
    repeated rows count each time; no rows give no rows; other columns are not read.
    """
    supports = local_supports(docs, support, shards, text)
    places = word_places(docs, shards, text)
    counts = phrase_counts(places, candidate_filter(places, supports, longest, shards), support, longest, shards)
    best = scored(counts, longest)
    if longest > 2:
        best = best.join(_held(counts, longest).hint("merge"), (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__phrase")), "left").where(
            F.col("held").isNull() | (100 * F.col("held") < held_percent * F.col("a")))
    best = best.select("lang", "phrase", "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # In three rounds, so that no task orders all phrases of a language.
    for salts in (64, 8, 1):
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= top)
    totals = counts.where("size = 1").groupBy(F.col("lang").alias("__lang")).agg(F.sum("f").alias("n"))
    return best.join(totals, F.col("lang") == F.col("__lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
