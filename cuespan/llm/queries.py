"""Registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.llm import (
    bpe, collocations, decontaminate, exact, lines, merkle, packing, pii, quality, secrets, sentences, shards, simhash)
from cuespan.llm.texts import lowered, table
from cuespan.session import shared_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER, RANKS)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.remove_repeats(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_report(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = [F.when(chosen, lowered(F.col("text"))).otherwise(F.col("text")) if f == "text" else F.col(f) for f in merkle.FIELDS]
    found = merkle.manifest(docs, carry={"shown": merkle.leaf_digest(tampered)})
    root, path = merkle.shown(F.col("root")), F.col("path")
    return found.select(
        "doc_id", merkle.shown(F.col("leaf")).alias("leaf"), merkle.shown(F.col("subroot")).alias("subroot"), root.alias("root"),
        merkle.proof_sha256(path).alias("proof_sha256"), merkle.folded(F.col("shown"), path).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER, packed=True, decoded=True)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_exact_dedup, op3_line_dedup, op4_quality, op5_secrets, op6_pii, op7_packing, op8_decontamination,
    op9_substring_dedup, op10_shards, op11_collocations, op12_manifest, op13_bpe)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


ORACLE_SQL = {
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
    "op8_decontamination": f"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, {_LOWER} AS text FROM documents
  UNION ALL SELECT 'b', item_id, {_LOWER} FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM w),
items AS (SELECT id AS item_id, ws, least(13, len(ws)) AS n FROM words WHERE side = 'b' AND len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS run
  FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT id AS doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS run
  FROM (SELECT id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM words, sizes WHERE side = 'd' AND len(ws) >= n)),
met AS (SELECT doc_id, item_id, r.n, i FROM runs r JOIN windows w ON r.n = w.n AND r.run = w.run),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM met) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM met GROUP BY 1)
SELECT d.id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words d LEFT JOIN hits h ON h.doc_id = d.id LEFT JOIN found f ON f.doc_id = d.id WHERE side = 'd'
""",
    "op11_collocations": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM words, (VALUES (1), (2), (3)) s(size) WHERE len(ws) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, size, phrase, a, k, array_to_string(ws[:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
marks AS (SELECT cuts.*, h.f AS l, t.f AS r, 1000000::HUGEINT * a * a // (h.f::HUGEINT * t.f) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
best AS (SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT *, unnest(range(1, 3)) AS i FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE held IS NULL OR 100 * held < 50 * a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
""",
    "op12_manifest": f"""
WITH RECURSIVE crc AS (SELECT doc_id, 4294967295::BIGINT AS c, 0 AS i, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END, i + 1, s
  FROM (SELECT doc_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE i < 8 * len(s))),
chosen AS (SELECT doc_id FROM crc WHERE i = 8 * len(s) AND xor(c, 4294967295::BIGINT) % 3 = 0),
d AS (SELECT doc_id, coalesce('v' || lang, 'n') AS tree, {_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} AS head,
    {_field('text')} AS body, CASE WHEN doc_id IN (FROM chosen) THEN {_field(_LOWER.replace("coalesce(text, '')", 'text'))} ELSE {_field('text')} END AS other
  FROM documents),
leaves AS (SELECT row_number() OVER () AS row, doc_id, tree, sha256(head || body) AS leaf, sha256(head || other) AS shown FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY tree, pos // 8),
subroots AS (SELECT tree, level, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos, n, digest FROM subroots
  UNION ALL SELECT any_value(level) + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY pos // 8),
sides AS (SELECT tree, level, pos, coalesce(string_agg(digest, '') OVER before, '') AS low, coalesce(string_agg(digest, '') OVER after, '') AS high
  FROM nodes WHERE n > 1 WINDOW
    before AS (PARTITION BY tree, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (PARTITION BY tree, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
topsides AS (SELECT level, pos, coalesce(string_agg(digest, '') OVER before, '') AS low, coalesce(string_agg(digest, '') OVER after, '') AS high
  FROM tops WHERE n > 1 WINDOW
    before AS (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
up AS (SELECT row, tree, 0 AS level, pos, shown AS folded, '' AS proof FROM placed
  UNION ALL SELECT row, u.tree, u.level + 1, u.pos // 8, sha256(low || folded || high), proof || low || high
  FROM up u JOIN sides s ON s.tree = u.tree AND s.level = u.level AND s.pos = u.pos),
arrived AS (SELECT u.row, u.folded, u.proof, s.pos, s.digest AS subroot FROM up u JOIN subroots s ON s.tree = u.tree AND s.level = u.level),
over AS (SELECT row, 0 AS level, pos, folded, proof, subroot FROM arrived
  UNION ALL SELECT row, o.level + 1, o.pos // 8, sha256(low || folded || high), proof || low || high, subroot
  FROM over o JOIN topsides s ON s.level = o.level AND s.pos = o.pos)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified
FROM placed JOIN over USING (row) JOIN tops t ON t.n = 1 AND t.level = over.level
""",
}
