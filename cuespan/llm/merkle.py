"""Merkle manifests of a dataset, with proofs made by pointer jumping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import sequence as seq
from cuespan.session import written

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A table of segments is broadcast if its digests have no more bytes than this.
BROADCAST_BYTES = 4 << 20
#: The height of nodes above the partitions' own trees.
_ABOVE = 1 << 20


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and itself, or a dash for null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(leaf: Column, path: Column) -> Column:
    """The root, in hex, that a leaf comes to along its siblings."""
    return F.aggregate(path, shown(leaf), lambda d, s: F.sha2(F.concat(shown(s["left"]), d, shown(s["right"])), 256))


def proof_sha256(path: Column) -> Column:
    """SHA-256, in hex, of all siblings in hex, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: shown(F.concat(s["left"], s["right"]))), ""), 256)


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, b: F.concat(a, b))


def _parents(nodes: DataFrame, number: int, height: int, arity: int) -> DataFrame:
    """The next level of all trees: each run of ``arity`` nodes becomes one, which keeps its run."""
    place = F.expr(f"at div {arity}")
    runs = nodes.groupBy("tree", place.alias("at")).agg(
        F.ceil(F.max("n") / arity).alias("n"),
        F.array_sort(F.collect_list(F.struct("at", "node", "height", "digest"))).alias("run"))
    whole = F.array_join(F.transform("run", lambda r: shown(r["digest"])), "")
    return written(runs.select(
        "tree", "at", "n", F.concat(F.lit(f"{number}:"), F.col("at").cast("string"), F.lit(":"), "tree").alias("node"),
        F.lit(height).alias("height"), F.unhex(F.sha2(whole, 256)).alias("digest"), "run"))


def _grow(nodes: DataFrame, most: int, arity: int, above: bool) -> tuple[list[DataFrame], DataFrame]:
    """All levels over ``nodes``, and the last node of each tree; ``most`` is the size of the largest tree."""
    keep = ["tree", "at", "n", "node", "height", "digest"]
    levels, tops, number = [], nodes.where("n = 1").select(keep), 0
    while most > 1:
        number, most = number + 1, -(-most // arity)
        nodes = _parents(nodes.where("n > 1"), number, _ABOVE if above else number, arity)
        levels.append(nodes)
        tops = tops.unionByName(nodes.where("n = 1").select(keep))
    return levels, tops


def _pointers(level: DataFrame, above: bool, first: bool) -> DataFrame:
    """``(node, height, up, path, subroot)``: each node's parent, and its siblings as the first segment of its path."""
    each = level.select("tree", "n", F.col("node").alias("up"), F.col("digest").alias("own"), "run", F.posexplode("run").alias("place", "kid"))
    digests = F.transform("run", lambda r: r["digest"])
    segment = F.struct(_joined(F.slice(digests, F.lit(1), F.col("place"))).alias("left"),
                       _joined(F.slice(digests, F.col("place") + 2, F.size("run"))).alias("right"))
    if above:
        subroot = F.col("kid.digest") if first else F.lit(None).cast("binary")
    else:
        subroot = F.when(F.col("n") == 1, F.col("own"))
    return each.select("kid.node", "kid.height", "up", F.array(segment).alias("path"), subroot.alias("subroot"))


def _jump(nodes: DataFrame, ancestors: DataFrame, steps: int) -> DataFrame:
    """``nodes`` with pointers from where theirs lead to, segments put one after the other. Who has arrived stays."""
    others = ancestors.where(F.col("height") >= steps)
    small = others.count() * steps * 32 * ARITY <= BROADCAST_BYTES
    others = others.select(F.col("node").alias("__node"), F.col("up").alias("__up"), F.col("path").alias("__path"), F.col("subroot").alias("__subroot"))
    met = nodes.join(F.broadcast(others) if small else others.hint("merge"), F.col("up") == F.col("__node"), "left")
    none = F.slice("path", 1, 0)
    return met.withColumns({
        "up": F.coalesce("__up", "up"), "path": F.concat("path", F.coalesce("__path", none)),
        "subroot": F.coalesce("subroot", "__subroot")}).drop("__node", "__up", "__path", "__subroot")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", by: str = "lang",
             carry: Mapping[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """``(key, leaf, subroot, root, path)`` per row of ``docs``, and the columns of ``carry``; digests are binary.

    A row's digest over ``fields`` is a leaf. The leaves of each value of ``by``, ordered by ``key``, are the ground of a tree of
    ``arity``; the trees' roots, ordered by ``by`` with null first, are the ground of the last one. ``path`` has the
    siblings ``(left, right)`` of each level from the leaf to the root.

    Nodes point to their parents and hold their siblings; a self-join doubles the distance and puts the segments together
    until all have arrived. Nodes within the trees, a ``arity``-th of all, are written at each turn. Leaves
    follow in one plan. A table of ancestors is broadcast if its counted rows and the known size of a segment allow, and
    is shuffled otherwise; then it has thousands of nodes, each with no more than its leaves.

    A null key comes first; rows of one key are ordered by digest, so rows repeated whole may change places, which changes
    no digest. Texts may be null or empty, which differ. No rows give no rows. Other columns are not read.
    """
    spark, carry = docs.sparkSession, dict(carry or {})
    tree = F.coalesce(F.concat(F.lit("v"), F.col(by).cast("string")), F.lit("n"))
    leaves = written(docs.select(
        tree.alias("tree"), F.col(key).alias("__key"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
        F.monotonically_increasing_id().alias("tie"), *[c.alias(f"__carry_{name}") for name, c in carry.items()]))
    placed = written(seq.extend(leaves, ["__key", "digest", "tie"], {"no": seq.position(), "n": seq.whole_sum(F.lit(1))}, keys=["tree"], hot=True))
    nodes = placed.withColumn("at", F.col("no") - 1).withColumn("height", F.lit(0)).withColumn(
        "node", F.concat(F.lit("0:"), F.col("at").cast("string"), F.lit(":"), "tree"))
    most = placed.agg(F.max("n")).first()[0]
    levels, tops = _grow(nodes, most or 0, arity, False)
    ground = seq.extend(tops.select(F.col("tree").alias("part"), "node", "height", "digest", F.lit("").alias("tree")), ["part"],
                        {"no": seq.position(), "n": seq.whole_sum(F.lit(1))}, keys=["tree"], hot=True).withColumn("at", F.col("no") - 1)
    ground = written(ground)
    above, ends = _grow(ground, ground.agg(F.max("n")).first()[0] or 0, arity, True)
    end = ends.first()
    root = bytes(end["digest"]) if end else b""
    pointers = [_pointers(level, False, False) for level in levels] + [_pointers(level, True, i == 0) for i, level in enumerate(above)]
    empty = spark.createDataFrame([], "node string, height int, up string, path array<struct<left: binary, right: binary>>, subroot binary")
    first = empty
    for table in pointers:
        first = first.unionByName(table)
    own = first.where("height = 0").select(F.col("node").alias("__own"), "up", "path", "subroot")
    found = nodes.join(own.hint("merge"), F.col("node") == F.col("__own"), "left").withColumns({
        "path": F.coalesce("path", F.array().cast("array<struct<left: binary, right: binary>>"))})
    ancestors, steps, depth = written(first.where("height > 0")), 1, len(levels) + len(above)
    while steps < depth:
        found = _jump(found, ancestors, steps)
        if 2 * steps < depth:
            ancestors = written(_jump(ancestors, ancestors, steps))
        steps *= 2
    # A single leaf is its own tree's root.
    return found.select(
        F.col("__key").alias(key), F.col("digest").alias("leaf"), F.coalesce("subroot", "digest").alias("subroot"), F.lit(root).alias("root"), "path",
        *[F.col(f"__carry_{name}").alias(name) for name in carry])
