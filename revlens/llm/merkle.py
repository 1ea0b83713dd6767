"""Merkle manifest of a dataset (operator 12).

Every row is a leaf, the SHA-256 of its fields.  The leaves of a group (a
source) ascend by key in a tree of ``arity`` children; the roots of the groups,
ordered by group, are the leaves of one more tree, whose root stands for the
dataset.  A digest enters the next one as lowercase hex text.

Levels are tables ``tree, idx, n, digest``: place and count of the nodes of a
tree's level.  At each level every node is equijoined with its siblings, whose
places are computed: ``idx ^ 1`` in a binary tree, the shifted slots of the same
parent otherwise.  The rows of slot zero then emit the parents.  Tables shrink
``arity``-fold from level to level, each is stored once, and keys are ``(tree,
idx)``, so a group that holds most rows is spread like any other.  Ranks come
from a range partitioning of the narrow leaf table, not from one window a group.

Proofs are put together from the top: a node's path is its own siblings, then
the path of its parent.  Folding a leaf with its path gives a root again.

Defined cases: a null field is ``-``; a null group is a group of its own, before
all others; null keys come before all others, and rows of one key are ordered
by their digests, so rows that repeat get equal leaves, each with its own
place; a group of one row has its leaf as root; an empty table gives an empty
result; texts of any length are hashed whole; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import task_count, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
_PLACE = (1 << 33) - 1          # row in the partition, of monotonically_increasing_id


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the fields, each ``-`` if null, else its UTF-8
    byte count, ``:`` and its value."""
    return F.sha2(F.encode(F.concat(*[_field(c) for c in fields]), "UTF-8"), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column ``tree``; stored) and the gapless place ``idx``
    of each in its tree by ``order``, and the tree's size ``n``."""
    columns = rows.columns
    spread = (rows.repartitionByRange(task_count(rows.sparkSession), "tree", *order)
              .sortWithinPartitions("tree", *order, *[c for c in columns if c not in ("tree", *order)])
              .withColumn("at", F.monotonically_increasing_id()))
    stored = written(spread, "merkle_order").select(
        *columns, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit(_PLACE)).alias("row"))
    # One row a partition and tree in it.
    cells = stored.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    by_tree = Window.partitionBy("tree")
    earlier = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("tree", "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"),
                        F.sum("rows").over(by_tree).alias("n"))
    return (stored.join(base, ["tree", "part"])
            .select(*columns, (F.col("row") - F.col("first") + F.col("base")).alias("idx"), "n"))


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """``nodes`` of trees of more than one, with the digests of the siblings
    to the ``left`` and to the ``right`` (binary, joined), by self-joins on the
    computed places of the siblings."""
    idx = F.col("idx")
    parent = F.expr(f"idx div {arity}")
    out = nodes.where(F.col("n") > 1).withColumn("slot", F.pmod(idx, F.lit(arity)))
    names = []
    for shift in range(1, arity):
        place = idx.bitwiseXOR(F.lit(1)) if arity == 2 else \
            parent * arity + F.pmod(F.col("slot") + F.lit(shift), F.lit(arity))
        name = f"sibling{shift}"
        other = nodes.select(F.col("tree").alias("of"), idx.alias("place"), F.col("digest").alias(name))
        out = (out.withColumn("shifted", place)
               .join(other, (F.col("tree") == F.col("of")) & (F.col("shifted") == F.col("place")), "left")
               .drop("of", "place", "shifted"))
        names.append(name)
    empty = F.unhex(F.lit(""))
    sides = {}
    for side, is_left in (("left", True), ("right", False)):
        parts = [F.when(((F.col("slot") + F.lit(s)) >= arity) == F.lit(is_left), F.col(c))
                 for s, c in enumerate(names, 1)]
        sides[side] = F.concat(*[F.coalesce(p, empty) for p in parts])
    return out.withColumns(sides).drop(*names)


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def node_digest(left: Column, own: Column, right: Column) -> Column:
    """Digest (binary) of a node from its children's (binary, joined)."""
    return F.unhex(F.sha2(F.encode(_text(F.concat(left, own, right)), "UTF-8"), 256))


def parents(level: DataFrame, arity: int = ARITY) -> DataFrame:
    """The nodes above a level with siblings, one from each slot zero."""
    up = node_digest(F.col("left"), F.col("digest"), F.col("right"))
    return level.where(F.col("slot") == 0).select(
        "tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
        up.alias("digest"))


def grow(nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all trees of ``nodes`` (stored) from the leaves up,
    each with its siblings, and the roots: ``tree, height, digest``."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots = [], nodes.where(F.col("n") == 1).select("tree", F.lit(0).alias("height"), "digest")
    while most > 1:
        levels.append(written(with_siblings(nodes, arity), f"{name}_level{len(levels)}"))
        nodes = parents(levels[-1], arity)
        done = parents(levels[-1].where(F.col("n") <= arity), arity)
        roots = roots.unionByName(done.select("tree", F.lit(len(levels)).alias("height"), "digest"))
        most = -(-most // arity)
    return levels, roots


def paths(levels: list[DataFrame], above: DataFrame, arity: int, carry: list[str]) -> DataFrame:
    """``tree, path``, the columns ``carry`` of every leaf and those of
    ``above`` of its tree.  ``path`` is an array of the ``left`` and ``right``
    siblings of each level; ``above`` has for every root ``tree, height``, the
    ``path`` from there on and columns that go to all its leaves."""
    passed = [c for c in above.columns if c not in ("tree", "height", "path")]
    found = None
    for height in range(len(levels) - 1, -1, -1):
        tops = above.where(F.col("height") == height + 1).select(
            "tree", F.lit(0).cast("long").alias("idx"), "path", *passed)
        upper = tops if found is None else found.unionByName(tops)
        upper = upper.select(F.col("tree").alias("of"), F.col("idx").alias("place"), F.col("path").alias("rest"), *passed)
        keep = ["tree", "idx"] if height else ["tree", *carry]
        own = F.struct(F.col("left"), F.col("right"))
        found = (levels[height].withColumn("up", F.expr(f"idx div {arity}"))
                 .join(upper, (F.col("tree") == F.col("of")) & (F.col("up") == F.col("place")))
                 .select(*keep, F.concat(F.array(own), F.col("rest")).alias("path"), *passed))
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root (binary) that a leaf digest (binary) and a path lead to."""
    return F.aggregate(path, leaf, lambda acc, x: node_digest(x["left"], acc, x["right"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path as hex text, level by level, left to right."""
    return F.lower(F.array_join(F.transform(path, lambda x: F.hex(F.concat(x["left"], x["right"]))), ""))


def build(rows: DataFrame, group: Column, key: Column, digest: Column, carry: dict[str, Column] | None = None,
          arity: int = ARITY) -> DataFrame:
    """The manifest of ``rows``: for each, its ``key``, ``leaf``, the ``subroot``
    of its group, the ``root`` of all (binary digests), its ``path`` (siblings
    of each level, from the leaf to the root) and the columns ``carry``."""
    carry = carry or {}
    extra = [f"c{i}" for i in range(len(carry))]
    tree = F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))    # null first, then bytewise
    leaves = written(rows.select(tree.alias("tree"), key.alias("key"), F.unhex(digest).alias("digest"),
                                 *[c.alias(n) for n, c in zip(extra, carry.values())]), "merkle_leaves")
    nodes = written(ranked(leaves, ["key", "digest"]), "merkle_nodes")
    levels, roots = grow(nodes, arity, "merkle")
    roots = written(roots, "merkle_subroots")
    top = written(ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"),
                                      F.col("height").alias("height_"), "digest"), ["group"]), "merkle_top")
    top_levels, top_root = grow(top, arity, "merkle_top")
    no_path = F.array().cast("array<struct<left: binary, right: binary>>")
    if top_levels:
        start = top_root.select("tree", "height", no_path.alias("path"))
        above = paths(top_levels, start, arity, ["group", "height_", "digest"])
    else:                                                   # one group, or none
        above = top.withColumn("path", no_path)
    above = written(above.select(F.col("group").alias("tree"), F.col("height_").alias("height"), "path",
                                 F.col("digest").alias("subroot")), "merkle_above")
    # A group of one row has no level of its own: its leaf is its root.
    alone = (nodes.where(F.col("n") == 1).select("tree", "key", "digest", *extra)
             .join(above.select("tree", "path", "subroot"), "tree"))
    found = alone if not levels else alone.unionByName(paths(levels, above, arity, ["key", "digest", *extra]))
    root = top_root.first()                                 # one digest, or none of an empty table
    return found.select("key", F.col("digest").alias("leaf"), "subroot",
                        F.lit(root["digest"] if root else None).cast("binary").alias("root"), "path",
                        *[F.col(n).alias(c) for n, c in zip(extra, carry)])


class Checked(NamedTuple):
    """Columns of the proof of a manifest row."""
    proof: Column
    folded: Column
    verified: Column


def check(probe: Column, path: Column, root: Column) -> Checked:
    """The proof's text, the root folded from the digest ``probe``, and
    whether it is the manifest's."""
    folded = fold(probe, path)
    return Checked(proof_text(path), folded, folded == root)
