"""Merkle manifest of a dataset: hash trees per group, proofs by pointer jumping, and their check.

Nodes are rows. A node is named by (tree, level, place): the trees are the groups and,
under an empty name, the tree over their roots. Digests are lowercase hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.ordinals import number_rows
from faultline.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: Nodes of one level that a join may send to every task, some 2.5 kB each.
BROADCAST_NODES = 4096
TOP = ""
SEGMENT = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its value; null is '-'."""
    parts = []
    for name in fields:
        value = changed.get(name, F.col(name)).cast("string")
        told = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(told, F.lit("-")))
    return digest(*parts)


def tree_name(group: Column) -> Column:
    """Names that sort as the groups do, null first: '-' for null, else '=' and the value."""
    value = group.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), value))


@dataclass
class Manifest:
    """A written manifest.

    ``leaves``: row_id, tree, leaf, place, n (leaves of the tree) and the columns kept;
    ``nodes``: name, children and digest of every inner node; ``roots``: tree, depth, subroot,
    place among the trees; ``root``: hex digest and ``root_name``, both None without rows.
    """

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    root: str | None
    root_name: tuple[str, int, int] | None
    arity: int


def build_manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group_col: str = "lang",
    order_col: str = "doc_id",
    keep: dict[str, Column] | None = None,
    arity: int = ARITY,
) -> Manifest:
    """Hash trees over the rows of ``docs``.

    Per group, leaves ascend by ``order_col`` (null first; equal ids by leaf digest, so equal
    rows may stand in any order); every ``arity`` consecutive nodes become their digest until
    one is left. The roots of the groups, by name (null first, bytewise), are the leaves of
    the top tree. Null fields count as '-', empty texts as '0:', texts of any length are
    hashed whole in one scan. ``keep`` adds columns computed in that scan; other columns of
    ``docs`` are not carried, whatever they are called. An empty table has no root.

    A level is one grouping by place, arity rows to a group, so a group of rows of any size is
    spread over all tasks; a level has an eighth of the rows of the one below it.
    """
    rows = docs.select(
        F.col(order_col).alias("row_id"),
        tree_name(F.col(group_col)).alias("tree"),
        leaf_digest(fields).alias("leaf"),
        *[value.alias(name) for name, value in (keep or {}).items()],
    )
    leaves = number_rows(rows, ["tree"], ["row_id", "leaf"], total="n")
    leaves = materialise(leaves, "merkle-leaves")
    base = leaves.select("tree", F.lit(0).alias("level"), "place", "n", F.col("leaf").alias("digest"))
    nodes, tops = _grow(base, arity)
    tops = tops.select("tree", F.col("level").alias("depth"), F.col("digest").alias("subroot"))
    roots = materialise(number_rows(tops, [], ["tree"], total="n"), "merkle-roots")
    base = roots.select(
        F.lit(TOP).alias("tree"), F.lit(0).alias("level"), "place", "n", F.col("subroot").alias("digest")
    )
    above, top = _grow(base, arity)
    found = top.take(1)
    nodes = materialise(nodes.unionByName(above), "merkle-nodes")
    if not found:
        return Manifest(leaves, nodes, roots, None, None, arity)
    name = (TOP, found[0].level, 0)
    if not found[0].level:  # one tree: its top is the root
        only = roots.select("tree", "depth").take(1)[0]
        name = (only.tree, only.depth, 0)
    return Manifest(leaves, nodes, roots, found[0].digest, name, arity)


def _grow(level: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """Inner nodes of all levels, and the nodes that are alone on theirs (one of each tree)."""
    most = level.agg(F.max("n").alias("n")).take(1)[0].n or 1
    tops = level.where("n = 1").select("tree", "level", "digest")
    inner = level.where("false").select(
        "tree", "level", "place", F.array("digest").alias("children"), "digest"
    )
    depth = 0
    while most > 1:
        most, depth = -(-most // arity), depth + 1
        entry = F.struct("place", "digest")
        up = (
            level.where("n > 1")
            .groupBy("tree", F.floor(F.col("place") / arity).cast("long").alias("up"))
            .agg(F.sort_array(F.collect_list(entry)).alias("c"), F.max("n").alias("n"))
            .select(
                "tree",
                F.lit(depth).alias("level"),
                F.col("up").alias("place"),
                F.ceil(F.col("n") / arity).cast("long").alias("n"),
                F.col("c.digest").alias("children"),
                F.sha2(F.array_join("c.digest", ""), 256).alias("digest"),
            )
        )
        level = materialise(up, f"merkle-level{depth}")
        inner = inner.unionByName(level.drop("n"))
        tops = tops.unionByName(level.where("n = 1").select("tree", "level", "digest"))
    return inner, tops


def _siblings(children: Column, k: Column) -> Column:
    """One segment: the digests left and right of child ``k``, each side joined."""
    after = F.greatest(F.size(children) - k - 1, F.lit(0))
    return F.array(
        F.struct(
            F.array_join(F.slice(children, F.lit(1), k), "").alias("left"),
            F.array_join(F.slice(children, k + 2, after), "").alias("right"),
        )
    )


def _links(manifest: Manifest) -> DataFrame:
    """name, ancestor, segment: every node above the leaves but the root, with its parent.

    The top of a group's tree is a leaf of the top tree and has its parent there; the top of
    a tree of one row is that row's leaf.
    """
    child = manifest.nodes.where((F.col("level") > 1) | (F.col("tree") == TOP)).select(
        "tree", "level", F.posexplode("children").alias("k", "_"), "children", "place"
    )
    links = child.select(
        F.struct("tree", (F.col("level") - 1).alias("level"), (F.col("place") * manifest.arity + F.col("k")).alias("place")).alias("name"),
        F.struct("tree", "level", "place").alias("ancestor"),
        _siblings(F.col("children"), F.col("k")).alias("segment"),
    )
    in_top = (F.col("name.tree") == TOP) & (F.col("name.level") == 0)
    tops = manifest.roots.select(
        F.struct("tree", F.col("depth").alias("level"), F.lit(0).cast("long").alias("place")).alias("name"),
        F.col("place").alias("at"),
    )
    tops = tops.join(
        links.where(in_top).select(F.col("name.place").alias("at"), "ancestor", "segment"), "at"
    ).drop("at")
    return links.where(~in_top).unionByName(tops)


def paths(manifest: Manifest) -> DataFrame:
    """``name, segment``: for every node above the leaves but the root the siblings up to the root.

    Pointer jumping: a node starts with its parent as ancestor and the siblings there as its
    segment. A round joins the nodes with themselves, ancestor to node; the ancestor's
    ancestor takes its place and its segment goes behind. So distances double, and the
    rounds are the logarithm of the depth. Nodes at the root leave the rounds.

    In a round of distance d an ancestor serves up to arity^d nodes, about as many as any
    other. Either there are many ancestors, evenly used, and the join shuffles, or there
    are few: they are counted, and up to ``BROADCAST_NODES`` of them broadcast.
    """
    tree, level, place = manifest.root_name or (TOP, 0, 0)
    root = F.struct(F.lit(tree).alias("tree"), F.lit(level).alias("level"), F.lit(place).cast("long").alias("place"))
    at_root = F.col("ancestor") == root
    known = materialise(_links(manifest), "merkle-links")
    there, away = known.where(at_root), known.where(~at_root)
    while True:
        used = away.select("ancestor").distinct()
        n = used.count()
        if not n:
            return there.select("name", "segment")
        ancestors = there.unionByName(away).select(
            F.col("name").alias("_name"), F.col("ancestor").alias("_further"), F.col("segment").alias("_more")
        )
        ancestors = ancestors.join(
            F.broadcast(used) if n <= BROADCAST_NODES else used, F.col("_name") == F.col("ancestor"), "left_semi"
        )
        jumped = away.join(
            F.broadcast(ancestors) if n <= BROADCAST_NODES else ancestors.hint("merge"),
            F.col("ancestor") == F.col("_name"),
        ).select("name", F.col("_further").alias("ancestor"), F.concat("segment", "_more").alias("segment"))
        jumped = materialise(jumped, "merkle-jump")
        there, away = there.unionByName(jumped.where(at_root)), jumped.where(~at_root)


def proofs(manifest: Manifest) -> DataFrame:
    """The leaves with subroot, root and ``proof``: (left, right) siblings of each level up to the root.

    The leaves make the last jump: the parent's path, with the parent's children, goes to its
    at most arity leaves. Empty where the leaf is the root.
    """
    parents = manifest.nodes.where((F.col("level") == 1) & (F.col("tree") != TOP))
    parents = parents.select("tree", F.col("place").alias("_up"), "children")
    above = paths(manifest)
    lone = (
        above.where((F.col("name.level") == 0))
        .select(F.col("name.tree").alias("tree"), F.lit(0).cast("long").alias("_up"), F.col("segment").alias("_path"))
        .withColumn("children", F.lit(None).cast("array<string>"))
    )
    above = above.where((F.col("name.level") == 1) & (F.col("name.tree") != TOP)).select(
        F.col("name.tree").alias("tree"), F.col("name.place").alias("_up"), F.col("segment").alias("_path")
    )
    parents = parents.join(above, ["tree", "_up"], "left").unionByName(lone)
    leaves = manifest.leaves.withColumn("_up", F.floor(F.col("place") / manifest.arity).cast("long"))
    k = (F.col("place") % manifest.arity).cast("int")
    none = F.array().cast(SEGMENT)
    roots = manifest.roots.select("tree", "subroot", F.lit(manifest.root).alias("root"))
    own = F.when(F.col("children").isNotNull(), _siblings(F.col("children"), k)).otherwise(none)
    return (
        leaves.join(parents, ["tree", "_up"], "left")
        .withColumn("proof", F.concat(own, F.coalesce("_path", none)))
        .drop("_up", "_path", "children")
        .join(roots, "tree")  # one row a tree; the planner broadcasts it by its size or splits a large tree
    )


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    sides = F.transform(proof, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(sides, ""), 256)


def verify(manifest: Manifest, leaf: Column) -> DataFrame:
    """The proofs with ``folded_root``, from ``leaf`` (a column over the leaves), and ``verified``."""
    found = proofs(manifest).withColumn("folded_root", fold(leaf, F.col("proof")))
    return found.withColumn("verified", F.col("folded_root") == F.lit(manifest.root))
