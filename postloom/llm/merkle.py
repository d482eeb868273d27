"""A Merkle manifest of a dataset: a tree per group of rows, and a tree over the groups.

The nodes of a group are dealt to aligned blocks of 3 ** 6. A block keeps each of its levels as one string,
the hex digests of its nodes side by side, so a run of siblings is a substring of fixed width: hashing those
gives the next level, and what lies to the left and right of a node in its run is its segment of a proof. The
top nodes of the blocks are the nodes of the next tier, and so on up to one root per group; the group roots
are the nodes of one more tree. No task sees more than a block, however large a group is.

Levels hold the ASCII bytes of the hex digests as binary values: substrings of those need no scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import column, files_for, partitions, stored
from postloom.session import broadcast_if_small

#: Nodes that make one parent, levels of a block, and characters of a digest.
FAN, LEVELS, DIGEST = 3, 6, 64
BLOCK = FAN ** LEVELS

PATH = "array<struct<left:binary,right:binary>>"

#: Groups of up to this many levels; more rows than any table has.
DEEPEST = 39


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and the value, or `-` for null."""
    def field(value: Column) -> Column:
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(F.concat(*[field(v.cast("string")) for v in values]))


def depth_of(n: Column) -> Column:
    """Levels above the leaves of a tree of `n` leaves."""
    powers = F.array(*[F.lit(FAN ** k).cast("bigint") for k in range(DEEPEST + 1)])
    return F.size(F.filter(powers, lambda p: p < n))


def _levels(nodes: Column, height: Column) -> Column:
    """All levels of a block from its nodes (an array of digests) up: `height` more than the first."""
    def parents(level: Column) -> Column:
        width = FAN * DIGEST
        runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / width).cast("int"))
        return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * width + 1, F.lit(width)), 256)),
                            "").cast("binary")

    first = F.array(F.array_join(nodes, "").cast("binary"))
    steps = F.slice(F.array(*map(F.lit, range(LEVELS))), F.lit(1), height)
    return F.aggregate(steps, first, lambda held, _: F.concat(held, F.array(parents(F.element_at(held, -1)))))


def _path(levels: Column, index: Column) -> Column:
    """The siblings of the node at `index` of a block on each level but the last: left of it and right of it."""
    def step(level: Column, k: Column) -> Column:
        at = F.floor(index / F.element_at(F.array(*[F.lit(FAN ** i) for i in range(LEVELS)]), k + 1)).cast("int")
        run, place = F.floor(at / FAN).cast("int") * (FAN * DIGEST), at % FAN * DIGEST
        return F.struct(F.substring(level, run + 1, place).alias("left"),
                        F.substring(level, run + place + DIGEST + 1, F.lit((FAN - 1) * DIGEST) - place).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x.left, node.cast("binary"), x.right), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, from left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x.left, x.right).cast("string")), ""))


@dataclass
class Tree:
    """Tiers of blocks (`grp, depth, block, levels`, the first also with its payload) and `roots` (`grp, root`)."""

    tiers: list[DataFrame]
    roots: DataFrame


def build_tree(nodes: DataFrame, payload: list[str], name: str, files: int) -> Tree:
    """Trees over `nodes` (`grp, depth, pos, node` and the columns of `payload`): positions from 0 without gaps,
    `depth` that of the whole group. Payload columns become arrays beside the levels of the first tier."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    tiers: list[DataFrame] = []
    ends: list[DataFrame] = []
    done = 0
    while not tiers or done < deepest:
        block = F.floor(F.col("pos") / BLOCK).alias("block")
        # At most BLOCK rows per group.
        members = F.array_sort(F.collect_list(F.struct("pos", "node", *payload)))
        rows = nodes.groupBy("grp", "depth", block).agg(members.alias("m"))
        tier = rows.select("grp", "depth", "block", *[F.col(f"m.{c}").alias(c) for c in payload],
                           _levels(F.col("m.node"), F.least(F.lit(LEVELS), F.col("depth") - done)).alias("levels"))
        tiers.append(stored(tier, f"{name}-tier", files))
        tops = tiers[-1].select("grp", "depth", F.col("block").alias("pos"),
                                F.element_at("levels", -1).cast("string").alias("node"))
        done += LEVELS
        ends.append(tops.where(F.col("depth") <= done).select("grp", F.col("node").alias("root")))
        nodes, payload, files = tops.where(F.col("depth") > done), [], 1 + files // 16
    roots = ends[0]
    for more in ends[1:]:
        roots = roots.union(more)
    return Tree(tiers, stored(roots, f"{name}-roots", files))


def paths_above(tree: Tree, tops: DataFrame) -> DataFrame:
    """`grp, block, path` and the further columns of `tops` for the blocks of the first tier: the siblings from the
    top node of a block up. `tops` has `grp, path` of every root."""
    more = [c for c in tops.columns if c not in ("grp", "path")]
    tops = broadcast_if_small(tops)
    above = None
    for k in range(len(tree.tiers) - 1, 0, -1):
        # The groups that end in a tier go on with the path of their root, the others with that of their block.
        tier, ends = tree.tiers[k], F.col("depth") <= LEVELS * (k + 1)
        rows = tier.where(ends).join(tops, "grp").select("grp", "block", "levels", "path", *more)
        if above is not None:
            rows = rows.union(tier.where(~ends).join(broadcast_if_small(above), ["grp", "block"]).select(*rows.columns))
        each = _expanded(rows, [], more)
        above = stored(each.select("grp", (F.col("block") * BLOCK + F.col("i")).alias("block"), "path", *more),
                       "tree-paths")
    first = tree.tiers[0].where(F.col("depth") <= LEVELS).join(tops, "grp").select("grp", "block", "path", *more)
    return first if above is None else first.union(above.select(*first.columns))


def _expanded(blocks: DataFrame, payload: list[str], more: list[str]) -> DataFrame:
    """A row per node of each block (`levels, path` with the path of its top): `i`, `node`, and its whole path."""
    levels = F.col("levels")
    each = F.transform(F.sequence(F.lit(0), (F.octet_length(levels[0]) / DIGEST).cast("int") - 1), lambda i: F.struct(
        i.alias("i"), F.substring(levels[0], i * DIGEST + 1, F.lit(DIGEST)).cast("string").alias("node"),
        *[F.get(c, i).alias(c) for c in payload], _path(levels, i).alias("below")))
    return blocks.select("grp", "block", "path", *more, F.inline(each)).withColumn("path", F.concat("below", "path"))


def placed_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of `leaves` (`source, id, leaf`, more) with their group and place, and the groups.

    Rows are sorted by range, so that a source with a third of all rows fills many tasks; a row's place is its
    place in its task plus the rows of its source in earlier tasks, and a source's number counts those that start
    before it. Null sources and ids come first; rows with one id are ordered by their leaf.
    """
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("id"), F.asc("leaf")]
    # Written first: the sort samples its input, and texts are to be digested once.
    leaves = stored(leaves, "digests")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(leaves.repartitionByRange(partitions(leaves.sparkSession), *order).sortWithinPartitions(*order)
                  .select("*", F.spark_partition_id().alias("part"), at.alias("at")), "leaves")
    # A row per source and task: few more than the larger of both numbers.
    pieces = stored(rows.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")),
                    "leaf-pieces")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select("part", "source", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
                           .alias("shift"))
    groups = pieces.groupBy("source").agg(F.min(F.struct("part", "first")).alias("start"), F.sum("n").alias("n"))
    # One row per task that a source starts in.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starting = groups.groupBy(F.col("start.part").alias("part")).agg(F.count(F.lit(1)).alias("k")).select(
        "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("part").orderBy("start.first")
    groups = groups.withColumn("part", F.col("start.part")).join(starting, "part").select(
        "source", "n", (F.col("earlier") + F.row_number().over(inside) - 1).cast("bigint").alias("grp"))
    groups = stored(groups, "leaf-groups")
    known = groups.select(F.col("source").alias("s"), "grp", depth_of(F.col("n")).alias("depth"))
    numbered = shifts.join(known, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("part").alias("p"), "s", "shift", "grp", "depth")
    numbered = broadcast_if_small(stored(numbered, "leaf-shifts"))
    found = rows.join(numbered, (rows["part"] == numbered["p"]) & rows["source"].eqNullSafe(numbered["s"]))
    keep = [c for c in leaves.columns if c != "source"]
    return found.select(*keep, "grp", "depth", (F.col("at") + F.col("shift")).alias("pos")), groups


def manifest_proofs(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    id_col: str = "doc_id", group_col: str = "source",
                    shown: dict[str, Column] | None = None) -> DataFrame:
    """`id, leaf, shown_leaf, subroot, root, path` of every row of `docs`.

    A leaf digests the `fields` of a row. The leaves of a group stand in the order of `id_col`, nulls first, those
    with one id in the order of their digests; groups stand in byte order, null first. `shown` replaces columns
    by what a reader was handed; `shown_leaf` is the leaf of that row (see `fold`), null where nothing differs.
    `path` has the siblings on the way up, as hex bytes, for `fold` and `proof_digest`. Every row is a leaf,
    repeated ones too; extra columns are not read; an empty table gives no rows.
    """
    leaf = leaf_digest([column(f) for f in fields])
    other = F.lit(None).cast("string")
    if shown:
        changed = [~column(c).eqNullSafe(value) for c, value in shown.items()]
        differs = changed[0]
        for one in changed[1:]:
            differs = differs | one
        other = F.when(differs, leaf_digest([shown.get(f, column(f)) for f in fields]))
    files = files_for(docs, 0.05)
    leaves = docs.select(column(group_col).cast("string").alias("source"), column(id_col).cast("bigint").alias("id"),
                         leaf.alias("leaf"), other.alias("shown_leaf"))
    placed, groups = placed_leaves(leaves)
    rows = build_tree(placed.withColumnRenamed("leaf", "node"), ["id", "shown_leaf"], "manifest", files)
    n = groups.count()
    nodes = rows.roots.join(groups.select("grp"), "grp").select(
        F.lit(0).alias("grp"), depth_of(F.lit(n)).alias("depth"), F.col("grp").alias("pos"), F.col("root").alias("node"))
    top = build_tree(nodes, [], "manifest-top", 1)
    end = top.roots.select("grp", F.array().cast(PATH).alias("path"), "root")
    above = paths_above(top, end)
    blocks = top.tiers[0].join(above, ["grp", "block"])
    tops = _expanded(blocks, [], ["root"]).select((F.col("block") * BLOCK + F.col("i")).alias("grp"),
                                                  F.col("node").alias("subroot"), "path", "root")
    above = stored(paths_above(rows, stored(tops, "manifest-tops", 1 + n // 100_000)), "manifest-paths", files)
    # A file of blocks is few rows and much work.
    blocks = rows.tiers[0].repartition(partitions(docs.sparkSession), "grp", "block")
    whole = _expanded(blocks.join(broadcast_if_small(above), ["grp", "block"]), ["id", "shown_leaf"], ["subroot", "root"])
    return whole.select("id", F.col("node").alias("leaf"), "shown_leaf", "subroot", "root", "path")


def verified_manifest(docs: DataFrame, shown: dict[str, Column] | None = None, **names) -> DataFrame:
    """`id, leaf, subroot, root, proof_sha256, folded_root, verified` of every row of `docs`.

    `folded_root` is what the shown row and the siblings of the original give; it is the root if and only if
    nothing was changed. See `manifest_proofs` for the arguments and the awkward cases.
    """
    rows = manifest_proofs(docs, shown=shown, **names)
    folded = rows.select("id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                         fold(F.coalesce("shown_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
