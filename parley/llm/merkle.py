"""A Merkle manifest of a dataset: one tree a group, and one over the groups' roots.

Each row is a leaf; every 8 consecutive nodes of a level become the digest of
their hex digests, put together. Only every second level is stored, as blocks
of 64 consecutive nodes (checkpoint and recompute): a proof regenerates the
level between from a block's nodes, emits the siblings, and drops it again.

Leaves are numbered without a window over a group: rows are range-partitioned
by group and order, and the sizes of the (partition, group) runs give each run
its first number. So one group may hold most rows. Levels shrink by 64; the
jobs' number grows with the logarithm of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ARITY = 8
#: Nodes of a stored block: two levels.
BLOCK = ARITY * ARITY


def sha256(*parts) -> F.Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(column: F.Column) -> F.Column:
    """A value that can't be mistaken for its neighbours: ``-`` for null, else byte count, ``:``, value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(column: F.Column) -> F.Column:
    """Group name that is never null and sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, key, node, ...; a stored table) with pos, the place from 0 in its tree by (key, node), and n, the tree's size."""
    order = ["tree", "key", "node", "row"]
    # Equal rows are told apart by their place in the table, so that many of them don't meet in one partition.
    ranged = leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.drop("row").withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    runs = ranged.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("size").over(own).alias("n")))
    return ranged.join(runs, ["part", "tree"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def blocks(nodes: DataFrame) -> DataFrame:
    """Stored blocks (tree, n, block, members in order) of the nodes (tree, n, pos, node, ...) of a level."""
    rest = [c for c in nodes.columns if c not in ("tree", "n", "pos")]
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"))
    return stored(grouped.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("members")))


def digests() -> F.Column:
    return F.transform("members", lambda m: m["node"])


def between(nodes: F.Column) -> F.Column:
    """Digests of every 8 of a block's nodes: the level that isn't stored."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(starts, lambda i: sha256(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), "")))


def above(level: DataFrame) -> DataFrame:
    """Nodes (tree, n, pos, node) two levels up; a tree with up to 8 nodes ends one level up, a single node is its root."""
    known = level.withColumn("nodes", digests())
    two = sha256(F.array_join(between(F.col("nodes")), ""))
    node = F.when(F.col("n") == 1, F.col("nodes")[0]).when(F.col("n") <= ARITY, sha256(F.array_join("nodes", ""))).otherwise(two)
    return known.select("tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), node.alias("node"))


@dataclass
class Trees:
    levels: list[DataFrame]  # blocks of levels 0, 2, 4, ...; the last has one node a tree
    roots: DataFrame  # tree, node


def build(leaves: DataFrame) -> Trees:
    """Trees over ``leaves``: tree (not null), key, node (hex digest), and what else is to stay with a leaf.

    Leaves are ordered by key, null first, and equal keys by digest. An empty
    table gives no tree.
    """
    levels = [blocks(numbered(leaves).drop("key"))]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(blocks(above(levels[-1])))
    return Trees(levels, levels[-1].select("tree", F.col("members")[0]["node"].alias("node")))


def prove(trees: Trees, tails: DataFrame) -> DataFrame:
    """Every leaf's columns with path, the siblings before and after it on each level, and what ``tails`` has for its tree.

    tails: tree, path (levels above the tree's root), and any other columns.
    Upper levels are joined to the blocks below by block number, and each block
    hands its members their own two levels.
    """
    more = [c for c in tails.columns if c not in ("tree", "path")]
    kind = "array<struct<before: string, after: string>>"
    path = tails.withColumns({"pos": F.lit(0).cast("long"), "path": F.col("path").cast(kind)})
    for k, level in reversed(list(enumerate(trees.levels))):
        if k == len(trees.levels) - 1 and k:
            continue  # one node a tree: nothing beside it
        whole = level.withColumn("nodes", digests()).withColumn("mids", between(F.col("nodes")))
        joined = whole.join(path.withColumnRenamed("pos", "block"), ["tree", "block"])
        each = joined.select("tree", "n", "nodes", "mids", "path", *more, F.posexplode("members").alias("j", "m"))
        run, at = F.floor(F.col("j") / ARITY).cast("int"), F.col("j") % ARITY
        join = lambda x: F.array_join(x, "")
        low = F.struct(join(F.slice("nodes", run * ARITY + 1, at)).alias("before"), join(F.slice("nodes", F.col("j") + 2, ARITY - 1 - at)).alias("after"))
        high = F.struct(join(F.slice("mids", F.lit(1), run)).alias("before"), join(F.slice("mids", run + 2, F.lit(ARITY))).alias("after"))
        own = F.when(F.col("n") == 1, F.array().cast(kind)).when(F.col("n") <= ARITY, F.array(low)).otherwise(F.array(low, high))
        path = each.select("tree", "m.*", *more, F.concat(own, "path").alias("path"))
        if k:
            path = stored(path.drop("node"))
    return path


def fold(leaf, path) -> F.Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, x: sha256(x["before"], acc, x["after"]))


def proof_digest(path) -> F.Column:
    return sha256(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""))


def manifest(rows: DataFrame) -> tuple[DataFrame, str | None]:
    """Proofs of all leaves under one root, and the root (None for an empty table).

    ``rows``: group (any type; null is a group of its own), key, node, and
    other columns, which stay. Adds subroot and path; groups are ordered null
    first, then bytewise.
    """
    own = build(stored(rows.withColumn("tree", group_key(F.col("group"))).drop("group")))
    top = build(stored(own.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node", F.col("tree").alias("of"))))
    root = top.roots.first()
    tails = prove(top, top.roots.select("tree", F.array().alias("path")))
    return prove(own, tails.select(F.col("of").alias("tree"), F.col("node").alias("subroot"), "path")), root and root["node"]


def leaf_of(docs: DataFrame, text: F.Column) -> F.Column:
    return sha256(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text))


def tamper_check(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of documents.

    Where 3 divides crc32 of the decimal doc_id, the leaf that is folded has A-Z of its text
    lower-cased; a null id is never tampered with. Rows without an id come first in their language,
    repeated rows are leaves of their own, and rows of one id are ordered by their leaf. An empty
    table gives an empty result; other columns are ignored.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("doc_id", F.col("lang").alias("group"), F.col("doc_id").alias("key"), leaf_of(docs, F.col("text")).alias("node"), F.when(hit, leaf_of(docs, lowered)).alias("tampered"))
    found, root = manifest(rows)
    folded = fold(F.coalesce("tampered", "node"), F.col("path"))
    result = found.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(source: str, name: str, tree: str, levels: int) -> str:
    """CTEs of a tree's levels: {name}0 holds (tree, pos, node); {name}k also the runs that made its nodes."""
    out = [f"{name}0 AS ({source})"]
    for k in range(levels):
        # a tree with one node left stays as it is
        out.append(f"""{name}r{k} AS (SELECT {tree}, pos // 8 AS pos, list(node ORDER BY pos) AS run, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY {tree}) AS n FROM {name}{k}) GROUP BY {tree}, pos // 8),
{name}{k + 1} AS (SELECT {tree}, pos, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS node FROM {name}r{k})""")
    return ",\n".join(out)


def oracle(levels: int = 8, top: int = 4) -> str:
    """DuckDB SQL of tamper_check for up to 8^levels rows a language and 8^top languages."""
    bits = "[(ascii(substr(s, CAST(i // 8 + 1 AS INTEGER), 1)) >> CAST(i % 8 AS INTEGER)) & 1 for i in range(8 * length(s))]"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)), 4294967295)"
    value = lambda c: f"coalesce(CAST(octet_length(encode({c})) AS VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # one level after the other, as a chain of joins
    chain = "SELECT a.doc_id, a.tree, a.pos, l.pos AS lpos, a.node AS leaf, a.used, l.node AS subroot FROM a JOIN g0 l ON l.of_tree = a.tree"
    ctes, last, acc = [f"s0 AS (SELECT *, used AS acc, '' AS proof FROM ({chain}))"], "s0", 0
    for name, n, tree, pos in (("a", levels, "s.tree", "s.pos"), ("g", top, "''", "s.lpos")):
        for k in range(n):
            acc += 1
            at = f"(({pos} // {8**k}) % 8)"
            before, after = f"array_to_string(r.run[1:{at}], '')", f"array_to_string(r.run[{at} + 2:8], '')"
            ctes.append(f"s{acc} AS (SELECT s.* REPLACE (CASE WHEN r.n = 1 THEN acc ELSE sha256({before} || acc || {after}) END AS acc, CASE WHEN r.n = 1 THEN proof ELSE proof || {before} || {after} END AS proof) FROM {last} s JOIN {name}r{k} r ON r.tree = {tree} AND r.pos = {pos} // {8 ** (k + 1)})")
            last = f"s{acc}"
    return f"""WITH d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf("text")} AS node, CASE WHEN s IS NOT NULL AND ({crc}) % 3 = 0 THEN {leaf(lowered)} END AS tampered FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
a AS (SELECT *, coalesce(tampered, node) AS used, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM d),
{_levels("SELECT tree, pos, node FROM a", "a", "tree", levels)},
{_levels(f"SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, node, tree AS of_tree FROM a{levels}", "g", "tree", top)},
{", ".join(ctes)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM {last}, (SELECT node AS root FROM g{top})"""
