"""Near-duplicate vectors with a robust-pruned flat graph built on overlapping shards.

Distinct vectors go to their two nearest of a bounded number of centres (to
more, if too few links are found); a
centre's vectors are cut into blocks of bounded size. Each block builds a
pruned neighbour graph; adjacency lists of all blocks are united. Then pairs
of blocks of one centre are searched: a greedy beam search from the medoid
finds a query's surroundings, and while hits are in range their neighbours are
expanded. Hits are exact cosines in double precision. A pair seen under several
centres counts at the smallest one, so links are summed without ever
writing pairs out; for components a block pair emits a star per local group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored

THRESHOLD = 0.9
#: Vectors that centres are fitted on (bound), and centres: one for each so many vectors, in these limits.
SAMPLE, PER_CENTRE, FEWEST, MOST = 20_000, 1_000, 4, 1024
#: Vectors in a block (bound of a task's work: two blocks).
BLOCK = 2_000
#: Centres that a vector goes to at first.
NEAR = 2
#: Out-edges, pruning factor, candidates for pruning, beam of the search.
DEGREE, ALPHA, CANDIDATES, BEAM = 24, 1.2, 64, 32
RECALL = 0.9
#: Queries and rows that a task of the audit compares.
QUERIES, ROWS = 2_000, 20_000


def usable(vector) -> F.Column:
    """Non-null, not empty, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows) -> np.ndarray:
    v = np.array([np.asarray(x, dtype=np.float64) for x in rows], dtype=np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def centres(vectors: DataFrame, number: int) -> np.ndarray:
    """Spherical k-means on a bounded sample of distinct vectors of one length."""
    got = vectors.select("node", "embedding").orderBy(F.xxhash64(F.lit(5), "node"), "node").limit(SAMPLE).toPandas()
    v = _unit(got["embedding"])
    rng = np.random.default_rng(5)
    c = v[rng.choice(len(v), min(number, len(v)), replace=False)]
    for _ in range(8):
        own = (v @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def prune(v: np.ndarray, near: np.ndarray, similarity: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[list[int]]:
    """Robust pruning: take the nearest candidate, drop those that it is ``alpha`` times closer to, repeat."""
    out = []
    for row, sims in zip(near, similarity, strict=True):
        left = np.ones(len(row), dtype=bool)
        away = 2 - 2 * sims
        between = 2 - 2 * v[row] @ v[row].T
        own = []
        for k in range(len(row)):
            if left[k]:
                own.append(int(row[k]))
                if len(own) == degree:
                    break
                left &= alpha * alpha * between[k] > away
                left[k] = False
        out.append(own)
    return out


def block_graph(v: np.ndarray) -> list[list[int]]:
    """Out-edges of each vector of a block: pruned nearest ones, made mutual as far as the degree allows."""
    n = len(v)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return [[] for _ in range(n)]
    near, sims = np.empty((n, k), dtype=np.int64), np.empty((n, k))
    for at in range(0, n, 512):
        s = v[at : at + 512] @ v.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n else np.argsort(-s, axis=1)
        own = np.take_along_axis(s, top, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        near[at : at + 512], sims[at : at + 512] = np.take_along_axis(top, order, 1), np.take_along_axis(own, order, 1)
    edges = prune(v, near, sims)
    back: list[list[int]] = [[] for _ in range(n)]
    for a, bs in enumerate(edges):
        for b in bs:
            back[b].append(a)
    for a, bs in enumerate(back):
        edges[a] = list(dict.fromkeys(edges[a] + bs[:DEGREE]))
    return edges


def range_search(v: np.ndarray, adjacency: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Which vectors each query reaches in range: boolean (queries, vectors).

    ``adjacency`` is padded with -1. All queries advance together: each step
    expands a query's best unexpanded vector in its beam; then, and as long as
    there are any, its unexpanded hits.
    """
    n, q = len(v), len(queries)
    sims = np.full((q, n + 1), -2.0)
    open_ = np.zeros((q, n + 1), dtype=bool)
    medoid = int((v @ v.sum(axis=0)).argmax())
    rows = np.arange(q)
    starts = np.unique(np.concatenate([[medoid], np.linspace(0, n - 1, min(n, 8)).astype(int)]))
    sims[:, starts] = queries @ v[starts].T
    open_[:, starts] = True
    active = rows
    for _ in range(4 * n):
        # the best `beam` seen so far bound the greedy part; hits are expanded whatever their rank
        known = sims[active]
        k = min(beam, n)
        floor = np.partition(known, n + 1 - k, axis=1)[:, n + 1 - k]
        can = np.where(open_[active] & ((known >= floor[:, None]) | (known >= threshold)), known, -3.0)
        best = can.argmax(axis=1)
        going = can[np.arange(len(active)), best] > -3
        active, best = active[going], best[going]
        if not len(active):
            break
        open_[active, best] = False
        neighbours = adjacency[best]
        fresh = (neighbours >= 0) & (sims[active[:, None], neighbours] == -2.0)
        r, c = np.nonzero(fresh)
        if len(r):
            qs, to = active[r], neighbours[r, c]
            sims[qs, to] = np.einsum("ij,ij->i", queries[qs], v[to])
            open_[qs, to] = True
    return sims[:, :n] >= threshold


def _local_components(links: np.ndarray) -> np.ndarray:
    """Smallest reachable place by a symmetric boolean matrix."""
    label = np.arange(len(links))
    touched = np.flatnonzero(links.any(axis=1))
    while len(touched):
        new = np.array([min(label[i], label[links[i]].min()) for i in touched])
        new = np.minimum(new, label[new])
        if (new == label[touched]).all():
            break
        label[touched] = new
    return label


def _assign(vectors: DataFrame, c: np.ndarray, near: int) -> DataFrame:
    """(node, dim, embedding, cs): the ``near`` nearest centres; other lengths get centre 0 only."""
    sent = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for b in batches:
            cs = [[0]] * len(b)
            fits = np.flatnonzero((b["dim"] == c.shape[1]).to_numpy())
            if len(fits):
                order = np.argsort(-(_unit(b["embedding"].iloc[fits]) @ c.T), axis=1, kind="stable")[:, :near]
                for i, own in zip(fits, order.tolist(), strict=True):
                    cs[i] = own
            yield b.assign(cs=cs)

    kinds = ", ".join(f"{n} {k}" for n, k in vectors.dtypes)
    return vectors.mapInPandas(run, f"{kinds}, cs array<long>")


def met_before(cs, centre: int) -> np.ndarray:
    """Which pairs share a centre with a smaller number than this one."""
    before = [[x for x in own if x < centre] for own in cs]
    names = {x: i for i, x in enumerate(sorted({x for own in before for x in own}))}
    belongs = np.zeros((len(before), max(1, len(names))), dtype=np.float32)
    for i, own in enumerate(before):
        belongs[i, [names[x] for x in own]] = 1
    return belongs @ belongs.T > 0


def search(vectors: DataFrame, threshold: float, beam: int, c: np.ndarray, near: int = 2) -> DataFrame:
    """(node, links, root) rows, several for a node: links to sum up and local component roots to connect.

    ``vectors``: node, copies, dim, embedding; each embedding once.
    """
    assigned = stored(_assign(vectors, c, near))
    member = assigned.withColumn("centre", F.explode("cs"))
    # Blocks of bounded size: the number of a centre's blocks follows its count; at most MOST + rare lengths rows.
    size = member.groupBy("dim", "centre").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    member = stored(member.join(size, ["dim", "centre"]).withColumn("block", F.pmod(F.xxhash64(F.lit(9), "node"), "blocks")))

    def build(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("node", kind="stable")
        nodes = b["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "near": [nodes[e] for e in block_graph(_unit(b["embedding"]))]})

    lists = member.select("dim", "centre", "block", "node", "embedding").groupBy("dim", "centre", "block").applyInPandas(build, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
    tasks = member.join(united, "node").withColumn("pair", F.explode(pairs)).select("node", "copies", "embedding", "cs", "near", "block", "dim", "centre", "pair.low", "pair.high")

    def find(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("node", kind="stable")
        nodes, copies, block = b["node"].to_numpy(), b["copies"].to_numpy(), b["block"].to_numpy()
        v, place = _unit(b["embedding"]), {x: i for i, x in enumerate(nodes)}
        lists = [[place[x] for x in near if x in place] for near in b["near"]]
        # Blocks of one pair hang together by a few bridges between their members.
        step = max(1, len(nodes) // 16)
        for i in range(0, len(nodes), step):
            other = (i + step) % len(nodes)
            lists[i].append(other)
            lists[other].append(i)
        adjacency = np.full((len(nodes) + 1, max(1, *map(len, lists)) if len(lists) > 1 else max(1, len(lists[0]))), -1, dtype=np.int64)
        for i, own in enumerate(lists):
            adjacency[i, : len(own)] = own
        hits = np.concatenate([range_search(v, adjacency, v[at : at + 512], threshold, beam) for at in range(0, len(v), 512)])
        hits |= hits.T
        np.fill_diagonal(hits, False)
        # A pair of blocks counts pairs between them; a block with itself those inside. A pair with several common
        # centres counts at the smallest one.
        if key[2] != key[3]:
            hits &= block[:, None] != block[None, :]
        hits &= ~met_before(b["cs"], key[1])
        root = _local_components(hits)
        return pd.DataFrame({"node": nodes, "links": hits @ copies, "root": nodes[root]}).query("links > 0")

    return tasks.groupBy("dim", "centre", "low", "high").applyInPandas(find, "node long, links long, root long")


def audit(vectors: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> float:
    """Links found over links there are, for the nodes that hold an id divisible by 100 (``asked``), compared with all rows in blocks."""
    picked = stored(vectors.where("asked").select(F.col("node").alias("q"), F.col("dim").alias("qdim"), F.col("embedding").alias("qv")))
    # The stated query set against all rows: each chunk of queries meets each block of rows once; both are bounded.
    chunks, parts = (max(1, -(-n // size)) for n, size in ((picked.count(), QUERIES), (vectors.count(), ROWS)))
    rows = vectors.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    left = picked.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def count(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        total = []
        for dim, qs in a.groupby("qdim"):
            own = b[b["dim"] == dim]
            if len(own):
                s = _unit(qs["qv"]) @ _unit(own["embedding"]).T >= threshold
                s &= qs["q"].to_numpy()[:, None] != own["node"].to_numpy()[None, :]
                total.append(pd.DataFrame({"node": qs["q"].to_numpy(), "there": s @ own["copies"].to_numpy()}))
        return pd.concat(total) if total else pd.DataFrame({"node": [], "there": []}).astype("int64")

    there = left.groupBy("chunk", "part").cogroup(rows.select("chunk", "part", "node", "copies", "dim", "embedding").groupBy("chunk", "part")).applyInPandas(count, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    got = there.join(found, "node", "left").agg(F.sum("there"), F.sum(F.least(F.coalesce("links", F.lit(0)), F.col("there")))).first()
    return 1.0 if not got[0] else got[1] / got[0]


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for every row; ids of any type.

    Equal vectors are one node with its number of copies. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths. recall is the audited share of links
    found (a constant column); below RECALL the search runs again with a beam
    four times as wide and four times as many centres a vector, twice at most,
    and then an error is raised. Repeated
    ids and rows without an id count as rows of their own; the component_id of
    a component without any id is null. An empty table gives an empty result.
    """
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    good = rows.where(usable(F.col("embedding")))
    # Ids that are no numbers can't be divisible: then a hash of the id decides.
    number = F.coalesce(F.col("vec_id").cast("string").try_cast("bigint"), F.xxhash64("vec_id"))
    distinct = good.groupBy("embedding").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("copies"), F.bool_or(F.pmod(number, F.lit(100)) == 0).alias("asked"))
    nodes = stored(distinct.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("embedding")}))
    common = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    alone = lambda x: x.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if common is None:
        return alone(rows).select("vec_id", "n_links", "component_id", F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    c = centres(nodes.where(F.col("dim") == common["dim"]), int(min(MOST, max(FEWEST, common["n"] // PER_CENTRE))))
    for wider in (1, 4, 16):
        found = stored(search(nodes.select("node", "copies", "dim", "embedding"), threshold, wider * BEAM, c, wider * NEAR))
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        recall = audit(nodes, links, threshold)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"recall {recall:.3f} stays below {RECALL}")
    component = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    named = nodes.join(component, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("low_id").alias("component_id"))
    result = named.join(low, "component").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(result, "embedding").select("vec_id", "n_links", "component_id")
    every = linked.unionByName(alone(rows.where(~usable(F.col("embedding")))))
    return every.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("recall"))
