"""Hard negatives by exact inner products: cover trees over norm-augmented candidates.

A candidate x gets one more component, sqrt(M^2 - |x|^2) with M the largest
norm, so all lie on a sphere and an inner product q.x is (|q|^2 + M^2 - d^2) / 2,
d being the distance of q (with 0 added) from x. A node that covers its
candidates within radius r of its centre thus bounds their inner products on
both sides by d - r and d + r. A query is a window of scores: descent takes the
node with the highest bound first, skips nodes that lie outside the window, hold
no wanted label or can't beat the k-th best, and scores the leaves exactly.

The top level of the tree is fitted on a bounded sample; its nodes are cells,
cut into shards of bounded size, and each shard is a tree of its own. A query
first descends the shards with the highest bounds, and then all others that may
still beat its k-th best. All windows of a query share a descent. Every pair of query
and shard meets in a task with a bounded number of queries; nothing but the shards' centres, radii and labels is
broadcast, and their number is bounded.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: Rows that the top level is fitted on (bound). Rows of a shard: SHARD, and more from SHARD * MOST_CELLS rows on.
SAMPLE, SHARD, MOST_CELLS = 20_000, 4_096, 8_192
#: Children of a node, and candidates that a leaf holds unless they are equal.
FAN, LEAF = 32, 128
#: Shards that a query descends first; queries of one task, and of one descent.
FIRST, QUERIES, TOGETHER = 2, 20_000, 512
#: Results of a descent that wait until the best are taken of them.
WAITING = 1_000_000
#: Shards with few labels carry them in their summary.
FEW_LABELS = 32
LONG = 2**63 - 1


def whole(vector, factor: int = 256) -> F.Column:
    """Components as whole numbers, floor(factor * x), x as double; beyond the range of a long they are its ends."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def long_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of large whole numbers; beyond the range of a long they are its ends."""
    return np.array([max(-LONG, min(LONG, sum(int(a) * int(b) for a, b in zip(q, row, strict=True)))) for row in v], dtype=np.int64)


def farthest_first(x: np.ndarray, most: int, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (places, the first row first), each row's nearest one and its distance; until all are ``within`` or ``most`` are taken."""
    centres = [0]
    away = np.linalg.norm(x - x[0], axis=1)
    own = np.zeros(len(x), dtype=np.int64)
    while len(centres) < most and away.max() > within:
        far = int(away.argmax())
        new = np.linalg.norm(x - x[far], axis=1)
        closer = new < away
        own[closer], away = len(centres), np.minimum(away, new)
        centres.append(far)
    return np.array(centres), own, away


@dataclass
class Tree:
    """Arrays by node, children next to each other; candidates are in the order of the leaves."""

    centre: np.ndarray  # place of the centre among the candidates
    radius: np.ndarray
    child: np.ndarray  # first child, -1 for a leaf
    children: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    only: np.ndarray  # the label of all its candidates, -1 if they differ
    v: np.ndarray
    label: np.ndarray
    node: np.ndarray
    rank: np.ndarray  # order of ids
    largest: np.ndarray  # M^2

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as x:
            return Tree(**{k: x[k] for k in x.files})


def augmented(v: np.ndarray, largest: float) -> np.ndarray:
    v = v.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(0.0, largest - (v * v).sum(axis=1)))])


def cover_tree(v: np.ndarray, label: np.ndarray, node: np.ndarray, rank: np.ndarray, largest: float) -> Tree:
    """Each level's covering radius is at most half of the one above, or what FAN centres, each the farthest from the others, reach."""
    x = augmented(v, largest)
    order: list[np.ndarray] = []
    rows: list[list] = []  # centre, radius, child, children, start, stop

    def add(members: np.ndarray) -> None:  # members[0] is the centre
        rows.append([members[0], float(np.linalg.norm(x[members] - x[members[0]], axis=1).max()), -1, 0, 0, 0])

    # Depth-first over an explicit stack; a node's children take places next to each other.
    add(np.arange(len(x)))
    stack = [(0, np.arange(len(x)))]
    at = 0
    ends: list[tuple[int, int]] = []
    while stack:
        k, members = stack.pop()
        if members is None:
            ends.append((k, at))
            continue
        rows[k][4] = at
        if len(members) <= LEAF or rows[k][1] == 0:
            order.append(members)
            at += len(members)
            rows[k][5] = at
            continue
        centres, own, _ = farthest_first(x[members], FAN, rows[k][1] / 2)
        rows[k][2], rows[k][3] = len(rows), len(centres)
        parts = []
        for c, first in enumerate(centres):
            part = members[own == c]
            part = np.concatenate(([members[first]], part[part != members[first]]))
            parts.append((len(rows), part))
            add(part)
        stack.append((k, None))
        stack.extend(reversed(parts))
    for k, end in ends:
        rows[k][5] = end
    places = np.concatenate(order)
    back = np.empty(len(places), dtype=np.int64)
    back[places] = np.arange(len(places))
    label = label[places]
    r = list(zip(*rows, strict=True))
    start, stop = np.array(r[4], dtype=np.int64), np.array(r[5], dtype=np.int64)
    only = np.array([label[a] if (label[a:b] == label[a]).all() else -1 for a, b in zip(start, stop, strict=True)], dtype=np.int64)
    return Tree(back[np.array(r[0])], np.array(r[1]), np.array(r[2], dtype=np.int64), np.array(r[3], dtype=np.int64), start, stop, only, v[places], label, node[places], rank[places], np.array(largest))


def bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner product of one query (or each row of several) with what lies within ``radius`` of the centres (all as doubles), wider by what rounding may take."""
    top = (q * q).sum(axis=-1, keepdims=True) + largest
    d = np.sqrt(np.maximum(0.0, top - 2 * (q @ centres.T)))
    slack = 1e-9 * top + 1e-6
    return (top - (d + radius) ** 2) / 2 - slack, (top - np.maximum(0.0, d - radius) ** 2) / 2 + slack


class Searcher:
    """Descends one tree for many queries."""

    def __init__(self, t: Tree):
        self.t, self.f, self.largest = t, t.v.astype(float), float(t.largest)
        self.centres = self.f[t.centre]
        self.most = float(np.abs(self.f).max(initial=0.0)) * self.f.shape[1]

    def wanted(self, nodes: slice, q: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes may hold candidates in one of the windows with such a label, and how high they reach in the highest."""
        lo, hi = bounds(q, self.centres[nodes], self.t.radius[nodes], self.largest)
        only = self.t.only[nodes]
        can = ((hi >= low[:, None]) & (lo <= high[:, None])).any(axis=0) & ((only < 0) | (only == label) if same else only != label)
        return can, np.minimum(hi, high.max())

    def descend(self, q: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int, own: int) -> list[list[tuple[int, int, int]]]:
        """For each window the best k of (-score, rank, place) with low <= score <= high and a label that is the same, or another; without node ``own``.

        All windows of a query share one descent, so that a leaf is scored once.
        """
        t, f = self.t, q.astype(float)
        exact = self.most * float(np.abs(f).max(initial=0.0)) < 2**53  # in doubles
        best: list[list[tuple[int, int, int]]] = [[] for _ in low]
        # what can't beat a window's k-th best is outside of the window from then on; an equal score may, by its id
        least = low.copy()
        can, reach = self.wanted(slice(0, 1), f, label, same, least, high)
        heap = [(-float(reach[0]), 0)] if can[0] else []
        while heap:
            bound, i = heapq.heappop(heap)
            if (np.minimum(-bound, high) < least).all():
                break
            if t.child[i] >= 0:
                c = slice(t.child[i], t.child[i] + t.children[i])
                can, reach = self.wanted(c, f, label, same, least, high)
                for j in np.flatnonzero(can).tolist():
                    heapq.heappush(heap, (-float(reach[j]), c.start + j))
                continue
            a, b = t.start[i], t.stop[i]
            score = self.f[a:b] @ f if exact else long_products(q, t.v[a:b])
            near = np.flatnonzero(score >= least.min())
            if not len(near):
                continue
            near = near[((t.label[a + near] == label) == same) & (t.node[a + near] != own)]
            found = score[near]
            for w in range(len(low)):
                fits = near[(found >= least[w]) & (found <= high[w])]
                if len(fits):
                    best[w] = heapq.nsmallest(k, [*best[w], *((-int(score[j]), int(t.rank[a + j]), int(a + j)) for j in fits)])
                    if len(best[w]) == k:
                        least[w] = max(int(least[w]), -best[w][-1][0])
        return best

    def exact(self, q: np.ndarray) -> np.ndarray:
        """Which queries (rows) have only inner products that doubles hold exactly."""
        return self.most * np.abs(q).max(axis=1, initial=0.0) < 2**53

    def leaves(self, q: np.ndarray, label: np.ndarray, same: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves that some query may want, and how high each reaches for each query (-inf where it isn't wanted)."""
        t, found = self.t, []

        def wanted(nodes: slice, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lo, hi = bounds(q[some], self.centres[nodes], t.radius[nodes], self.largest)
            only, can = t.only[nodes], np.zeros(hi.shape, dtype=bool)
            for w in range(low.shape[1]):
                can |= (hi >= low[some, w, None]) & (lo <= high[some, w, None])
            is_own = only == label[some, None]
            return can & np.where(same[some, None], (only < 0) | is_own, ~is_own), hi

        stack = [(slice(0, 1), np.arange(len(q)))]
        while stack:
            nodes, some = stack.pop()
            can, hi = wanted(nodes, some)
            for j in np.flatnonzero(can.any(axis=0)).tolist():
                i, who = nodes.start + j, some[can[:, j]]
                if t.child[i] >= 0:
                    stack.append((slice(t.child[i], t.child[i] + t.children[i]), who))
                else:
                    found.append((i, who, hi[can[:, j], j]))
        reach = np.full((len(q), len(found)), -np.inf)
        for j, (_, who, hi) in enumerate(found):
            reach[who, j] = hi
        return np.array([i for i, _, _ in found], dtype=np.int64), reach

    def descend_all(self, q: np.ndarray, label: np.ndarray, same: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, window, place, score) as ``descend`` finds them, for many queries (rows) that are ``exact``; unused windows have low > high.

        Each query goes to its highest leaf first; then every leaf is scored at
        once for all queries of which it may still beat a window's k-th best.
        """
        t = self.t
        leaf, reach = self.leaves(q, label, same, low, high)
        least = low.astype(float)
        top = np.full((*low.shape, k), -np.inf)
        kept: list[tuple[np.ndarray, ...]] = []

        def best() -> tuple[np.ndarray, ...]:
            n, w, place, score = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.empty(0, dtype=np.int64),) * 4
            still = score >= least[n, w]
            n, w, place, score = n[still], w[still], place[still], score[still]
            order = np.lexsort((t.rank[place], -score, w, n))
            n, w, place, score = n[order], w[order], place[order], score[order]
            new = np.ones(len(n), dtype=bool)
            new[1:] = (n[1:] != n[:-1]) | (w[1:] != w[:-1])
            first = np.flatnonzero(new)
            good = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n)))) < k
            return n[good], w[good], place[good], score[good]

        def visit(i: int, who: np.ndarray) -> None:
            a, b = t.start[i], t.stop[i]
            score = q[who] @ self.f[a:b].T
            fine = ((t.label[a:b] == label[who, None]) == same[who, None]) & (t.node[a:b] != own[who, None])
            for w in range(low.shape[1]):
                fits = fine & (score >= least[who, w, None]) & (score <= high[who, w, None])
                some = np.flatnonzero(fits.any(axis=1))
                if not len(some):
                    continue
                row, column = np.nonzero(fits[some])
                kept.append((who[some[row]], np.full(len(row), w), a + column, score[some[row], column]))
                both = np.concatenate((top[who[some], w], np.where(fits[some], score[some], -np.inf)), axis=1)
                both = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                top[who[some], w] = both
                least[who[some], w] = np.maximum(least[who[some], w], both[:, 0])
            if sum(len(x[0]) for x in kept) > WAITING:
                kept[:] = [best()]

        if len(leaf):
            highest = reach.argmax(axis=1)
            asks = reach[np.arange(len(q)), highest] > -np.inf
            for j in np.unique(highest[asks]).tolist():
                visit(leaf[j], np.flatnonzero(asks & (highest == j)))
            reach[np.arange(len(q)), highest] = -np.inf
            for j in np.argsort(-reach.max(axis=0), kind="stable").tolist():
                who = np.flatnonzero(((reach[:, j, None] >= least) & (high >= least)).any(axis=1))
                if len(who):
                    visit(leaf[j], who)
        return best()


@dataclass
class Index:
    shards: DataFrame  # dim, cell, block, size, centre, radius, labels, tree
    dim: int | None  # the most frequent length of a vector
    largest: float


def usable(row_label, vector) -> F.Column:
    """Neither label nor vector null, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(row_label.isNotNull() & vector.isNotNull() & finite, F.lit(False))


def candidates(rows: DataFrame) -> DataFrame:
    """Stored (node, id, label, v, dim) of the rows (id long, label, v array<long>)."""
    return stored(rows.select(F.monotonically_increasing_id().alias("node"), "id", F.col("label").cast("string").alias("label"), "v", F.size("v").alias("dim")))


def build(rows: DataFrame, most: int) -> Index:
    """Trees over candidates(), for queries of up to ``most`` results.

    Of rows equal in vector and label only the most + 1 with the smallest ids
    are indexed: no query can return another.
    """
    copies = Window.partitionBy("v", "label").orderBy(F.col("id").asc_nulls_last(), "node")
    rows = stored(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= most + 1).drop("copy"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("m"))
    top = sizes.orderBy(F.desc("n"), "dim").first()
    largest = float(sizes.agg(F.max("m")).first()[0] or 0.0)
    dim, n = (top["dim"], top["n"]) if top else (None, 0)
    shard = max(SHARD, -(-n // MOST_CELLS))
    sample = rows.where(F.col("dim") == F.lit(dim)).select("node", "v").orderBy(F.xxhash64(F.lit(13), "node"), "node").limit(SAMPLE).toPandas()
    pivots = np.zeros((1, (dim or 0) + 1))
    if len(sample) and dim:
        x = augmented(np.stack(sample["v"].to_list()), largest)
        pivots = x[farthest_first(x, max(1, min(MOST_CELLS, n // shard)), 0.0)[0]]
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    bounded_batches(rows.sparkSession)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = sent.value
        for b in batches:
            cell = np.full(len(b), -1, dtype=np.int64)
            fits = np.flatnonzero((b["dim"] == dim).to_numpy())
            if len(fits):
                x = augmented(np.stack(b["v"].iloc[fits].to_list()), largest) if dim else np.zeros((len(fits), 1))
                cell[fits] = (x @ p.T - (p * p).sum(axis=1) / 2).argmax(axis=1)
            yield pd.DataFrame({"node": b["node"], "cell": cell})

    celled = rows.join(stored(rows.select("node", "v", "dim").mapInPandas(assign, "node long, cell long")), "node")
    celled = stored(celled)
    blocks = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).alias("blocks"))
    placed = celled.join(blocks, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), "blocks"))

    def plant(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["id", "node"], kind="stable", na_position="last")
        names, label = np.unique(b["label"].to_numpy(dtype=str), return_inverse=True)
        v = np.stack(b["v"].to_list()).reshape(len(b), key[0])
        t = cover_tree(v, label, b["node"].to_numpy(), np.arange(len(b)), largest)
        ids = np.array([-1 if x is None or x != x else int(x) for x in b["id"]], dtype=np.int64)[t.rank]
        known = np.array([x is not None and x == x for x in b["id"]])[t.rank]
        raw = {"tree": t.dump(), "ids": ids.tobytes(), "known": known.tobytes(), "names": list(names)}
        return pd.DataFrame([{"dim": key[0], "cell": key[1], "block": key[2], "size": len(b), "centre": t.v[t.centre[0]], "radius": t.radius[0], "labels": list(names) if len(names) <= FEW_LABELS else None, **raw}])

    kind = "dim int, cell long, block long, size long, centre array<long>, radius double, labels array<string>, tree binary, ids binary, known binary, names array<string>"
    # ids may be null beside longs: they travel as text
    shards = placed.select("dim", "cell", "block", "node", F.col("id").cast("decimal(20,0)").alias("id"), "label", "v").groupBy("dim", "cell", "block").applyInPandas(plant, kind)
    return Index(stored(shards.withColumn("shard", F.concat_ws("/", "dim", "cell", "block"))), dim, largest)


def routes(index: Index, queries: DataFrame, seen: bool) -> DataFrame:
    """(query columns, shard) for the shards that may hold results: the FIRST best ones, or with ``seen`` all others that reach ``low``."""
    known = index.shards.where(F.col("dim") == F.lit(index.dim)).select("shard", "centre", "radius", "labels").orderBy("shard")
    # At most 2 * MOST_CELLS shards of one length: some 10 MB of centres for 64 components.
    summary = known.toPandas()
    if not len(summary):
        return queries.withColumn("shard", F.lit("")).limit(0)
    sent = queries.sparkSession.sparkContext.broadcast((summary["shard"].to_numpy(), np.stack(summary["centre"].to_list()).reshape(len(summary), index.dim).astype(float), summary["radius"].to_numpy(), [None if x is None else set(x) for x in summary["labels"]], index.largest))
    columns = [c for c in queries.columns if c != "dim"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, centres, radius, labels, largest = sent.value
        for b in batches:
            rows, to = [], []
            allowed: dict = {}
            for k, (v, label, same, low, high) in enumerate(zip(b["v"], b["label"], b["same"], b["low"], b["high"], strict=True)):
                low, high = np.asarray(low), np.asarray(high)
                lo, hi = bounds(np.asarray(v, dtype=float), centres, radius, largest)
                if (label, same) not in allowed:
                    allowed[label, same] = np.array([x is None or (label in x if same else x != {label}) for x in labels])
                order = np.argsort(-np.minimum(hi, float(high.max())), kind="stable")
                order = order[allowed[label, same][order]]
                fits = ((hi[order] >= low[:, None]) & (lo[order] <= high[:, None])).any(axis=0)
                # the first ones are chosen without looking at low, which rises between the two calls
                ahead = np.arange(len(order)) < FIRST
                chosen = order[fits & (~ahead if seen else ahead)]
                rows += [k] * len(chosen)
                to += names[chosen].tolist()
            out = b.astype({"label": object}).iloc[rows].reset_index(drop=True)
            out["shard"] = pd.Series(to, dtype=object)
            yield out[[*columns, "shard"]]

    kinds = ", ".join(f"{n} {k}" for n, k in queries.drop("dim").dtypes)
    mine = queries.where(F.col("dim") == F.lit(index.dim)).drop("dim").mapInPandas(run, f"{kinds}, shard string")
    if not seen:
        return mine
    rare = queries.join(index.shards.where(F.col("dim") != F.lit(index.dim)).select("dim", "shard"), "dim")
    return mine.unionByName(rare.select(*columns, "shard"))


FOUND = "query long, window int, node long, id decimal(20,0), score long"


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query, window, node, id, score) of the k best candidates in each window of a query, with place from 1.

    queries: query (a number of its own), v, dim, label, same (candidates of
    the same label, or of others), low, high (arrays: its windows of scores,
    by their number from 0), own (a node that isn't returned).
    """
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "node")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def visit(queries: DataFrame, seen: bool) -> DataFrame:
        routed = stored(routes(index, queries, seen))
        chunks = routed.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).alias("chunks"))
        asked = routed.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "query"), "chunks"))
        trees = index.shards.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

        def run(key: tuple, tree: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(tree) or not len(own):
                return pd.DataFrame({"query": [], "window": [], "node": [], "id": [], "score": []})
            one = tree.iloc[0]
            tree, code = Searcher(Tree.load(one["tree"])), {x: i for i, x in enumerate(one["names"])}
            ids, known = np.frombuffer(one["ids"], dtype=np.int64), np.frombuffer(one["known"], dtype=bool)
            q = np.stack(own["v"].to_list()).reshape(len(own), -1)
            most = max(map(len, own["low"]))
            low, high = (np.array([[*x, *[end] * (most - len(x))] for x in own[c]], dtype=np.int64) for c, end in (("low", LONG), ("high", -LONG)))
            label, same, node = np.array([code.get(x, -2) for x in own["label"]], dtype=np.int64), own["same"].to_numpy(dtype=bool), own["own"].to_numpy()
            exact = tree.exact(q.astype(float))
            out = []
            for at in range(0, len(rows := np.flatnonzero(exact)), TOGETHER):
                some = rows[at : at + TOGETHER]
                n, w, place, score = tree.descend_all(q[some].astype(float), label[some], same[some], low[some], high[some], k, node[some])
                out.append((some[n], w, place, score.astype(np.int64)))
            for i in np.flatnonzero(~exact).tolist():
                windows = tree.descend(q[i], label[i], same[i], low[i], high[i], k, node[i])
                found = np.array([(i, w, place, -score) for w, best in enumerate(windows) for score, _, place in best], dtype=np.int64).reshape(-1, 4)
                out.append(tuple(found.T))
            n, w, place, score = (np.concatenate(x) for x in zip(*out, strict=True))
            named = [Decimal(i) if is_known else None for i, is_known in zip(ids[place].tolist(), known[place].tolist(), strict=True)]
            return pd.DataFrame({"query": own["query"].to_numpy()[n], "window": w.astype(np.int32), "node": tree.t.node[place], "id": pd.Series(named, dtype=object), "score": score})

        return trees.select("shard", "chunk", "tree", "ids", "known", "names").groupBy("shard", "chunk").cogroup(asked.groupBy("shard", "chunk")).applyInPandas(run, FOUND)

    first = stored(visit(queries, False))
    # what a window's k-th best has reached by now is its new lower end
    reached = best(first).where(F.col("place") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    raised = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.col("reached")[w], x)))
    again = stored(queries.join(reached, "query", "left").withColumn("low", F.when(F.col("reached").isNull(), F.col("low")).otherwise(raised)).drop("reached"))
    return best(first.unionByName(visit(again, True)))


def mine(rows: DataFrame, anchors: F.Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: id (long), label, v (array<long>); ``anchors`` says which rows ask.
    An anchor's positives are its best other rows of its label; for each, the
    best rows of other labels with low_percent % to high_percent % of the
    positive's score. Higher scores come first, ties by smaller id (null last).
    Vectors of different lengths don't meet, a repeated row is another row, and
    a pair without any negative has no row. Scores beyond the range of a long
    are its ends. An empty table gives an empty result.
    """
    rows = candidates(rows)
    index = build(rows, max(positives, negatives))
    base = stored(rows.where(anchors).select(F.col("node").alias("query"), F.col("id").alias("anchor_id"), "v", "dim", "label", F.lit(True).alias("same"), F.array(F.lit(-LONG - 1)).alias("low"), F.array(F.lit(LONG)).alias("high"), F.col("node").alias("own")))
    of = stored(search(index, base.drop("anchor_id"), positives).select(F.col("query").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "place"))
    ends = [f"CAST({f}(CAST(positive_score AS DECIMAL(20, 0)) * {p} / 100) AS BIGINT)" for f, p in (("ceil", low_percent), ("floor", high_percent))]
    # an anchor's distinct windows, at most as many as positives, are asked for in one query
    windows = of.select("anchor", "positive_score").distinct().withColumns({"low": F.expr(ends[0]), "high": F.expr(ends[1])}).where("low <= high")
    listed = windows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive_score", "low", "high"))).alias("w"))
    asked = stored(listed.select("anchor", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.col("w.positive_score").alias("scores")).join(base.select(F.col("query").alias("anchor"), "v", "dim", "label", "own"), "anchor").withColumns({"query": F.col("anchor"), "same": F.lit(False)}))
    found = search(index, asked.drop("anchor", "scores"), negatives).select("query", "window", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    whose = asked.select("query", "anchor", F.posexplode("scores").alias("window", "positive_score"))
    pairs = of.join(whose, ["anchor", "positive_score"]).join(found, ["query", "window"])
    named = pairs.join(base.select(F.col("query").alias("anchor"), "anchor_id"), "anchor")
    return named.select("anchor_id", F.col("positive_id").cast("long").alias("positive_id"), "rank", F.col("negative_id").cast("long").alias("negative_id"), "positive_score", "negative_score")


def from_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, embedding, label), anchors being the ids divisible by 100; where 7 divides an id its label is the next one."""
    good = embeddings.where(usable(F.col("label"), F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(good.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), whole(F.col("embedding")).alias("v")), F.col("id") % 100 == 0)


#: Every anchor against every row, for DuckDB.
ORACLE = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len([x for x in embedding if NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 10"""
