"""Near-duplicate documents by SimHash fingerprints and Golay-code keys.

A fingerprint bit is 1 if it is set in over half of the hashes of the
document's word shingles. Fingerprints within a few bits are found without
comparing all pairs: part of the bits must agree exactly, another part is
decoded to nearby Golay words, and both together are the key of an equi-join
whose condition verifies the distance.

For 64 bits and a distance of 3 the search is exact. The four 16-bit segments
share at most 3 errors. Family f asks that segment f has none and segment f+1
(cyclic) at most one. If no family held, no error-free segment would be
followed by one with at most one error; with one error-free segment the other
three have one error each, and with two or three error-free ones at most one
segment has two or more, so some error-free segment is not followed by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import golay
from .common import by_text, connected_components, free_name, hashed_share, stored

#: Seed of the shingle hash (fixed value).
SEED = 42
#: Shingles whose bits are added up at once; bounds memory for very long texts.
CHUNK = 1 << 15


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """Another 64-bit hash from a 64-bit hash: the splitmix64 finaliser (fixed constants)."""
    h = h + np.uint64((i * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, words: int, longs: int, sketch: int = 0) -> tuple[list[int], np.ndarray]:
    """Signed 64-bit words of the fingerprint, and the ``sketch`` smallest shingle hashes.

    All zero, and no hashes, for a text without words.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    least = np.empty(0, dtype=np.int64)
    if not w:
        return [0] * longs, least
    n = max(1, len(w) - words + 1)
    counts = np.zeros((longs, 64), dtype=np.int64)
    for at in range(0, n, CHUNK):
        some = range(at, min(n, at + CHUNK))
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in some), dtype=np.uint64, count=len(some))
        for i in range(longs):
            bits = np.unpackbits((_mixed(h, i) if i else h).astype(">u8").view(np.uint8)).reshape(-1, 64)
            counts[i] += bits.sum(axis=0, dtype=np.int64)
        if sketch:
            least = np.unique(np.concatenate([least, h.view(np.int64)]))[:sketch]
    return np.packbits(2 * counts > n, axis=1).view(">i8").ravel().tolist(), least


def fingerprints(docs: DataFrame, words: int = 3, longs: int = 1, sketch: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, f1, ..., sketch): a fingerprint of 64 bits in each of ``longs`` columns.

    sketch, if asked for, is the sorted array of that many smallest hashes.

    Whole texts; A-Z is lower-cased, words are split at ASCII white space. A
    text of fewer words than a shingle is one shingle; null, empty or blank
    texts get zero. Repeated rows give repeated rows.
    """
    names = [f"f{i}" for i in range(longs)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [fingerprint(t, words, longs, sketch) for t in b["text"]]
            rows = np.array([f for f, _ in found], dtype=np.int64).reshape(-1, longs)
            yield pd.DataFrame({"doc_id": b["doc_id"], **{n: rows[:, i] for i, n in enumerate(names)}, **({"sketch": [x for _, x in found]} if sketch else {})})

    return by_text(docs, run, ", ".join(f"{n} long" for n in names) + (", sketch array<long>" if sketch else ""), id_col, text_col)


def exact_families() -> list[tuple[list[int], list[int]]]:
    """Bit places (0 is the highest) of the four families for 64 bits and distance 3."""
    segment = [list(range(16 * s, 16 * s + 16)) for s in range(4)]
    return [(segment[f], segment[(f + 1) % 4]) for f in range(4)]


def wide_families(bits: int = 256, exact: int = 8, count: int = 32) -> list[tuple[list[int], list[int]]]:
    """Families for a wide fingerprint: ``exact`` bits and a full 23-bit Golay string each, over seeded shuffles of the places."""
    rng, found, own = np.random.default_rng(7), [], exact + golay.LENGTH
    while len(found) < count:
        order = rng.permutation(bits).tolist()
        found += [(order[i : i + exact], order[i + exact : i + own]) for i in range(0, bits - own + 1, own)]
    return found[:count]


def with_keys(prints: DataFrame, families: list[tuple[list[int], list[int]]]) -> DataFrame:
    """(node, f0, key): a row for each key (long) of each fingerprint (node long, f0, ...), with its first 64 bits for verification."""
    names = [c for c in prints.columns if c[0] == "f" and c[1:].isdigit()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = np.unpackbits(np.ascontiguousarray(b[names].to_numpy(dtype=np.int64), dtype=">i8").view(np.uint8), axis=1) if len(b) else np.zeros((0, 64 * len(names)), np.uint8)
            number = lambda places: bits[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))
            for f, (same, fuzzy) in enumerate(families):
                near = golay.keys(number(fuzzy))
                key = (f << 40) | (number(same) << golay.MESSAGE)
                row, at = np.nonzero(near >= 0)
                yield pd.DataFrame({"node": b["node"].to_numpy()[row], "f0": b["f0"].to_numpy()[row], "key": key[row] | near[row, at]})

    return prints.select("node", *names).mapInPandas(run, "node long, f0 long, key long")


#: Hint for the side of a join that Spark takes for far smaller than it is, as rows of a Python step (a hundred keys
#: a fingerprint) or of packed files: it is shuffled, never broadcast through the driver.
SHUFFLED = "merge"

#: Bits in which two joined fingerprints differ among their first 64.
DIFFERING = "bit_count(a.f0 ^ b.f0)"


def near_fingerprints(prints: DataFrame, families=None, distance: int = 3, crowded: DataFrame | None = None) -> DataFrame:
    """(src, dst): nodes with a common key whose first 64 bits differ in at most ``distance``.

    ``prints`` (node long, f0, ...) holds each fingerprint once. With 64 bits
    and the default families all pairs at distance 3 or less are found. Pairs
    of two ``crowded`` nodes (node), if given, are left out.
    """
    families = families or exact_families()
    few = prints if crowded is None else prints.join(crowded, "node", "left_anti")
    # The conditions that Spark would add to one join only, so that it sees the same rows in both and shuffles them once.
    keyed = with_keys(few, families).where("node IS NOT NULL AND f0 IS NOT NULL AND key IS NOT NULL")
    a, b = keyed.alias("a"), keyed.hint(SHUFFLED).alias("b")
    close = (F.col("a.key") == F.col("b.key")) & F.expr(f"{DIFFERING} <= {distance}")
    found = a.join(b, close & (F.col("a.node") < F.col("b.node"))).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    if crowded is None:
        return found
    c = with_keys(prints.join(crowded, "node", "left_semi"), families).hint(SHUFFLED).alias("b")
    return found.unionByName(a.join(c, close).select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")))


#: Share of the nodes in which crowded keys are looked for, and the rows there from which a key is one.
SAMPLE, CROWD = 1 / 4, 16


def crowded_nodes(prints: DataFrame, families) -> DataFrame | None:
    """(node): nodes under a key that many nodes have, or None.

    Which keys those are is estimated on a sample. It decides by which way
    links are found, not which.
    """
    sample = with_keys(prints.where(hashed_share(F.col("node"), SAMPLE, 3)), families)
    hot = stored(sample.groupBy("key").count().where(F.col("count") >= CROWD).select("key"))
    if hot.isEmpty():
        return None
    return stored(with_keys(prints, families).join(hot, "key", "left_semi").select("node").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint hex, component_id) by 3-word shingles, 64 bits and distance 3.

    Documents of one fingerprint are one node, so exact copies never make
    pairs. component_id is the smallest doc_id reachable over links, ids of
    any type. Documents without words have fingerprint zero and link like any
    other. Rows with a null id get the component of their fingerprint; it is
    null if nothing linked has an id. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, 3, 1, 0, id_col, text_col))
    nodes = stored(prints.groupBy("f0").agg(F.min("doc_id").alias("low")).withColumn("node", F.col("f0")))
    component = connected_components(near_fingerprints(nodes.select("node", "f0")))
    named = nodes.join(component, "node", "left").select("f0", "low", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    best = named.join(lowest, "component").select("f0", "component_id")
    return prints.join(best, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


#: Bits of the first 64 in which documents at a similarity of 0.8 differ: 10 on average, 19 three deviations above.
#: Unrelated documents are as close once in a thousand; sketches decide.
WIDE_DISTANCE = 19
#: Shingle hashes kept of each document. Documents of fewer shingles are compared by them exactly.
SKETCH = 128
#: Estimates below this are clear misses: over four standard errors (0.035) under the limit of 0.8.
CLEAR_MISS = 0.65


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of all word shingles of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(w) - words + 1) if w else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(n)), dtype=np.uint64, count=n))


def plausible(links: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(src, dst, sure): the links without those that the sketches (node, sketch) rule out.

    Where both sketches hold all shingles the similarity is exact and the link
    is sure; else only clear misses are left out.
    """
    a = sketches.select(F.col("node").alias("src"), F.col("sketch").alias("a"))
    b = sketches.select(F.col("node").alias("dst"), F.col("sketch").alias("b"))
    sure = (F.size("a") < SKETCH) & (F.size("b") < SKETCH)
    low = F.slice(F.array_sort(F.array_union("a", "b")), 1, F.when(sure, 2 * SKETCH).otherwise(SKETCH))
    share = F.size(F.array_intersect(F.array_intersect(low, "a"), F.col("b"))) / F.greatest(F.size(low), F.lit(1))
    return links.join(a.hint(SHUFFLED), "src").join(b.hint(SHUFFLED), "dst").where(share >= F.when(sure, similarity).otherwise(CLEAR_MISS)).select("src", "dst", sure.alias("sure"))


def alike(links: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links whose whole shingle sets have a Jaccard similarity of ``similarity`` or more; texts has (node, text)."""
    a, b = (texts.select(F.col("node").alias(end), F.col("text").alias(name)).hint(SHUFFLED) for end, name in (("src", "a"), ("dst", "b")))
    pairs = links.join(a, "src").join(b, "dst")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[int, np.ndarray] = {}  # a node with many links comes many times in a row

        def of(node: int, text: str) -> np.ndarray:
            if node not in last:
                if len(last) == 8:
                    del last[next(iter(last))]
                last[node] = shingles(text, words)
            return last[node]

        for batch in batches:
            kept = []
            for src, dst, a, b in zip(batch["src"], batch["dst"], batch["a"], batch["b"], strict=True):
                x, y = of(src, a), of(dst, b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.loc[kept, ["src", "dst"]]

    return pairs.select("src", "dst", "a", "b").mapInPandas(run, "src long, dst long")


def verified(links: DataFrame, ids: DataFrame, prints: DataFrame, docs: DataFrame, words: int, similarity: float = 0.8) -> DataFrame:
    """(src, dst): the links of an exact Jaccard similarity of ``similarity`` or more; sketches only rule out.

    ``ids`` (node, doc_id) leads to the sketches in ``prints`` (doc_id,
    sketch) and the texts in ``docs`` (doc_id, text), of linked nodes alone.
    """
    ends = lambda x: stored(x.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(ids, "node"))
    left = stored(plausible(links, stored(prints.join(ends(links), "doc_id").select("node", "sketch")), similarity))
    unsure = left.where("NOT sure").select("src", "dst")
    texts = stored(docs.join(ends(unsure), "doc_id").select("node", "text"))
    return stored(left.where("sure").select("src", "dst").unionByName(alike(unsure, texts, words, similarity)))


def one_row_per_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, but of those that share an id the first by the text's hash, the text, and the other columns (maps and variants aside). Rows with a null id all stay."""
    repeated = stored(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    if not repeated.limit(1).count():
        return docs
    others = [c for c, kind in docs.dtypes if c not in (id_col, text_col) and not kind.startswith(("map", "variant"))]
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col, *others)
    row = free_name(docs, "row")
    first = docs.join(repeated, id_col, "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).select(*docs.columns)
    return docs.join(repeated, id_col, "left_anti").select(*docs.columns).unionByName(first)


#: Bits of the table that says how common shingles are (bound of what is broadcast).
COMMON = 18


def rarest_shingles(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(token, node, place, size): of each text the rarest shingles that any text alike must share one of, from place 1 on.

    Shingles are ordered by how many shingles of the texts have the same first
    COMMON bits of their hash, then by the hash: any order would do, this one
    has the rare ones first. Sets of sizes a and b alike at j share at least
    j / (1 + j) (a + b) shingles, so the first shared one in that order lies
    within the first a - ceil(j a) + 1 of each.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << COMMON, dtype=np.int64)
        for b in batches:
            for text in b["text"]:
                seen += np.bincount((shingles(text, words) >> np.uint64(64 - COMMON)).astype(np.int64), minlength=1 << COMMON)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bits": at, "n": seen[at]})

    counted = texts.select("text").mapInPandas(count, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n")).toArrow()  # at most 2^COMMON rows
    often = np.zeros(1 << COMMON, dtype=np.int64)
    often[counted["bits"].to_numpy()] = counted["n"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for node, text in zip(b["node"], b["text"], strict=True):
                own = shingles(text, words)
                few = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
                order = np.lexsort((own, sent.value[(own >> np.uint64(64 - COMMON)).astype(np.int64)]))[:few]
                yield pd.DataFrame({"token": own[order].view(np.int64), "node": node, "place": np.arange(1, len(order) + 1), "size": len(own)})

    return stored(texts.select("node", "text").mapInPandas(run, "token long, node long, place long, size long"))


def crowd_links(texts: DataFrame, verify, words: int, similarity: float) -> DataFrame:
    """(src, dst): links that connect whatever is alike among ``texts`` (node, text), of which many are near copies.

    All pairs of a large group are too many, so each text is first linked to
    one other under each of its rarest shingles: to the one with the fewest
    rarer ones, which is the original of edited copies. What that connects is
    not compared again. All pairs of different components with a common
    shingle that can still be alike by the places of that shingle come last,
    so nothing is lost. ``verify`` keeps the links that hold.
    """
    rare = rarest_shingles(texts, words, similarity)
    shared = rare.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    rare = stored(rare.join(shared.hint(SHUFFLED), "token"))
    left = lambda t: f"({t}size - {t}place + 1) * {1 + similarity} + 1e-6"
    need = lambda a, b: f"{similarity} * ({a} + {b})"
    can = (F.col("a.token") == F.col("b.token")) & F.expr(f"{left('a.')} >= {need('a.size', 'b.size')} AND {left('b.')} >= {need('a.size', 'b.size')}")
    src, dst = F.greatest("a.node", "b.node").alias("src"), F.least("a.node", "b.node").alias("dst")
    a = rare.alias("a")
    first = rare.groupBy("token").agg(F.min_by(F.struct("node", "place", "size"), F.struct("place", "node")).alias("p")).select("token", "p.*").hint(SHUFFLED).alias("b")
    stars = verify(stored(a.join(first, can & (F.col("a.node") != F.col("b.node"))).select(src, dst).distinct()))
    known = stored(texts.select("node").join(connected_components(stars), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    alive = stored(rare.join(known, "node"))
    for _ in range(2):  # rows that can't be alike to anything in another component under their shingle
        group = alive.groupBy("token").agg(F.min("size").alias("least"), F.min("component").alias("low"), F.max("component").alias("high"))
        alive = alive.join(group.hint(SHUFFLED), "token").where(f"low < high AND {left('')} >= {need('size', 'least')}").select(*rare.columns, "component")
        alive = stored(alive)
    a, b = alive.alias("a"), alive.hint(SHUFFLED).alias("b")
    pairs = a.join(b, can & F.expr("a.node < b.node AND a.component <> b.component")).select(src, dst).distinct()
    return stars.unionByName(verify(stored(pairs)))


def similar_groups(docs: DataFrame, words: int = 5, longs: int = 4, distance: int = WIDE_DISTANCE, count: int = 32, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for documents alike at a Jaccard similarity of 0.8 or more; ids of any type.

    256-bit fingerprints of 5-word shingles meet under Golay keys, and every
    link is verified on the whole shingle sets. Among documents under crowded
    keys, of which most pairs would have to be written out, the keys are
    lengthened by rare shingles (crowd_links), which is exact. Documents of
    the same fingerprint and sketch are one node. Null, empty or blank texts
    have fingerprint zero and form one group. Repeated ids are one document
    (one_row_per_id); rows with a null id have no component unless they are a
    copy of another.
    """
    docs = one_row_per_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    names = [f"f{i}" for i in range(longs)]
    families = wide_families(64 * longs, count=count)
    prints = stored(fingerprints(docs, words, longs, SKETCH).withColumn("own", F.xxhash64("sketch")))
    lowest = prints.groupBy("own", *names).agg(F.min("doc_id").alias("low")).where("low IS NOT NULL")
    nodes = stored(lowest.withColumn("node", F.monotonically_increasing_id()))
    ids = stored(nodes.select(F.col("low").alias("doc_id"), "node"))
    verify = lambda found: verified(found, ids, prints, docs, words, similarity)
    crowded = crowded_nodes(nodes, families)
    links = verify(stored(near_fingerprints(nodes, families, distance, crowded).distinct()))
    if crowded is not None:
        texts = stored(docs.join(ids.join(crowded, "node"), "doc_id").select("node", "text"))
        links = links.unionByName(crowd_links(texts, verify, words, similarity))
    named = nodes.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = named.join(named.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("own", *names, "component_id")
    return prints.select("doc_id", "own", *names).join(best, ["own", *names], "left").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
