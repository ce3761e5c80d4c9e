"""SentencePiece encoding and decoding as a relational lattice.

Spaces are written as U+2581 and a text is cut into chunks wherever no piece of
the vocabulary can reach across: before a run of spaces, and between characters
of different classes. Classes follow from the vocabulary: characters that stand
next to each other in some piece share one (letters of a script, marks), and a
character that no longer piece holds is alone. So each distinct chunk is encoded
once: its substrings, bounded by the longest piece that begins with the same two
characters, are exploded and equi-joined to the piece table, the edges are
grouped by chunk, and an ordered fold finds the path with the highest sum of
scores (Viterbi). A character without a piece costs the lowest score less 10
and is written as byte pieces. Documents are put together from the lexicon: places
of frequent chunks by a broadcast table of bounded size. Others are listed once
for a run of documents, encoded by a join of these lists, and come back to the
run as packed numbers; its documents follow in order under a number of the row.

A piece whose own characters have a better path without it is on no best path;
the lattice of the pieces themselves finds these, and they are left out of the
joins. Results are the same with and without them.

This is the model's vocabulary read as a unigram lattice, with the scores it
stores; greedy pair merging can choose another path.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, hashed_share, stored, stored_by

SPACE = "▁"
#: Chunks whose encoding is sent to every executor: the most frequent ones up to some length in a sample of documents
#: (bounds). Which ones those are decides by which way a place is settled, not how.
FREQUENT, SHORT, SAMPLED = 300_000, 32, 60_000
#: Chunks that a task counts before it hands its counts on.
COUNTED = 500_000
UNKNOWN_PENALTY = 10.0
#: Chunks of a document that are handled at once; a longer document is cut into such parts.
PART = 8192
#: Parts that are put together at once.
TOGETHER = 100
#: Distinct chunks, besides the frequent ones, of the run of documents that shares a list of them.
LISTED = 100_000
#: Chunks of such a run, unless one document has more.
RUN = 2_000_000
#: Chunks in a partition of the lattice: their edges are grouped in memory, some 20 for each chunk.
CHUNKS_PER_PARTITION = 15_000
GROUPS_IN_MEMORY = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """(piece, id, score, kind): kind is piece or byte. A vocabulary is small by nature (tens of thousands)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            rows.append((sp.id_to_piece(i), i, 0.0, "byte"))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            rows.append((sp.id_to_piece(i), i, float(sp.get_score(i)), "piece"))
    return spark.createDataFrame(rows, "piece string, id int, score double, kind string")


def cut_pattern(pieces: DataFrame) -> str:
    """The regular expression (Python's) of a chunk: spaces, then characters of one class.

    The vocabulary is read on the driver (tens of thousands of pieces, whatever the corpus).
    """
    words = [r.piece for r in pieces.where("kind = 'piece'").select("piece").collect()]
    if any(SPACE in w.lstrip(SPACE) for w in words):
        return "(?s).+"  # pieces go across spaces: a text is one chunk
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for w in (w.lstrip(SPACE) for w in words):
        for a, b in zip(w, w[1:]):
            parent[root(a)] = root(b)
    classes: dict[str, list[int]] = {}
    for c in parent:
        classes.setdefault(root(c), []).append(ord(c))
    ordered = sorted((x for x in classes.values() if len(x) > 1), key=lambda x: (-len(x), min(x)))
    runs = "".join("[" + "".join(rf"\U{n:08x}" for n in sorted(x)) + "]++|" for x in ordered)
    return f"{SPACE}*+(?:{runs}[^{SPACE}])|{SPACE}++"


def chunks(pattern: re.Pattern, text: str | None) -> list[str]:
    """The chunks of a text in order: with a space put before it, spaces as U+2581; null and empty texts have none."""
    return pattern.findall((" " + text).replace(" ", SPACE)) if text else []


def needed_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces that can be on a best path: those that no other path over their own characters beats."""
    own = pieces.where("kind = 'piece'")
    best = encode_chunks(own.select(F.col("piece").alias("chunk")), pieces).select(F.col("chunk").alias("piece"), F.col("score").alias("path"))
    beaten = own.join(best, "piece").where("path > score + 1e-9").select("piece")
    return pieces.join(beaten, "piece", "left_anti")


def encode_chunks(distinct: DataFrame, pieces: DataFrame) -> DataFrame:
    """(chunk, ids, score): the best path of each distinct chunk.

    On equal sums the path whose last piece starts earlier wins at each place.
    """
    grouped, path = lattice(distinct, pieces)
    return grouped.select("chunk", path("chunk", "edges").alias("best")).select("chunk", F.col("best.ids").alias("ids"), F.col("best.score").alias("score"))


def lattice(distinct: DataFrame, pieces: DataFrame):
    """(chunk, edges) for each distinct chunk, dealt as ``distinct`` is if that is by chunk, and the column function ``best_path``."""
    own = pieces.where("kind = 'piece'")
    unknown = (own.agg(F.min("score")).first()[0] or 0.0) - UNKNOWN_PENALTY
    table = F.broadcast(own.select("piece", "id", "score"))
    longest = F.broadcast(own.where(F.length("piece") > 1).groupBy(F.substring("piece", 1, 2).alias("lead")).agg(F.max(F.length("piece")).alias("longest")))
    places = F.explode(F.expr("sequence(1, length(chunk))")).alias("start")
    starts = distinct.select("chunk", F.length("chunk").alias("n"), places).withColumn("lead", F.expr("substring(chunk, start, 2)")).join(longest, "lead", "left")
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.coalesce("longest", F.lit(1)), F.col("n") - F.col("start") + 1))).alias("len")
    spans = starts.select("chunk", "start", lengths).withColumn("piece", F.expr("substring(chunk, start, len)"))
    edges = spans.join(table, "piece", "left").where("id IS NOT NULL OR len = 1")
    # An edge in one long: where it stops, and its id from 1 (0: no piece), by which its length and score are known.
    edge = F.shiftleft((F.col("start") + F.col("len") - 1).cast("long"), 32) + F.coalesce("id", F.lit(-1)) + 1
    return edges.groupBy("chunk").agg(F.collect_list(edge).alias("edges")), best_path(pieces, unknown)


def best_path(pieces: DataFrame, unknown: float):
    """A column function: a chunk and its edges -> ids and score of the best path, by an ordered fold over the places where edges stop.

    All chunks of a batch take a step at once.
    """
    rows = pieces.collect()  # a vocabulary
    size = max((r.id for r in rows), default=-1) + 2
    lengths, scores = np.ones(size, dtype=np.int64), np.full(size, unknown)
    for r in rows:
        if r.kind == "piece":
            lengths[r.id + 1], scores[r.id + 1] = len(r.piece), r.score
    # An unknown character becomes the ids of its UTF-8 bytes, which are consecutive in the vocabulary.
    base = min((r.id for r in rows if r.kind == "byte"), default=-1)
    sent = pieces.sparkSession.sparkContext.broadcast((lengths, scores))

    @F.arrow_udf("ids array<int>, score double")
    def fold(chunk: pa.Array, edges: pa.Array) -> pa.Array:
        lengths, scores = sent.value
        count = pa.compute.list_value_length(edges).to_numpy(zero_copy_only=False)
        code = edges.flatten().to_numpy(zero_copy_only=False)
        row, stop, entry = np.repeat(np.arange(len(count)), count), code >> 32, code & 0xFFFFFFFF
        begin = stop - lengths[entry]
        order = np.lexsort((begin, row, stop))
        row, stop, begin, entry = row[order], stop[order], begin[order], entry[order]
        n = np.zeros(len(count), dtype=np.int64)
        np.maximum.at(n, row, stop)
        at = np.cumsum(n + 1) - (n + 1)  # where a chunk's places begin
        best, chosen = np.zeros(int((n + 1).sum())), np.full(int((n + 1).sum()), -1)
        cuts = np.flatnonzero(np.diff(stop, prepend=-1, append=-1)) if len(stop) else np.zeros(1, dtype=np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            way = best[at[row[a:b]] + begin[a:b]] + scores[entry[a:b]]
            first = np.flatnonzero(np.diff(row[a:b], prepend=-1))
            most = np.maximum.reduceat(way, first)
            # on equal sums the edge that begins earlier
            ties = np.flatnonzero(way == np.repeat(most, np.diff(np.append(first, b - a))))
            ties = ties[np.flatnonzero(np.diff(row[a:b][ties], prepend=-1))]
            place = at[row[a:b][ties]] + stop[a]
            best[place], chosen[place] = most, a + ties
        taken, who, place = [np.empty(0, dtype=np.int64)], np.flatnonzero(n), n[n > 0]
        while len(who):
            edge = chosen[at[who] + place]
            taken.append(edge)
            place = begin[edge]
            who, place = who[place > 0], place[place > 0]
        taken = np.concatenate(taken)
        taken = taken[np.lexsort((stop[taken], row[taken]))]
        ids, own = entry[taken] - 1, np.ones(len(taken), dtype=np.int64)
        if base >= 0:
            unknown = np.flatnonzero(ids < 0).tolist()
            octets = [chunk[int(row[taken[i]])].as_py()[begin[taken[i]]].encode("utf-8") for i in unknown]
            own[unknown] = [len(x) for x in octets]
            ids = np.repeat(ids, own)
            ids[ids < 0] = [base + x for o in octets for x in o]
        ends = np.cumsum(np.bincount(row[taken], weights=own, minlength=len(n)).astype(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(best[at + n])], names=["ids", "score"])

    return fold


def decode_chunks(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """(chunk, decoded): the ids of each chunk joined to the piece table and put together again.

    Byte pieces become their bytes; bytes that aren't UTF-8 become U+FFFD.
    """
    flat = encoded.select("chunk", F.posexplode("ids").alias("pos", "id"))
    table = F.broadcast(pieces.select("id", F.when(F.col("kind") == "byte", F.substring("piece", 4, 2)).otherwise(F.hex(F.encode("piece", "UTF-8"))).alias("code")))
    joined = flat.join(table, "id").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("codes"))
    return joined.select("chunk", F.decode(F.unhex(F.array_join(F.transform("codes", lambda x: x["code"]), "")), "UTF-8").alias("decoded"))


def decoder(pieces: DataFrame):
    """A column function: the ids of a whole document -> its text.

    The table is broadcast. Byte pieces become their bytes, bytes that aren't
    UTF-8 and unknown ids U+FFFD, U+2581 a space; the space put before the text goes.
    """
    rows = pieces.select("id", "piece", "kind").collect()  # a vocabulary
    table = np.full(max((r.id for r in rows), default=0) + 2, "\ufffd".encode(), dtype=object)  # the last is for id -1
    for r in rows:
        table[r.id] = bytes([int(r.piece[3:5], 16)]) if r.kind == "byte" else r.piece.encode("utf-8")
    sent = pieces.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("string")
    def decode_ids(ids: pa.Array) -> pa.Array:
        ends = np.append(0, np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))).tolist()
        table, codes = sent.value, ids.flatten().to_numpy(zero_copy_only=False)
        return pa.array([b"".join(table[codes[a:b]]).decode("utf-8", "replace").replace(SPACE, " ")[1:] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())

    return decode_ids


def decode(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, text) for every row of encoded documents (doc_id, ids)."""
    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", decoder(pieces)(F.col("ids")).alias("text"))


#: The columns of a document's numbers of frequent chunks, a byte of each number in one: the stored table packs like with like.
PLANES = ["codes0", "codes1", "codes2", "codes3"]


def planes(codes: np.ndarray) -> list[bytes]:
    """Numbers of chunks from -1, byte plane by byte plane: frequent chunks have small numbers, so that most high bytes are 0."""
    return [x.tobytes() for x in (codes + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T]


def of_planes(found: list[list[bytes]]) -> np.ndarray:
    """The numbers of several ``planes``, one after the other; given is a list for each of PLANES."""
    return np.stack([np.frombuffer(b"".join(x), dtype=np.uint8) for x in found], axis=1).view("<u4").ravel().astype(np.int64) - 1


def packed(codes: np.ndarray) -> bytes:
    """``planes`` as one value, compressed."""
    whole = b"".join(planes(codes))
    return len(codes).to_bytes(4, "little") + (pa.compress(whole, codec="zstd", asbytes=True) if whole else b"")


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    found = np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd") if n else b"", dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(found.T).view("<u4").ravel().astype(np.int64) - 1


def frequent_chunks(rows: DataFrame, pattern: str) -> DataFrame:
    """(chunk, n): the FREQUENT most frequent ones of up to SHORT characters in a sample of about SAMPLED rows (text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, seen = re.compile(pattern), Counter()
        rows = lambda: pd.DataFrame([x for x in seen.items() if x[1] > 1 and len(x[0]) <= SHORT], columns=["chunk", "n"])
        for b in batches:
            for text in b["text"]:
                seen.update(chunks(cut, text))
                if len(seen) > COUNTED:
                    yield rows()
                    seen.clear()
        yield rows()

    share = min(1.0, SAMPLED / max(1, rows.count()))
    counted = rows.where(hashed_share(F.col("text"), share, 11)).select("text").mapInPandas(count, "chunk string, n long")
    return counted.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(FREQUENT)


def lexicon(distinct: DataFrame, pieces: DataFrame) -> DataFrame:
    """encode_chunks in small partitions, so that grouping needs neither a sort nor a spill; the setting holds for this step alone."""
    spark = distinct.sparkSession
    distinct = stored(distinct)
    parts, before = distinct.count() // CHUNKS_PER_PARTITION + 1, spark.conf.get(GROUPS_IN_MEMORY)
    spark.conf.set(GROUPS_IN_MEMORY, str(4 * CHUNKS_PER_PARTITION))
    try:
        return stored(encode_chunks(distinct.repartition(parts, "chunk"), pieces))
    finally:
        spark.conf.set(GROUPS_IN_MEMORY, before)


def by_group(placed: DataFrame, n: int, pieces: DataFrame) -> DataFrame:
    """(group, places, sizes, ids) of ``placed`` (group, place, chunk; n rows): packed numbers of a group's chunks from one partition of the lattice.

    Chunks are dealt once, with their places, which join the edges before the path is found: rows that come from Python
    count as dealt by nothing, so a later join would shuffle them. What goes back to the groups is a few bytes a chunk,
    places as the steps between them.
    """
    spark, parts = placed.sparkSession, n // CHUNKS_PER_PARTITION + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def packed_rows() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).combine_chunks().sort_by([("group", "ascending"), ("place", "ascending")])
            group, place = t["group"].to_numpy(), t["place"].to_numpy().astype(np.int64)
            lists = t["ids"].combine_chunks()
            ends = np.cumsum(np.append(0, pa.compute.list_value_length(lists).to_numpy()))
            ids = lists.flatten().to_numpy().astype(np.int64)
            cuts = np.append(np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1), len(group))
            runs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            rows = [(packed(np.diff(place[a:b], prepend=0)), packed(np.diff(ends[a : b + 1])), packed(ids[ends[a] : ends[b]])) for a, b in runs]
            return pa.RecordBatch.from_arrays([pa.array(group[cuts[:-1]]), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], names=["group", "places", "sizes", "ids"])

        for b in batches:
            if b.num_rows:
                waiting.append(b)
            if sum(x.num_rows for x in waiting) > COUNTED:
                yield packed_rows()
                waiting.clear()
        if waiting:
            yield packed_rows()

    dealt = placed.where("chunk IS NOT NULL").repartition(parts, "chunk")
    # the condition holds for all; it keeps the columns, so that both sides read the same shuffle
    distinct = dealt.groupBy("chunk").agg(F.min("group").alias("_g"), F.min("place").alias("_p")).where("_g >= 0 AND _p >= 0").select("chunk")
    at = dealt.groupBy("chunk").agg(F.collect_list(F.struct("group", "place")).alias("at"))
    grouped, path = lattice(distinct, pieces)
    found = grouped.join(at.hint("shuffle_hash"), "chunk").select("at", path("chunk", "edges").alias("best"))
    found = found.select(F.explode("at").alias("at"), F.col("best.ids").alias("ids")).select("at.group", "at.place", "ids")
    before = spark.conf.get(GROUPS_IN_MEMORY)
    spark.conf.set(GROUPS_IN_MEMORY, str(4 * CHUNKS_PER_PARTITION))
    try:
        return stored(found.mapInArrow(pack, "group long, places binary, sizes binary, ids binary"))
    finally:
        spark.conf.set(GROUPS_IN_MEMORY, before)


def encode(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, lexicon) for whole texts; ids of any type.

    lexicon has chunk, ids, score: each chunk once. documents has a row for
    each row of ``docs``, also for equal ones: doc_id, n_chunks, n_pieces,
    score (sum over its pieces), ids (all pieces in order), ids_crc32 (of the
    ids as little-endian 32-bit numbers) and source, xxhash64 of the text.
    Null and empty texts have no chunks. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pattern, needed = cut_pattern(pieces), stored(needed_pieces(pieces))
    counted = stored(frequent_chunks(rows, pattern))
    common = lexicon(counted.select("chunk"), needed)
    often = common.join(counted, "chunk").orderBy(F.desc("n"), "chunk").select("chunk", "ids").toPandas()  # at most FREQUENT rows of at most SHORT characters
    number = spark.sparkContext.broadcast({c: i for i, c in enumerate(often["chunk"])})
    sizes = np.array([*map(len, often["ids"]), 0], dtype=np.int64)  # the last is for places of other chunks
    flat = np.concatenate([np.empty(0, dtype=np.int32), *often["ids"]]).astype(np.int32)
    known = spark.sparkContext.broadcast((flat, np.cumsum(sizes) - sizes, sizes, _costs(pieces)))
    del often
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each part of a document: the numbers of its frequent chunks, -1 for others, and those others by their place in their group's list.

        A group is a run of documents; its list of distinct other chunks follows in rows of its own (row is -1), PART chunks in each.
        """
        of, split = number.value.get, re.compile(pattern)
        columns = ["group", "row", "part", "doc_id", "source", *PLANES, "others", "chunks"]
        group, listed, n = None, {}, 0

        def lists() -> list[tuple]:
            names = list(listed)
            return [(group, -1, part, None, None, *[None] * len(PLANES), None, names[at : at + PART]) for part, at in enumerate(range(0, len(names), PART))]

        for b in batches:
            found = []
            for row, doc_id, source, text in zip(b["row"], b["doc_id"], b["source"], b["text"], strict=True):
                if group is None:
                    group = row
                words = chunks(split, text)
                n += len(words)
                for part, at in enumerate(range(0, max(1, len(words)), PART)):
                    some = words[at : at + PART]
                    codes = np.fromiter(map(of, some, repeat(-1)), dtype=np.int64, count=len(some))
                    others = np.array([listed.setdefault(some[i], len(listed)) for i in np.flatnonzero(codes < 0).tolist()], dtype=np.int64)
                    found.append((group, row, part, doc_id, source, *planes(codes), packed(others), None))
                if len(listed) >= LISTED or n >= RUN:
                    found += lists()
                    group, listed, n = None, {}, 0
            yield pd.DataFrame(found, columns=columns)
        if listed:
            yield pd.DataFrame(lists(), columns=columns)

    # Rows are numbered once; the table keeps the numbers. Longs beside nulls would become doubles in pandas, so some travel as text.
    whole = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string").alias("source"), "text")
    whole = stored_by(whole.mapInPandas(cut, f"group long, row long, part int, doc_id string, source string, {', '.join(f'{c} binary' for c in PLANES)}, others binary, chunks array<string>"), "group")
    lists = whole.where("row < 0").select("group", (F.col("part") * PART).alias("base"), "chunks")
    placed = lists.select("group", "base", F.posexplode("chunks").alias("at", "chunk")).select("group", (F.col("base") + F.col("at")).alias("place"), "chunk")
    best = by_group(placed, int(lists.agg(F.sum(F.size("chunks"))).first()[0] or 0), needed)

    def put_together(docs: pa.Table, lists: pa.Table) -> pa.Table:
        """The documents of a group, from their numbers and what the group's list encodes to."""
        flat, starts, sizes, costs = known.value
        places, lengths, ids = ([*map(unpacked, lists[c].to_pylist())] for c in ("places", "sizes", "ids"))
        places, lengths, ids = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (map(np.cumsum, places), lengths, ids))
        begin, count = np.zeros(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        begin[places], count[places] = np.cumsum(lengths) - lengths, lengths
        both = np.concatenate((flat, ids.astype(np.int32)))

        def of_codes(codes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The ids of places, and how many each has."""
            rare = codes < 0
            assert rare.sum() == len(others), "a chunk is missing in the lexicon"
            first, own = starts[codes], sizes[codes]  # -1 takes the last
            first[rare], own[rare] = begin[others] + len(flat), count[others]
            return both[np.arange(own.sum()) + np.repeat(first - (np.cumsum(own) - own), own)], own

        docs = docs.sort_by([("row", "ascending"), ("part", "ascending")])
        arrays, chunks_of, ids_of = [np.empty(0, dtype=np.int32)], [], []
        for at in range(0, len(docs), TOGETHER):
            some = docs.slice(at, TOGETHER)
            n = pa.compute.binary_length(some[PLANES[0]]).to_numpy()
            codes = of_planes([some[c].to_pylist() for c in PLANES])
            found, own = of_codes(codes, np.concatenate([unpacked(x) for x in some["others"].to_pylist()]))
            arrays.append(found)
            chunks_of.append(n)
            ids_of.append(np.diff(np.append(0, np.cumsum(own))[np.append(0, np.cumsum(n))]))
        found, row = np.concatenate(arrays), docs["row"].to_numpy()
        first = np.flatnonzero(np.diff(row, prepend=-1))  # the first part of each document
        n_chunks, n_pieces = (np.add.reduceat(np.concatenate(x), first).astype(np.int64) if len(first) else np.empty(0, dtype=np.int64) for x in (chunks_of, ids_of))
        ends = np.append(0, np.cumsum(n_pieces))
        each = [found[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        crcs = [zlib.crc32(x.astype("<i4", copy=False).tobytes()) for x in each]
        head = docs.select(["doc_id", "source"]).take(pa.array(first))
        columns = [head["doc_id"], pa.array(n_chunks), pa.array(n_pieces), pa.array([float(costs[x].sum()) for x in each], pa.float64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found)), pa.array(crcs, pa.int64()), head["source"]]
        return pa.table(columns, names=["doc_id", "n_chunks", "n_pieces", "score", "ids", "ids_crc32", "source"])

    parts_of = whole.where("row >= 0").select("group", "row", "part", "doc_id", "source", *PLANES, "others")
    found = parts_of.groupBy("group").cogroup(best.groupBy("group")).applyInArrow(put_together, "doc_id string, n_chunks long, n_pieces long, score double, ids array<int>, ids_crc32 long, source string")
    rare = encode_chunks(placed.select("chunk").distinct(), needed)
    return found.withColumns({"doc_id": F.col("doc_id").cast(kind), "source": F.col("source").cast("long")}), common.unionByName(rare)


def _costs(pieces: DataFrame) -> np.ndarray:
    """The score that each id adds to a path. An unknown character's penalty is at the first of its bytes, or at id -1 (the last)."""
    rows = pieces.select("id", "piece", "score", "kind").collect()  # a vocabulary
    unknown = min((r.score for r in rows if r.kind == "piece"), default=0.0) - UNKNOWN_PENALTY
    costs = np.zeros(max((r.id for r in rows), default=0) + 2)
    costs[-1] = unknown
    for r in rows:
        leads = r.kind == "byte" and int(r.piece[3:5], 16) & 0xC0 != 0x80
        costs[r.id] = unknown if leads else r.score if r.kind == "piece" else 0.0
    return costs
