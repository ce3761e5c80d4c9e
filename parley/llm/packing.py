"""Best-fit packing of token sequences with a dominance reduction before it.

Lengths are whole numbers up to the capacity, so the whole instance is a
histogram of at most ``capacity`` rows, however many documents there are. The
plan is worked out on that histogram: first sets that dominate every other way
to fill a sequence with its largest item are fixed for good (the reduction of
Martello and Toth), as often as the counts allow; what is left is placed best
fit, longest first. The plan is a bounded table of runs: "pieces of length L
with ranks from a up to b lie in sequences from s on, m in each, from offset o
on". Spark ranks the pieces of a length and looks up their run.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, checkpoint

CAPACITY = 4096
#: Id put behind each document (fixed value).
END_ID = 1
#: Entries of a Python worker's cache that aren't words of SPLIT, and that are; some 90 MB when it is full.
CHUNKS, WORDS = 100_000, 350_000
#: The tokenizer's own split of a chunk (fixed value).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts with any of these go to the tokenizer whole: Python takes the first four for white space,
#: lower-cases the next two by context, and the last begins the names of special tokens.
UNUSUAL = regex.compile("[\x1c-\x1f\u0130\u03a3]|<\\|")


#: What a tokenizer file must say for texts to be encoded word by word (fixed values); with any other they go to it whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and encodes each match of
    SPLIT by itself, so the ids of a text are those of its words in order. A
    chunk between white space that is all letters is one word; letters and one
    other character are two.
    Chunks between white space and words come from bounded caches, new words
    from the tokenizer's model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        settings = json.loads(self.tokenizer.to_str())
        self.known = (settings["normalizer"], settings["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        self.letters = _byte_letters()
        self.others = 0
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            # Visible ASCII characters are their own letters; control characters and all other bytes have others.
            letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode("utf-8")])
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
            if len(self.words) - self.others < WORDS:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.word(chunk)
        if (letters := chunk[:-1]).isalpha():
            found = self.word(letters) + self.word(chunk[-1])
        else:
            found = b"".join([self.word(w) for w in SPLIT.findall(chunk)])
        if self.others < CHUNKS:
            self.others += 1
            self.words[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if not self.known:
            return self.whole(text)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text) or UNUSUAL.search(text):
            return self.whole(text)
        chunks = text.lower().split()
        out = list(map(self.words.get, chunks))
        if None in out:
            for i in [i for i, ids in enumerate(out) if ids is None]:
                out[i] = self.chunk(chunks[i])
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; a worker keeps its cache from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token pieces.

    A document is its ids and then id 1, so null and empty texts have one
    token. Only a document of more than ``capacity`` tokens is cut, into
    pieces of that many; the last may be shorter. Repeated rows are separate
    documents.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = encoder(tokenizer).encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return by_text(docs, run, "piece int, start long, length long, ids_crc32 long", id_col, text_col)


Pattern = tuple[tuple[tuple[int, int], ...], int]


def dominant_set(have: Counter, lengths: list[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """The set that dominates all others holding item ``j``, if the criteria prove one.

    ``lengths`` are the lengths at hand in rising order. Nothing fits beside
    j; or one item fits at most, and the largest that does is best; or one
    item fills the rest exactly; or two fit at most and the best single item
    is no smaller than any two together.
    """
    room = capacity - j
    alone = have[j] - 1
    fits = [x for x in lengths[: bisect.bisect_right(lengths, room)] if x != j or alone > 0]
    if not fits:
        return (j,)
    best = fits[-1]
    if best == room:
        return (j, best)
    # how many of the smallest fit beside j: 1, 2 or more
    small, left, number = iter(fits), room, 0
    for x in small:
        take = min(have[x] - (x == j), left // x)
        number, left = number + take, left - take * x
        if number > 2 or take < have[x] - (x == j):
            break
    if number == 1:
        return (j, best)
    if number == 2:
        pair = 0
        for k, x in enumerate(fits):
            y = bisect.bisect_right(fits, room - x) - 1
            if y > k or y == k and have[x] - (x == j) > 1:
                pair = max(pair, x + fits[y])
        if best >= pair:
            return (j, best)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], int]:
    """Patterns (lengths with their numbers, how many sequences) and the number of sequences fixed by dominance.

    Work depends on the number of distinct lengths, not on the documents.
    """
    have = Counter({int(k): int(v) for k, v in counts.items() if v > 0})
    lengths = sorted(have)
    patterns: list[Pattern] = []
    fixed = 0

    def drop(length: int, n: int) -> None:
        have[length] -= n
        if not have[length]:
            lengths.pop(bisect.bisect_left(lengths, length))

    at = len(lengths) - 1
    while lengths and at >= 0:
        at = min(at, len(lengths) - 1)
        found = dominant_set(have, lengths, lengths[at], capacity)
        if found is None:
            at -= 1
            continue
        top = lengths[at]
        need = Counter(found)
        times = min(have[x] // n for x, n in need.items())
        patterns.append((tuple(sorted(need.items(), reverse=True)), times))
        fixed += times
        for x, n in need.items():
            drop(x, n * times)
        at = bisect.bisect_right(lengths, top) - 1

    # best fit, longest first, on classes of equal bins: room left -> list of (contents, number)
    rooms: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    order: list[int] = []

    def keep(room: int, contents: tuple[tuple[int, int], ...], n: int) -> None:
        if room not in rooms:
            bisect.insort(order, room)
            rooms[room] = []
        rooms[room].append((contents, n))

    for length in reversed(lengths):
        n = have[length]
        while n:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                contents, bins = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                room, contents, bins = capacity, (), -(-n // (capacity // length))
            each = min(room // length, n)
            full = min(bins, n // each)
            keep(room - each * length, (*contents, (length, each)), full)
            if full < bins:
                if contents:
                    keep(room, contents, bins - full)
            n -= each * full
    patterns += [(contents, n) for at in order for contents, n in rooms[at]]
    return patterns, fixed


def runs(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, number in each, offset) of each part of each pattern."""
    rank: Counter = Counter()
    found, sequence = [], 0
    for contents, times in patterns:
        offset = 0
        for length, each in contents:
            found.append((length, rank[length], rank[length] + each * times, sequence, each, offset))
            rank[length] += each * times
            offset += each * length
        sequence += times
    return found


def ranked(pieces: DataFrame, salts: int = 1024) -> DataFrame:
    """``pieces`` with rank (long): 0, 1, ... among the pieces of a length.

    A length that a third of all pieces have is spread over ``salts`` groups;
    group sizes, summed up per length, shift the ranks within groups.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    size = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    size = size.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start"))
    return salted.withColumn("own", own).join(size, ["length", "salt"]).withColumn("rank", F.col("own") - 1 + F.col("before")).drop("salt", "own", "before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id (long) and offset (long).

    Every piece is placed once, sequences have no gaps and none exceeds the
    capacity. The histogram (at most ``capacity`` rows) is the only thing on
    the driver. An empty table gives an empty result; lengths must lie between
    1 and the capacity.
    """
    pieces = checkpoint(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = pieces.sparkSession
    table = runs(plan(counts, capacity)[0])
    each = F.struct(*(F.col(c) for c in ("low", "high", "sequence", "each", "at")))
    by_length = spark.createDataFrame(table or [(0,) * 6], "length long, low long, high long, sequence long, each long, at long").groupBy("length").agg(F.array_sort(F.collect_list(each)).alias("runs"))
    # At most `capacity` rows of short arrays: the size of the plan is bounded by the distinct lengths.
    placed = ranked(pieces).join(F.broadcast(by_length), "length")
    run = F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]
    placed = placed.withColumn("run", run)
    step = F.col("rank") - F.col("run.low")
    return placed.select(*pieces.columns, (F.col("run.sequence") + F.floor(step / F.col("run.each"))).cast("long").alias("sequence_id"), (F.col("run.at") + F.pmod(step, F.col("run.each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token_pieces and pack in one: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(token_pieces(docs, tokenizer, capacity, id_col, text_col), capacity)
