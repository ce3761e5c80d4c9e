"""Documents as pieces: whole id sequences in order, a row each, and back."""

import re
import zlib
from collections import Counter

import numpy as np

from parley.llm import pieces, queries


def test_documents_round_trip(spark, monkeypatch):
    monkeypatch.setattr(pieces, "FREQUENT", 20)
    monkeypatch.setattr(pieces, "PART", 7)
    table = pieces.piece_table(spark, queries.tokenizer_path("piece_bpe_32k.model"))
    big = 2**60 + 1
    rows = [(1, None), (2, ""), (3, "   \n"), (big, "the cat sat, the cat ran"), (big, "the cat sat, the cat ran"), (big, "ran cat the"), (None, "no id"), (5, "ein langes Wort und mehr " * 40), (6, "\U0001f600 日本語 é\t<x> it's")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found, lexicon = pieces.encode(docs, table)
    got, ids = found.collect(), {x.chunk: x.ids for x in lexicon.collect()}
    pattern = re.compile(pieces.cut_pattern(table))
    cut = {t: pieces.chunks(pattern, t) for _, t in rows}
    want = Counter((i, tuple(p for c in cut[t] for p in ids[c]), len(cut[t])) for i, t in rows)
    assert Counter((x.doc_id, tuple(x.ids), x.n_chunks) for x in got) == want
    best = {x.chunk: x.score for x in lexicon.collect()}
    assert sorted(round(x.score, 6) for x in got) == sorted(round(sum(best[c] for c in cut[t]), 6) for _, t in rows)
    assert all(x.n_pieces == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<i4").tobytes()) for x in got)
    assert Counter((x.doc_id, x.text) for x in pieces.decode(found, table).collect()) == Counter((i, t or "") for i, t in rows)


def test_query_decodes_every_document(spark):
    sf = "/root/testdata/sf0.001"
    r = queries.op10_sentencepiece(spark, sf)
    assert r.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and r.where("NOT decodes OR n_pieces <> size(ids)").count() == 0


def test_documents_against_plain_dynamic_programming(spark):
    """Every document of the smallest table: the best path over each of its chunks, by brute force over all substrings."""
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    known = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    byte = next(i for i in range(sp.get_piece_size()) if sp.is_byte(i))
    lowest, longest = min(s for _, s in known.values()) - 10, max(map(len, known))

    def best(chunk):
        ways = [(0.0, None, None)]
        for stop in range(1, len(chunk) + 1):
            way = None
            for a in range(max(0, stop - longest), stop):
                piece = chunk[a:stop]
                if piece in known or stop - a == 1:
                    i, score = known.get(piece, (None, lowest))
                    if way is None or ways[a][0] + score > way[0]:
                        way = (ways[a][0] + score, a, [i] if i is not None else [byte + x for x in piece.encode()])
            ways.append(way)
        out, at = [], len(chunk)
        while at:
            out[:0] = ways[at][2]
            at = ways[at][1]
        return out

    table = pieces.piece_table(spark, path)
    pattern, cache = re.compile(pieces.cut_pattern(table)), {}
    texts = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {x.doc_id: x.ids for x in queries.op10_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = []
        for c in pieces.chunks(pattern, text):
            if c not in cache:
                cache[c] = best(c)
            want += cache[c]
        assert list(got[i]) == want


def test_chunks_of_a_run_are_listed_once(spark, monkeypatch):
    """A rare chunk goes through the join once a run of documents, not once a place, whatever the length of its list."""
    monkeypatch.setattr(pieces, "FREQUENT", 3)
    monkeypatch.setattr(pieces, "PART", 5)
    monkeypatch.setattr(pieces, "LISTED", 40)
    monkeypatch.setattr(pieces, "CHUNKS_PER_PARTITION", 9)
    monkeypatch.setattr(pieces, "COUNTED", 4)
    table, joined, plain = pieces.piece_table(spark, queries.tokenizer_path("piece_bpe_32k.model")), [], pieces.by_group
    monkeypatch.setattr(pieces, "by_group", lambda placed, n, own: (joined.append((placed.count(), n, placed.dropDuplicates(["group", "chunk"]).count())), plain(placed, n, own))[1])
    texts = [" ".join(f"w{(7 * i + k) % 60}x" for k in range(i % 30)) for i in range(120)]
    found, lexicon = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2), table)
    assert {x.doc_id: x.text for x in pieces.decode(found, table).collect()} == dict(enumerate(texts))
    ids, pattern = {x.chunk: x.ids for x in lexicon.collect()}, re.compile(pieces.cut_pattern(table))
    assert {x.doc_id: x.ids for x in found.collect()} == {i: [p for c in pieces.chunks(pattern, t) for p in ids[c]] for i, t in enumerate(texts)}
    places = sum(len(pieces.chunks(pattern, t)) for t in texts)
    assert len(joined) == 1 and joined[0][0] == joined[0][1] == joined[0][2] < places / 2


def test_places_are_dealt_by_chunk_once(spark, monkeypatch):
    """What comes from Python isn't shuffled to find its places, and these come back in order with the pieces of their chunks."""
    table, seen, plain = pieces.piece_table(spark, queries.tokenizer_path("piece_bpe_32k.model")), [], pieces.stored
    words = ["▁ab", "▁abc", "▁b", "▁ab"]
    placed = spark.createDataFrame([(i // 2, 300 * i, w) for i, w in enumerate(words)], "group long, place long, chunk string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(pieces, "CHUNKS_PER_PARTITION", 1)
    monkeypatch.setattr(pieces, "stored", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), plain(df))[1])
    try:
        found = pieces.by_group(placed, len(words), table).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [x for x in seen[0].splitlines() if "Exchange hashpartitioning(chunk" in x]
    assert shuffles and all("REPARTITION_BY_NUM" in x for x in shuffles)
    best = {x.chunk: x.ids for x in pieces.encode_chunks(placed.select("chunk").distinct(), table).collect()}
    got = {}
    for x in found:
        steps, sizes, ids = (pieces.unpacked(v) for v in (x.places, x.sizes, x.ids))
        ends = sizes.cumsum()
        got |= {(x.group, place): ids[z - n : z].tolist() for place, n, z in zip(steps.cumsum().tolist(), sizes.tolist(), ends.tolist(), strict=True)}
    assert got == {(i // 2, 300 * i): best[w] for i, w in enumerate(words)}


def test_planes_round_trip():
    parts = [np.array(x, dtype=np.int64) for x in ([], [-1], [0, -1, 255, 256, 65535, 299_999])]
    assert pieces.of_planes([list(x) for x in zip(*map(pieces.planes, parts), strict=True)]).tolist() == [int(n) for p in parts for n in p]
