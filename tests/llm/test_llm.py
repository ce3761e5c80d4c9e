"""Training-data operators against brute force, round trips, and awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from parley.llm import chat, golay, langid, licenses, media, packing, pieces, quality, queries, simhash, urls, vectors

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, None), (2, ""), (3, "   \n"), (4, "under the MIT License, under the mit license"), (4, "under the MIT License, under the mit license"), (5, "ein Wort " * 3000), (6, "\U0001f600 日本語 é é ΑΣ <|endoftext|> it's \x1c"), (None, "no id"), (7, "x" * 30000)]


def docs(spark, rows=AWKWARD):
    # an extra column with a clashing name
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, f0 long")


def test_golay_keys_meet_at_one_error():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 5000)
    a, b = golay.keys(v), golay.keys(v ^ (1 << rng.integers(0, 23, 5000)))
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))


def test_families_find_all_pairs_within_three_bits():
    rng = np.random.default_rng(2)
    a = rng.integers(-(2**63), 2**63 - 1, 3000)
    b = a.copy()
    for _ in range(3):
        b ^= np.int64(1) << rng.integers(0, 63, 3000)

    def keys(v):
        bits = np.unpackbits(v.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        number = lambda places: bits[:, places] @ (1 << np.arange(len(places)))
        out = [set() for _ in v]
        for f, (same, fuzzy) in enumerate(simhash.exact_families()):
            for i, (s, g) in enumerate(zip(number(same), golay.keys(number(fuzzy)), strict=True)):
                out[i] |= {(f, int(s), int(x)) for x in g if x >= 0}
        return out

    assert all(x & y for x, y in zip(keys(a), keys(b), strict=True))


def test_simhash_components_against_brute_force(spark):
    r = queries.op8_simhash(spark, SF).toPandas()
    f = [int(x, 16) for x in r.fingerprint]
    label = list(range(len(f)))
    changed = True
    while changed:
        changed = False
        for i in range(len(f)):
            for j in range(i):
                if (f[i] ^ f[j]).bit_count() <= 3 and label[i] != label[j]:
                    low = min(label[i], label[j])
                    label = [low if x in (label[i], label[j]) else x for x in label]
                    changed = True
    low = {}
    for i, x in zip(label, r.doc_id, strict=True):
        low[i] = min(low.get(i, x), x)
    assert [low[i] for i in label] == r.component_id.tolist()


def test_simhash_awkward(spark):
    r = {x.doc_id: x for x in simhash.near_duplicates(docs(spark)).collect()}
    assert r[1].fingerprint == r[2].fingerprint == r[3].fingerprint == "0" * 16 and r[3].component_id == 1
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_license_scan(spark):
    r = {x.doc_id: x for x in licenses.scan(docs(spark)).collect()}
    assert (r[4].n_words, r[4].n_base, r[4].first_word, r[4].last_word, r[4].base_labels) == (8, 2, 0, 4, "mit")
    assert (r[1].n_words, r[1].first_word, r[1].labels, r[1].score) == (0, None, "", 0.0)
    got = licenses.scan_text("Licensed under the Apache License, Version 2.0; see GPL version 3.")
    assert got["base_labels"] == "apache-2" and got["labels"] == "apache-2,gpl-3"


def test_license_gate_is_sound():
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    for line in (licenses.folded(t)[0] for t in [*texts[:60], "BSD 3-clause license", "Creative Commons Attribution-ShareAlike 4.0", "PHP 3.01", "cc0 1.0"]):
        full = sorted((r.name, m.start(), m.end()) for r in licenses.rules() for m in r.pattern.finditer(line))
        assert full == sorted((r.name, a, b) for r, a, b in licenses.candidates(line))


def test_packing(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    source = docs(spark)
    r = packing.pack_documents(source, path).collect()
    want = Counter()
    for i, text in AWKWARD:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in r) == want
    by = {}
    for x in r:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(source.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all(seed):
    r = random.Random(seed)
    counts = Counter(r.randint(1, 4096 if seed % 2 else 1500) for _ in range(3000))
    patterns, _ = packing.plan(counts)
    assert all(sum(x * n for x, n in c) <= 4096 for c, _ in patterns)
    got = Counter()
    for c, times in patterns:
        for x, n in c:
            got[x] += n * times
    assert got == counts
    least = -(-sum(x * n for x, n in counts.items()) // 4096)
    assert sum(n for _, n in patterns) <= 1.03 * least + 2 or max(counts) > 2048


def test_media_round_trip(spark):
    rows = media.read_media(media.to_media(docs(spark)), digests=True).collect()
    for x, (_, text) in zip(rows, AWKWARD, strict=True):
        payload, n = media.padded(text)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert x.bad_checksums == 0 and x.skipped_bytes == 0 and x.vbr_agrees


def test_media_resynchronises():
    stream = media.encode(b"abc" * 2000)
    start = stream.index(b"\xff\xfa")
    broken = stream[:start] + b"rubbish\xff\xfb\x00" + stream[start:]
    assert media.decode(broken)["payload"] == b"abc" * 2000 and media.decode(broken)["skipped"] == 10
    hurt = bytearray(stream)
    hurt[start + 4] ^= 1
    assert media.decode(bytes(hurt))["bad_crc"] == 1


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.learn_and_identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.95
    r = {x.doc_id: x for x in langid.learn_and_identify(docs(spark)).collect()}
    assert r[1].lang_pred == r[2].lang_pred == r[3].lang_pred == "und"
    assert langid.learn_and_identify(docs(spark).limit(0)).count() == 0


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    r = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert r[r.quality == 1].kept.mean() > 0.98 and r[r.quality == 0].kept.mean() < 0.2
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(x.kept for x in quality.classify(docs(spark), none).collect())


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    v = np.concatenate([base, base + rng.normal(size=(60, 16)) * 0.2, base[:5]])
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, [])]
    got = {x.vec_id: x for x in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = np.array([r for _, r in rows[: len(v)]], dtype=float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    assert sum(got[i].n_links for i in range(len(v))) >= 0.9 * (hit.sum() - len(v))
    assert all(got[i].n_links <= hit[i].sum() - 1 for i in range(len(v)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 905))


def test_pieces_against_the_library(spark, tmp_path):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    table = pieces.piece_table(spark, path)
    words = ["▁the", "▁thonedble", "▁Ciónmenteueó.", "▁", "▁日本x", "▁a\nb", "▁\U0001f600"]
    encoded = pieces.encode_chunks(spark.createDataFrame([(w,) for w in words], "chunk string"), table)
    got = {x.chunk: (x.ids, x.score) for x in encoded.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    known = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    lowest = min(s for _, s in known.values()) - 10
    for w in words:  # brute force: the best path by dynamic programming over all substrings
        best = [0.0] + [None] * len(w)
        for stop in range(1, len(w) + 1):
            for a in range(stop):
                s = known[w[a:stop]][1] if w[a:stop] in known else lowest if stop - a == 1 else None
                if s is not None and (best[stop] is None or best[a] + s > best[stop]):
                    best[stop] = best[a] + s
        assert got[w][1] == pytest.approx(best[-1])
    decoded = {x.chunk: x.decoded for x in pieces.decode_chunks(encoded, table).collect()}
    assert decoded == {w: w for w in words}


def test_chat_and_urls(spark):
    turns = [(1, s, i, r, t) for s in ("chosen", "rejected") for i, (r, t) in enumerate([("user", "hi"), ("assistant", "good" if s == "chosen" else "bad")])] + [(2, "chosen", 0, "user", None), (2, "rejected", 0, "user", None)]
    r = {x.pair_id: x for x in chat.format_preferences(spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")).collect()}
    assert r[1].prompt == "<|user|>\nhi<|end|>\n" and r[1].status == "ok"
    a, b = map(int, r[1].chosen_mask.split("-"))
    assert r[1].chosen[a:b] == "good<|end|>\n"
    assert r[2].status == "identical" and r[2].chosen == ""
    changes = spark.createDataFrame([("a.com", 1, 0, "add", "block"), ("a.com", 5, 1, "remove", "block")], "key string, day long, seq int, change string, action string")
    captures = spark.createDataFrame([(1, "http://x.a.com/p", 3), (2, "http://x.a.com/p", 6), (3, None, 3), (4, "junk", None)], "page_id long, url string, day long")
    got = {x.page_id: x.decision for x in urls.judge(captures, urls.intervals(changes)).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
