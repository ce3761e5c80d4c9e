"""Literal cases of the contracts: control characters, malformed streams, unusual ids."""

import struct
import unicodedata

import numpy as np

from parley.llm import media, packing, queries, simhash


def test_encoder_equals_the_tokenizer_for_every_code_point():
    e = packing.WordEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    assert e.known
    points = [c for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) <= 0xDFFF and unicodedata.category(c) not in ("Cn", "Co")]
    for at in range(0, len(points), 512):
        some = [f"a{c}b" for c in points[at : at + 512]]
        want = [np.array(x.ids, dtype="<u4").tobytes() for x in e.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [e.encode(t) for t in some] == want
    assert np.frombuffer(e.encode("a\x07b"), "<u4").tolist() == [320, 451, 321]


def test_unknown_tokenizers_see_whole_texts():
    e = packing.WordEncoder(queries.tokenizer_path("word_bpe_49k.json"))
    e.known = False
    assert e.encode("It's  new") == e.whole("It's  new")


def test_malformed_streams_are_read():
    cut_table = bytes((0xFF, 0xF3, 0x10, 0xC0)) + bytes(9) + b"Xing" + struct.pack(">I", 3)
    cut_table = cut_table.ljust(media.header(cut_table, 0)[0], b"\0")
    assert media.decode(cut_table)["frames"] == 0 and media.decode(cut_table)["vbr_at"] == 0
    body = b"TXXX" + struct.pack(">IH", 11, 0) + b"\0payload\0" + b"\xb2\xb2"
    odd = b"ID3\x03\0\0\0\0\0" + bytes((len(body),)) + body + media.encode(b"x" * 64)
    assert media.decode(odd)["payload"].startswith(b"x" * 64)
    rng = np.random.default_rng(4)
    stream = media.encode(bytes(range(256)) * 20)
    for _ in range(300):
        data = bytearray(stream[: rng.integers(0, len(stream))])
        for i in rng.integers(0, max(1, len(data)), 20):
            if data:
                data[i] = rng.integers(0, 256)
        media.decode(bytes(data))
        media.decode(rng.bytes(300))


def test_tags_of_version_four_and_vbri():
    text = b"\3" + "Jürgen".encode() + b"x" * 200
    body = b"TPE1" + bytes((0, 0, len(text) >> 7, len(text) & 127)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + bytes((0, 0, len(body) >> 7, len(body) & 127)) + body
    stream = media.encode(b"abc" * 500)
    frames = stream[stream.index(b"\xff\xfa") :]
    first, rest = frames[: media.header(frames, 0)[0]], frames[media.header(frames, 0)[0] :]
    vbri = bytearray(len(first))
    vbri[:4] = first[:4]
    vbri[36:54] = b"VBRI" + struct.pack(">HHHII", 1, 0, 75, len(frames), 2)
    found = media.decode(tag + bytes(vbri) + rest)
    assert found["tags"]["TPE1"].startswith("Jürgen") and found["vbr_frames"] == found["frames"] == 2 and found["vbr_bytes"] == len(frames) and found["skipped"] == 0


def test_checksums_of_the_other_layers():
    for layer, second in ((1, 0xFE), (2, 0xFC)):
        for mode in (0x00, 0x50, 0xC0):
            head = bytes((0xFF, second, 0x80, mode))
            size, version, _, kbit, rate, side, protected, m, x = media.header(head + bytes(4), 0)
            after = np.random.default_rng(layer).bytes(size - 6)
            bits = media._covered(after[:74], version, layer, kbit, rate, m, x, side)
            assert 16 <= bits <= 8 * 74
            crc = media.crc16(head[2:] + after[: -(-bits // 8)], 16 + bits)
            good = head + crc.to_bytes(2, "big") + after
            bad = head + (crc ^ 1).to_bytes(2, "big") + after
            assert (media.decode(good)["bad_crc"], media.decode(bad)["bad_crc"]) == (0, 1)


def test_ids_of_any_type(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), (None, "one two three four"), ("c", None), (None, "other words here now")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = simhash.near_duplicates(d).collect()
    assert {x.doc_id: x.component_id for x in got if x.doc_id} == {"a": "a", "b": "a", "c": "c"}
    assert sorted(x.component_id or "" for x in got if x.doc_id is None) == ["", "a"]
    assert {x.doc_id: x.component_id for x in simhash.similar_groups(d).collect() if x.doc_id} == {"a": "a", "b": "a", "c": "c"}
    assert packing.pack_documents(d, queries.tokenizer_path("word_bpe_49k.json")).count() == 5
    assert media.read_media(media.to_media(d), digests=True).count() == 5


def test_long_ids_beside_nulls_stay_whole(spark):
    big = 2**60 + 1
    d = spark.createDataFrame([(big, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert {x.doc_id for x in media.read_media(media.to_media(d)).collect()} == {big, None}
    assert {x.doc_id for x in simhash.near_duplicates(d).collect()} == {big, None}


def test_recall_of_near_duplicates(spark, monkeypatch):
    """Every document in the crowd is compared exactly; the keys find at least 0.98 of what that drops."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {x.doc_id for x in simhash.similar_groups(d).where("doc_id <> component_id").collect()}
    monkeypatch.setattr(simhash, "crowded_nodes", lambda prints, families: simhash.stored(prints.select("node")))
    exact = {x.doc_id for x in simhash.similar_groups(d).where("doc_id <> component_id").collect()}
    assert found <= exact and len(found) >= 0.98 * len(exact) > 0
