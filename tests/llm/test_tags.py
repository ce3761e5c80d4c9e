"""ID3v1 tags stand behind the last frame; the same letters inside a frame are payload."""

import pytest

from parley.llm import media, simhash


def test_letters_of_a_tag_at_each_place():
    for n in range(400):
        payload, _ = media.padded("x" * n + "TAG" + "y" * (400 - n))
        got = media.decode(media.encode(payload))
        assert got["payload"] == payload and got["skipped"] == 0 and "TAG" not in got["tags"]


@pytest.mark.parametrize("n", range(1, 1500, 7))
def test_prefixes_of_repeated_letters(n):
    payload, _ = media.padded(("TAG" * 600)[:n])
    got = media.decode(media.encode(payload))
    assert got["payload"] == payload and got["skipped"] == 0


def test_a_real_tag_is_read():
    payload, _ = media.padded("some text " * 50)
    tag = b"TAG" + b"A title".ljust(30, b"\0") + bytes(95)
    got = media.decode(media.encode(payload) + tag)
    assert got["payload"] == payload and got["tags"]["TAG"] == "A title" and got["skipped"] == 0
    broken = media.decode(media.encode(payload)[:-1] + tag)
    assert broken["tags"]["TAG"] == "A title" and broken["skipped"] > 0
    assert media.decode(tag)["tags"]["TAG"] == "A title" and media.decode(b"")["frames"] == 0
    assert media.decode(b"\xff" * 200 + tag[:100])["frames"] == 0


def test_an_extra_column_with_a_clashing_name(spark):
    rows = [(1, "a", "text"), (1, "b", "text"), (2, "c", "other"), (None, "d", "x"), (None, "e", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumnRenamed("row", "_row").withColumn("row", simhash.F.lit("r"))
    got = simhash.one_row_per_id(docs)
    assert got.columns == docs.columns and got.count() == 4
