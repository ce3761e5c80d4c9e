"""Seek tables of variable-bitrate streams."""

from parley.llm import media


def test_every_frame_has_its_offset():
    stream = media.encode(bytes(range(256)) * 400)
    found = media.decode(stream)
    assert found["frames"] > 64 and len(found["seek"]) == found["frames"]
    sizes = [media.header(stream, at)[0] for at in found["seek"]]
    assert [a + n for a, n in zip(found["seek"], sizes, strict=True)] == [*found["seek"][1:], len(stream)]
