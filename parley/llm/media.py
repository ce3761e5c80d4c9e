"""MPEG audio columns: bytes wrapped in Layer III frames, and a reader for such streams.

The writer makes valid MPEG-1 Layer III frames whose side information says
"silence" and whose main data is ancillary data; a player hears nothing and a
reader gets every byte back. The reader takes any MPEG audio stream: it skips
tags and rubbish, resynchronises on frame headers that are followed by another
header or the end, reads the variable-bitrate table, verifies checksums and
returns exact duration and a seek table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text

# Fixed values of the format: kbit/s by index, samples a second by index and version bits, samples a frame.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
#: Bits of a subband's allocation in Layer II, as (bits, subbands) from the lowest, by table; the last is that of the low rates.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}
#: The writer's stream: MPEG-1, Layer III, checksum, 44,100 samples a second, one channel.
SIDE, RATE, OWN = 17, 44100, 1152


@lru_cache(maxsize=1)
def _crc_table() -> tuple[int, ...]:
    """The format's CRC-16 (polynomial 0x8005) by byte."""
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return tuple(table)


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of ``data``, or of its first ``bits`` bits."""
    c, table = 0xFFFF, _crc_table()
    bits = 8 * len(data) if bits is None else bits
    for b in data[: bits // 8]:
        c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ b]
    for i in range(bits % 8):
        bit = data[bits // 8] >> (7 - i) & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if c >> 15 ^ bit else 0)
    return c


def _covered(after: bytes, version: int, layer: int, kbit: int, rate: int, mode: int, extension: int, side: int) -> int:
    """Bits behind the header that a checksum covers: side information (III), allocation (I), allocation and selection (II)."""
    if layer == 3:
        return 8 * side
    channels = 1 if mode == 3 else 2
    if layer == 1:
        widths = [4] * 32
    else:
        each = kbit // channels
        table = "low" if version == 2 else "a" if 56 <= each <= 80 or rate == 48000 and each >= 56 else "b" if each >= 96 else "c" if rate != 32000 else "d"
        widths = [n for n, times in ALLOCATION[table] for _ in range(times)]
    bound = min(len(widths), 4 * extension + 4) if mode == 1 else len(widths)
    if layer == 1:
        return 4 * (channels * bound + 32 - bound)
    value, size, at, chosen = int.from_bytes(after, "big"), 8 * len(after), 0, 0
    for i, n in enumerate(widths):
        for _ in range(channels if i < bound else 1):
            at += n
            if at <= size and value >> (size - at) & ((1 << n) - 1):
                chosen += 1 if i < bound else channels
    return at + 2 * chosen


def _frame(index: int, body: bytes) -> bytes:
    """A frame of KBITS[1, 3][index] kbit/s: header, checksum, side information of silence, ``body``."""
    head = bytes((0xFF, 0xFA, index << 4, 0xC0))
    size = _size(1, 3, KBITS[1, 3][index], RATE, 0)
    side = bytes(SIDE)
    return (head + crc16(head[2:] + side).to_bytes(2, "big") + side + body).ljust(size, b"\0")


def _size(version: int, layer: int, kbit: int, rate: int, padding: int) -> int:
    if layer == 1:
        return (12000 * kbit // rate + padding) * 4
    return (72000 if version == 2 and layer == 3 else 144000) * kbit // rate + padding


@lru_cache(maxsize=1)
def rooms() -> tuple[int, ...]:
    """Bytes of body by bitrate index."""
    return tuple(max(0, _size(1, 3, k, RATE, 0) - 4 - 2 - SIDE) for k in KBITS[1, 3])


def encode(payload: bytes) -> bytes:
    """A tagged variable-bitrate stream that holds ``payload``: full frames, then the smallest that holds the rest."""
    room = rooms()
    top = len(room) - 1
    frames = [_frame(top, payload[at : at + room[top]]) for at in range(0, len(payload) - room[top] + 1, room[top])]
    if rest := payload[len(frames) * room[top] :]:
        frames.append(_frame(next(i for i in range(1, top + 1) if room[i] >= len(rest)), rest))
    audio = sum(map(len, frames))
    info_size = _size(1, 3, KBITS[1, 3][top], RATE, 0)
    total, seen, toc = info_size + audio, info_size, bytearray()
    ends = [info_size]
    for f in frames:
        seen += len(f)
        ends.append(seen)
    for percent in range(100):
        toc.append(min(255, 256 * ends[percent * len(frames) // 100] // total))
    info = _frame(top, b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc))
    body = b"TXXX" + struct.pack(">IH", len(note := b"\0payload\0" + str(len(payload)).encode()), 0) + note
    n = len(body)
    tag = b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + body
    return tag + info + b"".join(frames)


def header(data: bytes, at: int) -> tuple[int, ...] | None:
    """(size, version, layer, kbit/s, rate, side information bytes, protected, mode, mode extension) of a frame header at ``at``, if there is one."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1 : at + 4]
    bits, layer, index, rate = b >> 3 & 3, 4 - (b >> 1 & 3), c >> 4, c >> 2 & 3
    if bits == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    version, mono = 1 if bits == 3 else 2, d >> 6 == 3
    kbit, hertz = KBITS[version, layer][index], RATES[bits][rate]
    side = 0 if layer != 3 else ((17 if mono else 32) if version == 1 else (9 if mono else 17))
    return _size(version, layer, kbit, hertz, c >> 1 & 1), version, layer, kbit, hertz, side, 1 - (b & 1), d >> 6, d >> 4 & 3


def _tags(data: bytes, at: int, end: int, tags: dict) -> int:
    """Reads the ID3v2 tag at ``at`` into ``tags``: text frames by their id; returns where it ends. Cut or odd frames end the reading."""
    seven = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
    version, flags = data[at + 3], data[at + 5]
    stop = min(end, at + 10 + seven(data[at + 6 : at + 10]) + (10 if version == 4 and flags & 16 else 0))
    p = at + 10
    while version in (3, 4) and p + 10 <= stop and data[p : p + 4].isalnum():
        size = seven(data[p + 4 : p + 8]) if version == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        if p + 10 + size > stop:
            break
        if data[p : p + 1] == b"T" and size:
            text = data[p + 11 : p + 10 + size].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[p + 10], "latin-1"), "replace")
            tags[data[p : p + 4].decode("ascii") + (":" + text.split("\0")[0] if "\0" in text else "")] = text.split("\0")[-1]
        p += 10 + size
    return stop


def _vbr_table(data: bytes, at: int, size: int, side: int, begin: int) -> dict | None:
    """What the table in a first frame says (frames, bytes, toc), if it has one: Xing or Info behind the side information, or VBRI."""
    main, out = data[begin + side : at + size], {"vbr_frames": None, "vbr_bytes": None, "toc": b"", "vbr_at": at}
    number = lambda x: int.from_bytes(x, "big") if len(x) == 4 else None
    if main[:4] in (b"Xing", b"Info"):
        flags, p = number(main[4:8]) or 0, 8
        for bit, name in ((1, "vbr_frames"), (2, "vbr_bytes")):
            if flags & bit:
                out[name] = number(main[p : p + 4])
                p += 4
        return out | ({"toc": main[p : p + 100]} if flags & 4 else {})
    fixed = data[at + 36 : at + size]
    if fixed[:4] == b"VBRI":
        return out | {"vbr_bytes": number(fixed[10:14]), "vbr_frames": number(fixed[14:18])}
    return None


def decode(data: bytes) -> dict:
    """What a stream holds: tags, frames, lost bytes, checksum errors, exact duration, seek table and payload.

    Any bytes can be read: what isn't a frame is skipped and counted.
    """
    out = {"tags": {}, "frames": 0, "skipped": 0, "bad_crc": 0, "samples": 0, "rate": 0, "vbr_frames": None, "vbr_bytes": None, "vbr_at": None, "toc": b"", "seek": [], "kbits": {}}
    at, end, body = 0, len(data), []
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _tags(data, at, end, out["tags"])
    # An ID3v1 tag is the last 128 bytes, where a frame has ended or none is left: frames may hold the same letters.
    last = end - 128 if data[end - 128 : end - 125] == b"TAG" and end - 128 >= at else end
    first = True
    while at < end and at != last:
        h = header(data, at)
        ends = at + h[0] if h else 0
        if h is None or ends > end or (ends not in (last, end) and header(data, ends) is None):
            nxt = data.find(b"\xff", at + 1, end)
            stop = nxt if nxt >= 0 else last if at < last else end
            out["skipped"] += stop - at
            at = stop
            continue
        size, version, layer, kbit, rate, side, protected, mode, extension = h
        begin = at + 4 + 2 * protected
        if protected:
            after = data[begin : at + min(size, 80)]
            bits = _covered(after, version, layer, kbit, rate, mode, extension, side)
            if bits > 8 * len(after) or int.from_bytes(data[at + 4 : at + 6], "big") != crc16(data[at + 2 : at + 4] + after[: -(-bits // 8)], 16 + bits):
                out["bad_crc"] += 1
        table = _vbr_table(data, at, size, side, begin) if first and layer == 3 else None
        if table is not None:
            out |= table
        else:
            out["seek"].append(at)
            out["frames"] += 1
            out["samples"] += SAMPLES[version, layer]
            out["rate"] = out["rate"] or rate
            out["kbits"][kbit] = out["kbits"].get(kbit, 0) + 1
            body.append(data[begin + side : at + size])
        first = False
        at += size
    if at == last < end:
        out["tags"]["TAG"] = data[last + 3 : last + 33].rstrip(b"\0 ").decode("latin-1")
    payload = b"".join(body)
    told = out["tags"].get("TXXX:payload", "")
    return out | {"payload": payload[: int(told)] if told.isascii() and told.isdigit() else payload}


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled up with 0 to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an MPEG audio stream in a binary column.

    Null counts as empty; an empty text is 64 zero bytes. Equal texts give
    equal streams, repeated rows repeated rows, an empty table an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [padded(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [n for _, n in made], "media": [encode(p) for p, _ in made]})

    return by_text(docs, run, "n_bytes long, media binary", id_col, text_col).select("doc_id", "n_bytes", "media")


MEDIA_SCHEMA = "payload binary, media_bytes long, frames long, skipped_bytes long, bad_checksums long, samples long, sample_rate int, duration_s double, seek_offsets array<long>, vbr_agrees boolean, bitrates string"


def read_media(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), digests: bool = False, media_col: str = "media") -> DataFrame:
    """The columns ``keep`` and what the streams hold (MEDIA_SCHEMA).

    duration_s is samples over rate; seek_offsets has the byte offset of every
    frame; vbr_agrees tells if the table's frame and byte counts are what
    was found. With ``digests`` the payload is replaced by payload_bytes,
    payload_sha256, tail_crc32 and media_sha256. A null stream counts as empty.
    """
    kinds = {f.name: f.dataType.simpleString() for f in media.schema.fields}
    rows = media.select(*(F.col(k).cast("string").alias(k) for k in keep), F.col(media_col).alias("media"))
    parts = MEDIA_SCHEMA.removeprefix("payload binary, ")
    extra = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string" if digests else "payload binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for data in b["media"]:
                data = bytes(data) if data is not None else b""
                d = decode(data)
                p = d["payload"]
                agrees = d["vbr_at"] is not None and d["vbr_frames"] == d["frames"] and d["vbr_bytes"] == len(data) - d["vbr_at"]
                own = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(data).hexdigest()) if digests else (p,)
                rows.append((*own, len(data), d["frames"], d["skipped"], d["bad_crc"], d["samples"], d["rate"], d["samples"] / d["rate"] if d["rate"] else 0.0, d["seek"], agrees, ",".join(f"{k}x{n}" for k, n in sorted(d["kbits"].items()))))
            names = [x.split()[0] for x in (extra + ", " + parts).split(", ")]
            yield pd.concat([b[list(keep)].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = ", ".join(f"{k} string" for k in keep) + ", " + extra + ", " + parts
    return rows.mapInPandas(run, schema).withColumns({k: F.col(k).cast(kinds[k]) for k in keep})
