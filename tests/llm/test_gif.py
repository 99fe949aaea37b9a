import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import gif as G


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.booleans())
def test_codes_round_trip(data, repeat):
    data = data * 40 if repeat else data
    assert G.lzw_decode(G.lzw_encode(data), 8, len(data)) == data


def test_all_table_sizes():
    rng = np.random.default_rng(0)
    for bits in range(2, 9):
        data = rng.integers(0, 1 << bits, 30_000, dtype=np.uint8).tobytes()
        assert G.lzw_decode(G.lzw_encode(data, bits), bits, len(data)) == data


def plain_decode(stream, bits):
    """A decoder code by code, by the format's description."""
    clear, end = 1 << bits, (1 << bits) + 1
    table, width, last, out, at = {}, bits + 1, None, bytearray(), 0
    number = int.from_bytes(stream, "little")
    while True:
        code = number >> at & (1 << width) - 1
        at += width
        if code == end:
            return bytes(out)
        if code == clear:
            table, width, last = {}, bits + 1, None
            continue
        run = bytes([code]) if code < clear else table[code] if code in table else last + last[:1]
        if last is not None and end + 1 + len(table) < 4096:
            table[end + 1 + len(table)] = last + run[:1]
            if end + 1 + len(table) == 1 << width and width < 12:
                width += 1
        out += run
        last = run


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=2000), st.integers(1, 12))
def test_codes_in_another_decoder(data, times):
    assert plain_decode(G.lzw_encode(data * times), 8) == data * times


def test_payload_round_trip():
    for text in (None, "", "x", "é" * 50, "long text " * 20_000):
        raw, n = G.payload_of(text)
        assert len(raw) % 64 == 0 and len(raw) >= 64 and raw[:n] == (text or "").encode()
        back, feature = G.read_payload(G.encode(raw))
        assert back == raw
        counts = np.bincount(np.frombuffer(raw, np.uint8) >> 5, minlength=8)
        assert feature == f"frames={-(-len(raw) // (64 * 1024))};ms={100 * -(-len(raw) // (64 * 1024))};hist={','.join(map(str, counts))}"


def picture(*images, size=(4, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    """A GIF of (left, top, width, height, samples, disposal, transparent, delay, interlaced, own palette)."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), bytes(c for p in palette for c in p)]
    for left, top, w, h, samples, disposal, clear, delay, laced, own in images:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, left, top, w, h, 0x40 * laced | (0x81 if own else 0)))
        out.append(bytes(c for p in own for c in p) if own else b"")
        out.append(b"\x02" + G._blocks(G.lzw_encode(bytes(samples), 2)))
    return b"".join(out) + b";"


def shown(frame, palette=("k", "r", "g", "b")):
    names = {(0, 0, 0): "k", (255, 0, 0): "r", (0, 255, 0): "g", (0, 0, 255): "b", (9, 9, 9): "n"}
    return ["".join(names[tuple(int(x) for x in p)] for p in row) for row in frame.canvas]


def test_disposal_and_transparency():
    full = (0, 0, 4, 2, [1] * 8, 1, None, 5, 0, None)
    patch = lambda disposal: (1, 0, 2, 2, [2, 3, 3, 2], disposal, 3, 7, 0, None)
    dot = (3, 1, 1, 1, [3], 0, None, 1, 0, None)
    left = {1: ["rgrr", "rrgb"], 2: ["rkkr", "rkkb"], 3: ["rrrr", "rrrb"]}
    for disposal, last in left.items():
        frames = list(G.frames(picture(full, patch(disposal), dot)))
        assert shown(frames[0]) == ["rrrr", "rrrr"] and shown(frames[1]) == ["rgrr", "rrgr"]
        assert shown(frames[2]) == last
        assert [f.delay_ms for f in frames] == [50, 70, 10]


def test_interlace_and_own_palette():
    rows = [0, 1, 2, 3, 0, 1, 2, 3, 0]
    order = [r for a, b in G.PASSES for r in range(a, 9, b)]
    own = ((9, 9, 9), (255, 0, 0), (0, 255, 0), (0, 0, 255))
    data = picture((0, 0, 1, 9, [rows[r] for r in order], 0, None, 0, 1, own), size=(1, 9))
    (frame,) = G.frames(data)
    assert "".join(shown(frame)) == "nrgbnrgbn"


def test_malformed():
    good = picture((0, 0, 4, 2, [1] * 8, 0, None, 0, 0, None))
    for bad in (b"", b"PNG", good[:-1], good[:20], good[:-4] + b"\0;", good.replace(b"\x2c\0\0\0\0\x04\0", b"\x2c\0\0\0\0\x09\0")):
        with pytest.raises(G.GifError):
            list(G.frames(bad))


def test_huge_and_cut_off(spark):
    """A few bytes that ask for 12 GB, and a GIF whose second frame is cut off: one row each."""
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x80, 0, 0) + bytes(6) + b";"
    with pytest.raises(G.GifError):
        list(G.frames(huge))
    both = picture((0, 0, 4, 2, [1] * 8, 1, None, 5, 0, None), (0, 0, 4, 2, [3] * 8, 0, None, 7, 0, None))
    media = spark.createDataFrame([("huge", huge), ("cut", both[:-8]), ("cut", both[:-8]), ("whole", both)], "key string, content binary")
    rows = [(r["key"], r["frame"]) for r in G.decode_frames(media, "key", "content").collect()]
    assert sorted(rows, key=str) == [("cut", None), ("cut", None), ("huge", None), ("whole", 0), ("whole", 1)]
    assert [r["frame"] for r in G.decode_frames(media.where("key = 'whole'"), "key", "content", most_pixels=7).collect()] == [None]


def test_frames_as_rows(spark):
    data = picture((0, 0, 4, 2, [1] * 8, 1, None, 5, 0, None), (0, 0, 1, 1, [3], 0, None, 7, 0, None))
    media = spark.createDataFrame([("a", data), ("b", None), (None, b"junk")], "key string, content binary")
    rows = sorted(G.decode_frames(media, "key", "content").collect(), key=lambda r: (str(r["key"]), r["frame"] or 0))
    assert [(r["key"], r["frame"], r["start_ms"], r["delay_ms"]) for r in rows] == [(None, None, None, None), ("a", 0, 0, 50), ("a", 1, 50, 70), ("b", None, None, None)]
    assert rows[1]["colour_histogram"] == [0] * 7 + [8] + [8] + [0] * 7 + [8] + [0] * 7
    assert rows[2]["rgb"][:3] == bytes([0, 0, 255]) and G.decode_frames(media.where("false"), "key", "content").count() == 0


def test_query(docs_of):
    texts = [None, "", "same", "same", "x" * 64, "é" * 33, "long " * 30_000]
    out = {r["doc_id"]: r for r in G.gif_digest(docs_of(texts, clash=True)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert [out[2][c] for c in ("media_sha256", "feature")] == [out[3][c] for c in ("media_sha256", "feature")]
    assert [r["doc_id"] for r in G.gif_digest(docs_of([(None, "x", None, None, None)])).collect()] == [None]
    assert G.gif_digest(docs_of([])).count() == 0


def test_query_compresses(docs_of):
    text = "a phrase that comes again, " * 400
    (row,) = G.gif_digest(docs_of([text])).collect()
    media = G.encode(G.payload_of(text)[0])
    assert (row["media_bytes"], row["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert row["media_bytes"] < len(text) // 2 and row["payload_sha256"] == hashlib.sha256(G.payload_of(text)[0]).hexdigest()
