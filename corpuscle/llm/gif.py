"""GIF images as columns: LZW code streams, palettes, disposal, transparency, timed frames, histograms.

The codec is written here after the public format description (GIF89a). ``encode`` stores 8-bit samples without
loss; ``frames`` decodes any non-interlaced or interlaced GIF into composed RGB frames with their times.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import ship

from .common import col

#: Fixed values of the format.
MAX_BITS, MAX_CODES = 12, 4096
EXTENSION, IMAGE, TRAILER, GRAPHIC_CONTROL = 0x21, 0x2C, 0x3B, 0xF9
#: Rows of an interlaced image: (first, step) of each pass.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
WIDTH, FRAME_ROWS, DELAY_MS = 64, 1024, 100
BINS = 8
#: A larger canvas is refused: a few bytes may ask for 65,535 x 65,535 pixels. This one takes 96 MB.
MOST_PIXELS = 1 << 25


class GifError(ValueError):
    """Bytes that are no GIF, or one that breaks off."""


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The code stream of samples below ``2 ** bits``, compressed. The clear code follows when the table is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, starts = [clear], [1]
    table, following = {}, end + 1
    known, emit = table.get, codes.append
    held = -1
    for sample in samples:
        if held < 0:
            held = sample
            continue
        key = held << 8 | sample
        longer = known(key)
        if longer is not None:
            held = longer
            continue
        emit(held)
        if following < MAX_CODES:
            table[key] = following
            following += 1
        else:
            emit(clear)
            starts.append(len(codes))
            table.clear()
            following = end + 1
        held = sample
    if held >= 0:
        emit(held)
    emit(end)
    return _pack(np.array(codes, dtype=np.uint16), _widths_of(starts, len(codes), bits))


def _widths(n: int, bits: int) -> np.ndarray:
    """Of each of ``n`` codes after a clear code: its bits, as all but the first before it made an entry."""
    entries = np.minimum(np.maximum(np.arange(n) - 1, 0) + (1 << bits) + 2, MAX_CODES)
    return np.minimum(np.ceil(np.log2(entries + 1)).astype(np.int64), MAX_BITS)


def _widths_of(starts: list[int], n: int, bits: int) -> np.ndarray:
    """The bits of ``n`` codes, the first a clear code, whose stretches after clear codes begin at ``starts``."""
    return np.concatenate([[bits + 1], *(_widths(b - a, bits) for a, b in zip(starts, [*starts[1:], n], strict=True))])


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of given widths, least bits first."""
    grid = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(grid[np.arange(16) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """The first ``size`` samples of a code stream. Raises GifError if the stream breaks off or has an unknown code.

    The codes up to the next clear code have known widths, so they are cut out at once.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    out, made, at = [], 0, 0
    table, last = list(first), None
    widths, index = _widths(MAX_CODES, bits), 0
    while made < size:
        if index < MAX_CODES:
            ahead = widths[index:]
        else:  # a full table that no clear code has followed yet
            ahead = np.full(MAX_CODES, MAX_BITS)
        ends = at + np.cumsum(ahead)
        n = int(np.searchsorted(ends, 8 * len(stream), side="right"))
        if not n:
            raise GifError("the code stream breaks off")
        begins, ahead = ends[:n] - ahead[:n], ahead[:n]
        place = begins >> 3
        word = raw[place] | raw[place + 1] << 8 | raw[place + 2] << 16
        codes = word >> (begins & 7).astype(np.uint32) & ((1 << ahead) - 1).astype(np.uint32)
        special = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(special[0]) if len(special) else n
        for code in codes[:stop].tolist():
            if code < len(table):
                run = table[code]
            elif code == len(table) and last is not None:
                run = last + last[:1]
            else:
                raise GifError(f"unknown code {code}")
            if last is not None and len(table) < MAX_CODES:
                table.append(last + run[:1])
            last = run
            out.append(run)
            made += len(run)
            if made >= size:
                break
        if made >= size:
            break
        if stop == n:
            at, index = int(ends[n - 1]), index + n
        elif codes[stop] == end:
            raise GifError(f"the code stream ends after {made} of {size} samples")
        else:
            at, index, last = int(ends[stop]), 0, None
            del table[clear + 2 :]
    return b"".join(out)[:size]


def _blocks(data: bytes) -> bytes:
    parts = [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(parts) + b"\0"


GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode(samples: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay_ms: int = DELAY_MS) -> bytes:
    """Samples, a positive multiple of ``width``, as a GIF of grey frames of ``rows`` rows at most."""
    if not samples or len(samples) % width:
        raise ValueError(f"{len(samples)} samples do not fill rows of {width}")
    high = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, high, 0xF7, 0, 0), GREY]
    for i in range(0, len(samples), width * rows):
        part = samples[i : i + width * rows]
        out.append(struct.pack("<BBBBHBB", EXTENSION, GRAPHIC_CONTROL, 4, 1 << 2, delay_ms // 10, 0, 0))
        out.append(struct.pack("<BHHHHB", IMAGE, 0, 0, width, len(part) // width, 0) + b"\x08")
        out.append(_blocks(lzw_encode(part)))
    return b"".join(out) + bytes([TRAILER])


@dataclass
class Frame:
    """One picture: its own samples, where they lie, and the whole canvas as it is shown."""

    samples: np.ndarray
    left: int
    top: int
    delay_ms: int
    disposal: int
    canvas: np.ndarray


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("it breaks off in a block")
        size = data[at]
        if not size:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size


def frames(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """The frames in order, each composed over what its predecessor's disposal left.

    Disposal 2 clears the frame's rectangle to black, 3 restores what was there before the frame, others leave
    it. Samples equal to the transparent index keep the canvas. Raises GifError on anything malformed
    and, before it takes memory, on a canvas of more than ``most_pixels``.
    """
    try:
        yield from _frames(data, most_pixels)
    except (struct.error, IndexError) as e:
        raise GifError("it breaks off") from e


def _frames(data: bytes, most_pixels: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    if width * height > most_pixels:
        raise GifError(f"a canvas of {width} x {height}")
    canvas = np.zeros((height, width, 3), dtype=np.uint8)
    delay, disposal, clear_index = 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == TRAILER:
            return
        if kind == EXTENSION:
            label = data[at]
            body, at = _sub_blocks(data, at + 1)
            if label == GRAPHIC_CONTROL:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, clear_index = hundredths * 10, packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != IMAGE:
            raise GifError(f"unknown block {kind:#x}")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = shared
        if packed & 0x80:
            palette, at = _palette(data, at, packed)
        if palette is None:
            raise GifError("an image without a palette")
        bits = data[at]
        if not 2 <= bits <= 8 or left + w > width or top + h > height:
            raise GifError("an image off the canvas or of odd depth")
        stream, at = _sub_blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, bits, w * h), dtype=np.uint8).reshape(h, w)
        if packed & 0x40:
            order = [r for first, step in PASSES for r in range(first, h, step)]
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        if samples.size and samples.max() >= len(palette):
            raise GifError("a sample off the palette")
        before = canvas.copy() if disposal == 3 else None
        place = canvas[top : top + h, left : left + w]
        colours = palette[samples]
        if clear_index is None:
            place[:] = colours
        else:
            place[:] = np.where((samples == clear_index)[..., None], place, colours)
        yield Frame(samples, left, top, delay, disposal, canvas.copy())
        if disposal == 2:
            place[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    size = 3 << (flags & 7) + 1
    if at + size > len(data):
        raise GifError("the palette breaks off")
    return np.frombuffer(data, dtype=np.uint8, count=size, offset=at).reshape(-1, 3), at + size


def histogram(rgb: np.ndarray) -> list[int]:
    """Counts of each channel's values in BINS equal bins: red, green, blue."""
    binned = rgb.reshape(-1, 3) >> 8 - (BINS.bit_length() - 1)
    return [int(n) for c in range(3) for n in np.bincount(binned[:, c], minlength=BINS)]


DECODED = "key string, frame int, start_ms long, delay_ms int, width int, height int, disposal int, colour_histogram array<int>, rgb binary"


def decode_frames(media: DataFrame, key: str, content: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row per frame of the GIFs in a binary column; ``key`` comes as a string, null stays null.

    Each has its number, start and delay, the canvas' size, disposal, the histogram of the composed canvas (eight
    bins each of red, green and blue) and its RGB bytes. A GIF that is null, empty,
    malformed anywhere or larger than ``most_pixels`` gives one row with nulls from ``frame`` on and no others: it is
    decoded once to see whether it is whole. Repeated rows give repeated frames; an empty table gives none.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "frame", "start_ms", "delay_ms", "width", "height", "disposal", "colour_histogram", "rgb"]
        for batch in batches:
            for k, data in zip(batch["key"], batch["content"], strict=True):
                start = 0
                try:
                    for _ in frames(data or b"", most_pixels):
                        pass
                except GifError:
                    yield pd.DataFrame([(k, *[None] * 8)], columns=names)
                    continue
                for i, f in enumerate(frames(data, most_pixels)):
                    h, w, _ = f.canvas.shape
                    yield pd.DataFrame([(k, i, start, f.delay_ms, w, h, f.disposal, histogram(f.canvas), f.canvas.tobytes())], columns=names)
                    start += f.delay_ms

    ship(media.sparkSession)
    return media.select(col(key).cast("string").alias("key"), col(content).alias("content")).mapInPandas(decode, DECODED)


def payload_of(text: str | None, unit: int = WIDTH) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, filled with zeros to a positive multiple of ``unit``, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw)), len(raw)


def read_payload(data: bytes) -> tuple[bytes, str]:
    """The grey samples of all frames of a stored GIF, and its feature: frames, time and histogram of grey."""
    parts, total, n = [], 0, 0
    counts = np.zeros(BINS, dtype=np.int64)
    for f in frames(data):
        h, w = f.samples.shape
        shown = np.ascontiguousarray(f.canvas[f.top : f.top + h, f.left : f.left + w, 0])
        parts.append(shown.tobytes())
        counts += np.bincount(shown.ravel() >> 5, minlength=BINS)
        total += f.delay_ms
        n += 1
    return b"".join(parts), f"frames={n};ms={total};hist={','.join(map(str, counts))}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def gif_digest(documents: DataFrame) -> DataFrame:
    """Every text stored as a GIF and read back from its bytes; null and empty texts are 64 zeros.

    Whole texts, however long, in frames of WIDTH x FRAME_ROWS samples. Rows stay as many as they are: equal texts
    have equal values, repeated rows are repeated, a null doc_id stays null. An empty table gives an empty result;
    other columns may have any name.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw, n = payload_of(text)
                media = encode(raw)
                back, feature = read_payload(media)
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=names)

    ship(documents.sparkSession)
    kept = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return kept.mapInPandas(digest, DIGEST.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
