"""Operator 7: media columns, GIF.

A decoder turns a GIF into timed frames: it walks the blocks, decodes LZW code streams, applies palettes, transparency,
interlacing and disposal, and composes the canvas. A writer stores 8-bit samples losslessly as an animation: rows of
WIDTH pixels, at most FRAME_ROWS rows a frame, the sample being the palette index, LZW-compressed.

Null and empty payloads are stored as one block of zeros. A truncated or foreign file raises GifError in decode(); the
frame table gives such a row no frames and its error text, and so it does for screens and images of over `max_pixels`. Any
length works, in frames of bounded size; a file's frames go out one by one, after a first pass has found it whole. Equal payloads give equal bytes; repeated rows give repeated rows, an empty table
none. Only the id and payload columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import table, texts

WIDTH = 64
FRAME_ROWS = 1024
DELAY_CS = 10
#: Levels of each colour channel in a histogram.
LEVELS = 2
#: Pixels of a screen or an image at most, unless a caller says otherwise; larger ones are refused before memory is taken.
MAX_PIXELS = 1 << 24

# Fixed values of the format: https://www.w3.org/Graphics/GIF/spec-gif89a.txt
TRAILER, EXTENSION, IMAGE = 0x3B, 0x21, 0x2C
CONTROL, APPLICATION = 0xF9, 0xFF
MAX_CODES = 4096


class GifError(ValueError):
    """The bytes are not a whole GIF."""


@dataclass
class Frame:
    indices: np.ndarray  # (rows, columns) as stored, in display order
    canvas: np.ndarray  # (height, width, 4) after the frame is drawn
    left: int
    top: int
    delay_ms: int
    disposal: int
    transparent: int | None


def _widths(first: int, count: int) -> np.ndarray:
    """Bits of the n-th code after a clear, for literals of `first` - 1 bits: the table has one entry more with each code but the first."""
    entries = np.minimum((1 << (first - 1)) + 1 + np.arange(count), MAX_CODES - 1)
    return np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1


_SPANS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _span(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes from one clear to the latest next, and where each starts."""
    if bits not in _SPANS:
        widths = np.maximum(_widths(bits, MAX_CODES + 2), bits)
        _SPANS[bits] = widths, np.concatenate([[0], np.cumsum(widths)])
    return _SPANS[bits]


def lzw_compress(samples: bytes, size: int = 8) -> bytes:
    """The code stream of samples below 2**size. The table is cleared when it is full."""
    clear = 1 << size
    groups: list[list[int]] = []
    codes: list[int] = []
    known: dict[int, int] = {}
    entry = clear + 2
    it = iter(samples)
    prefix = next(it, -1)
    find, put = known.get, codes.append
    for sample in it:
        key = (prefix << 8) | sample
        code = find(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = sample
        if entry < MAX_CODES:
            known[key] = entry
            entry += 1
        else:
            groups.append(codes)
            codes = []
            put = codes.append
            known.clear()
            entry = clear + 2
    if prefix >= 0:
        put(prefix)
    groups.append(codes)
    widths, _ = _span(size + 1)
    all_codes, all_widths = [np.array([clear])], [np.array([size + 1])]
    for k, group in enumerate(groups):
        n = len(group) + 1
        all_codes.append(np.array([*group, clear if k + 1 < len(groups) else clear + 1]))
        all_widths.append(widths[:n])
    return _pack_bits(np.concatenate(all_codes), np.concatenate(all_widths))


def _pack_bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of given widths, least bit first."""
    ends = np.cumsum(widths)
    starts = ends - widths
    out = np.zeros(int(ends[-1] + 7) // 8 + 3, np.uint8)
    shifted = codes.astype(np.int64) << (starts & 7)
    at = starts >> 3
    # Codes of 9 bits or more overlap in at most one byte with the next: those of even and odd place never share a byte
    # in which both set bits, so sums equal unions.
    for k in range(3):
        out += np.bincount(at + k, (shifted >> (8 * k)) & 0xFF, len(out)).astype(np.uint8)
    return out[: int(ends[-1] + 7) // 8].tobytes()


def lzw_expand(data: bytes, size: int, want: int) -> bytes:
    """Samples of a code stream: `want` of them, or GifError. A full table stays until the next clear, with codes of 12 bits."""
    clear, end = 1 << size, (1 << size) + 1
    literals = [bytes([i]) for i in range(clear)] + [b"", b""]
    fresh = _span(size + 1)
    full = np.full(MAX_CODES, 12), 12 * np.arange(MAX_CODES + 1)
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    bit, total, got, out = 0, 8 * len(data), 0, []
    widths, starts = fresh
    entries, before = list(literals), b""
    while got < want and bit < total:
        n = int(np.searchsorted(starts, total - bit, "right")) - 1
        if n <= 0:
            break
        at = bit + starts[:n]
        byte = at >> 3
        word = padded[byte].astype(np.int64) | (padded[byte + 1].astype(np.int64) << 8) | (padded[byte + 2].astype(np.int64) << 16)
        codes = (word >> (at & 7)) & ((1 << widths[:n]) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stops[0]) if len(stops) else n
        add, put = entries.append, out.append
        known = len(entries)
        for code in codes[:upto].tolist():
            if code < known:
                string = entries[code]
                if before and known < MAX_CODES:
                    add(before + string[:1])
                    known += 1
            elif code == known and before and known < MAX_CODES:
                string = before + before[:1]
                add(string)
                known += 1
            else:
                raise GifError("a code points past its table")
            put(string)
            got += len(string)
            before = string
        if not len(stops):
            if n < len(starts) - 1:
                break  # the stream has ended
            bit += int(starts[n])
            widths, starts = full
            continue
        bit += int(starts[upto] + widths[upto])
        if codes[upto] == end:
            break
        widths, starts = fresh
        entries, before = list(literals), b""
    samples = b"".join(out)
    if len(samples) < want:
        raise GifError(f"{len(samples)} samples; the image has {want}")
    return samples[:want]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        size = data[at]
        at += 1
        if not size:
            return b"".join(parts), at
        if at + size > len(data):
            raise GifError("a block is cut off")
        parts.append(data[at : at + size])
        at += size


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    colours = np.zeros((256, 3), np.uint8)
    colours[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    return colours, at + 3 * n


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> tuple[list[Frame], int, int]:
    """Frames, width and height."""
    frames = list(frames_of(data, max_pixels))
    return frames, *screen(data, max_pixels)


def screen(data: bytes, max_pixels: int = MAX_PIXELS) -> tuple[int, int]:
    """Width and height, or GifError."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF signature")
    if len(data) < 13:
        raise GifError("the file is cut off")
    width, height = struct.unpack_from("<HH", data, 6)
    if width * height > max_pixels:
        raise GifError(f"a screen of {width} x {height} pixels")
    return width, height


def frames_of(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """Frames one by one, so that one canvas is held at a time; GifError where the file ends early."""
    try:
        yield from _frames(data, max_pixels)
    except (IndexError, struct.error, ValueError) as e:
        raise e if isinstance(e, GifError) else GifError(f"not a whole GIF: {e}") from e


def _frames(data: bytes, max_pixels: int) -> Iterator[Frame]:
    width, height = screen(data, max_pixels)
    flags = data[10]
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    transparent: int | None = None
    while True:
        mark = data[at]
        at += 1
        if mark == TRAILER:
            return
        if mark == EXTENSION:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == CONTROL and len(body) >= 4:
                disposal = (body[0] >> 2) & 7
                delay = 10 * (body[1] | (body[2] << 8))
                transparent = body[3] if body[0] & 1 else None
            continue
        if mark != IMAGE:
            raise GifError(f"unknown block {mark:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = common
        if flags & 0x80:
            colours, at = _palette(data, at, flags)
        if colours is None:
            raise GifError("an image has no palette")
        size = data[at]
        if not 2 <= size <= 8:
            raise GifError(f"code size {size}")
        if w * h > max_pixels:
            raise GifError(f"an image of {w} x {h} pixels")
        stream, at = _blocks(data, at + 1)
        indices = np.frombuffer(lzw_expand(stream, size, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indices)
            straight[rows] = indices
            indices = straight
        kept = canvas.copy() if disposal == 3 else None
        hi, wi = max(0, min(h, height - top)), max(0, min(w, width - left))
        inside = indices[:hi, :wi]
        drawn = np.dstack([colours[inside], np.full(inside.shape, 255, np.uint8)])
        region = canvas[top : top + hi, left : left + wi]
        region[...] = drawn if transparent is None else np.where((inside == transparent)[:, :, None], region, drawn)
        yield Frame(indices, canvas.copy(), left, top, delay, disposal, transparent)
        if disposal == 2:
            region[...] = 0
        elif kept is not None:
            canvas = kept
        delay = disposal = 0
        transparent = None


#: Palette of stored samples: three bits of red, three of green, two of blue.
_RGB = np.stack([((np.arange(256) >> s) & m) * (255 // m) for s, m in ((5, 7), (2, 7), (0, 3))], axis=1).astype(np.uint8)


def encode(samples: bytes) -> bytes:
    """An animation whose palette indices, frame by frame, are the samples. Their number is a multiple of WIDTH."""
    step = WIDTH * FRAME_ROWS
    height = min(len(samples), step) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), _RGB.tobytes()]
    for at in range(0, len(samples), step):
        part = samples[at : at + step]
        stream = lzw_compress(part)
        out += [bytes([EXTENSION, CONTROL, 4, 1 << 2]), struct.pack("<H", DELAY_CS), b"\0\0", bytes([IMAGE]), struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08"]
        for k in range(0, len(stream), 255):
            block = stream[k : k + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    return b"".join([*out, bytes([TRAILER])])


def histogram(canvas: np.ndarray) -> list[int]:
    """Opaque pixels by colour, LEVELS levels a channel."""
    flat = canvas.reshape(-1, 4)
    level = (flat[flat[:, 3] > 0, :3].astype(np.int64) * LEVELS) >> 8
    return np.bincount((level[:, 0] * LEVELS + level[:, 1]) * LEVELS + level[:, 2], minlength=LEVELS**3).tolist()


def gif_frames(files: DataFrame, id_col: str = "id", data_col: str = "data", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """A row for each frame: (id, frame, start_ms, delay_ms, width, height, disposal, transparent, rgba, histogram, error)."""
    kind = files.schema[id_col].dataType.simpleString()
    names = [id_col, "frame", "start_ms", "delay_ms", "width", "height", "disposal", "transparent", "rgba", "histogram", "error"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def rows_of(data: bytes) -> Iterator[tuple]:
        try:
            width, height = screen(data, max_pixels)
            for _ in frames_of(data, max_pixels):
                pass  # a file that is not whole has no frames
        except GifError as e:
            yield (None,) * 9 + (str(e),)
            return
        start = 0
        for k, f in enumerate(frames_of(data, max_pixels)):
            yield k, start, f.delay_ms, width, height, f.disposal, f.transparent, f.canvas.tobytes(), histogram(f.canvas), None
            start += f.delay_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(1)):
                for row in rows_of(data.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([x], t) for x, t in zip(row, kinds, strict=True))], names)

    schema = f"{id_col} {kind}, frame int, start_ms bigint, delay_ms int, width int, height int, disposal int, transparent int, rgba binary, histogram array<bigint>, error string"
    return files.select(id_col, data_col).mapInArrow(run, schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as a GIF, read it back and describe what was read."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(text: str) -> tuple:
        raw = text.encode()
        stored = encode(raw + bytes(-len(raw) % WIDTH if raw else WIDTH))
        parts, colours, shown = [], np.zeros(LEVELS**3, np.int64), 0
        for f in frames_of(stored):
            parts.append(f.indices.tobytes())
            colours += histogram(f.canvas)
            shown += f.delay_ms
        width, height = screen(stored)
        read = b"".join(parts)
        feature = f"{width}x{height};{len(parts)} frames;{shown} ms;" + ",".join(map(str, colours.tolist()))
        return len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(t) for t in texts(b, text_col)]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))
