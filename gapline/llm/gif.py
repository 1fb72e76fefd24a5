"""Media columns: GIF.

``encode_gif`` stores 8-bit samples as timed frames 64 pixels wide with a grey palette and LZW code streams. A frame is
cleared once shown, and zeros, such as padding, are left out as transparent where the samples leave a palette place
free. ``decode_gif`` reads any GIF: global and local palettes, interlacing, transparency, disposal and frame times;
``read_back`` takes the payload from the pictures that it composes.
An LZW code stands for the text of an earlier code and one more byte, so a code stream is a list of copies from
its own output: codes are unpacked at known widths and the copies resolved by following their sources in numpy.

Defined cases: a null text is empty and is stored as 64 zero bytes; broken data, cut off data included, raise
ValueError in ``decode_gif`` and give a row with null media columns in ``frames`` and ``read_back``; a graphic control
block holds for the one frame behind it; texts of any length are whole, one frame after the other; repeated rows give
repeated results, a null id stays null, an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gapline.llm.common import encode

WIDTH, UNIT, FRAME_ROWS, DELAY, CLEAR = 64, 64, 256, 10, 255
#: Pictures of more pixels are refused as broken: a header could else ask for any memory.
MOST_PIXELS = 1 << 24
MOST_CODES = 4096


_WIDTHS = {}


def code_widths(size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear, and their bit offsets."""
    known = _WIDTHS.get(size)
    if known is None or len(known[0]) < count:
        first = (1 << size) + 2
        n = max(count, 4400)
        k = np.arange(n)
        entries = np.where(k == 0, first - 1, np.minimum(first + k - 1, MOST_CODES))  # table size when code k is read
        widths = np.minimum(np.array([int(e).bit_length() for e in np.maximum(entries, first)]), 12)
        known = _WIDTHS[size] = (widths, np.concatenate([[0], np.cumsum(widths)]))
    return known


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """Greedy LZW, with a clear code whenever the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    get, add, free = table.get, codes.append, end + 1
    prefix, rest = data[0] if data else -1, iter(data)
    next(rest, None)
    for byte in rest:
        key = prefix << 8 | byte
        found = get(key)
        if found is not None:
            prefix = found
            continue
        add(prefix)
        prefix = byte
        if free < MOST_CODES:
            table[key] = free
            free += 1
        else:
            runs.append(codes)
            codes = []
            table.clear()
            add, free = codes.append, end + 1
    if prefix >= 0:
        add(prefix)
    runs.append(codes)
    values, widths = [np.array([clear])], [np.array([size + 1])]
    for i, run in enumerate(runs):
        run = np.array([*run, clear if i + 1 < len(runs) else end], np.int64)
        values.append(run)
        widths.append(code_widths(size, len(run))[0][: len(run)])
    return pack_bits(np.concatenate(values), np.concatenate(widths))


def pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes least bit first: each code's bits, moved to their place, are added to the bytes they touch."""
    ends = np.cumsum(widths)
    at = ends - widths
    moved = values << (at & 7)
    first, size = at >> 3, (int(ends[-1]) + 7 >> 3) + 3
    total = np.zeros(size, np.int64)
    for k in range(3):
        total += np.bincount(first + k, weights=moved >> 8 * k & 255, minlength=size).astype(np.int64)[:size]
    return total[: int(ends[-1]) + 7 >> 3].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, size: int, expected: int) -> np.ndarray:
    """Up to `expected` bytes of a code stream."""
    if not 1 <= size <= 11:
        raise ValueError(f"code size {size}")
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total_bits, at, parts, got = 8 * len(stream), 0, [], 0
    while got < expected and at < total_bits:
        widths, offsets = code_widths(size, 4400)
        count = int(np.searchsorted(offsets, total_bits - at, "right")) - 1
        count = min(count, 4200)
        if count <= 0:
            break
        places = at + offsets[:count]
        byte = places >> 3
        window = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = window >> (places & 7) & ((1 << widths[:count]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else count
        if not len(stop) and count == 4200:  # a full table that is kept: widths stay at 12
            more = np.arange((total_bits - at - int(offsets[count])) // 12)
            far = at + int(offsets[count]) + 12 * more
            b = far >> 3
            rest = (raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (far & 7) & 4095
            codes = np.concatenate([codes, rest])
            stop = np.flatnonzero((codes == clear) | (codes == end))
            n = int(stop[0]) if len(stop) else len(codes)
        out = copies(codes[:n], size)
        parts.append(out)
        got += len(out)
        used = n + 1 if len(stop) else n
        at += int(offsets[used]) if used <= 4200 else int(offsets[4200]) + 12 * (used - 4200)
        if not len(stop) or codes[n] == end:
            break
    return np.concatenate(parts)[:expected] if parts else np.zeros(0, np.uint8)


def copies(codes: np.ndarray, size: int) -> np.ndarray:
    """The bytes of codes between two clears. Entry e was made by code e - first and the byte after its text."""
    n, first = len(codes), (1 << size) + 2
    if not n:
        return np.zeros(0, np.uint8)
    source = codes - first  # the code that is copied, if not below zero
    if (source >= np.minimum(np.arange(n), MOST_CODES - first)).any() or (codes[0] >= 1 << size):
        raise ValueError("code beyond the table")
    jump = np.where(source >= 0, source, np.arange(n))
    length = (source >= 0).astype(np.int64)
    while True:  # length: steps down to a plain byte, by doubling
        further = jump[jump]
        if (further == jump).all():
            break
        length, jump = length + length[jump], further
    length += 1
    begin = np.cumsum(length) - length
    shift = np.where(source >= 0, begin - begin[np.maximum(source, 0)], 0)
    pull = np.arange(length.sum(), dtype=np.int32) - np.repeat(shift.astype(np.int32), length)
    while True:
        further = pull[pull]
        if (further == pull).all():
            break
        pull = further
    plain = np.zeros(len(pull), np.uint8)
    literal = source < 0
    plain[begin[literal]] = codes[literal]
    return plain[pull]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part := data[i : i + 255])]) + part for i in range(0, len(data), 255)) + b"\0"


def encode_gif(samples: bytes, delay: int = DELAY) -> bytes:
    """Samples, a multiple of WIDTH bytes, as frames of at most FRAME_ROWS rows. What is cleared reads as zero, so zeros
    are drawn as the transparent CLEAR, unless that is a sample too."""
    height = len(samples) // WIDTH
    palette = bytes(v for c in range(256) for v in (c, c, c))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(height, FRAME_ROWS), 0xF7, 0, 0), palette]
    through = CLEAR not in samples
    for top in range(0, height, FRAME_ROWS):
        part = samples[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        rows = len(part) // WIDTH
        if through:
            part = part.replace(b"\0", bytes([CLEAR]))
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2 | through, delay, CLEAR if through else 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, rows, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b";"])


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("sub-block beyond the end")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def decode_gif(data: bytes) -> Iterator[dict]:
    """Frames as shown: index samples and palette of the frame itself, its height, the composed picture (RGBA, valid until
    the next frame is asked for), start and delay in 1/100 s. Broken data raise ValueError."""
    try:
        yield from _frames(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"cut off: {e}") from None


def _frames(data: bytes) -> Iterator[dict]:
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    if width * height > MOST_PIXELS:
        raise ValueError(f"a canvas of {width} x {height}")
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, clear_index, clock = 0, 0, -1, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _read_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = control >> 2 & 7, index if control & 1 else -1
            continue
        if data[at] != 0x2C:
            raise ValueError(f"block {data[at]:#x}")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        if w * h > MOST_PIXELS:
            raise ValueError(f"a frame of {w} x {h}")
        at, palette = at + 10, shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
        if palette is None:
            raise ValueError("no palette")
        stream, next_at = _read_blocks(data, at + 1)
        samples = lzw_decode(stream, data[at], w * h)
        if len(samples) < w * h:
            raise ValueError("too few samples")
        samples, at = samples.reshape(h, w), next_at
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            rows = np.empty_like(samples)
            rows[order] = samples
            samples = rows
        before = canvas.copy() if disposal == 3 else None
        window = canvas[top : top + h, left : left + w]
        shown = samples[: window.shape[0], : window.shape[1]]
        colours = np.full((256, 4), 255, np.uint8)
        colours[: len(palette), :3] = palette
        colours[len(palette) :, :3] = palette[-1]
        if clear_index < 0:
            window[:] = colours[shown]
        else:
            np.copyto(window, colours[shown], where=(shown != clear_index)[..., None])
        yield {"samples": samples, "palette": palette, "rows": h, "picture": canvas, "start": clock, "delay": delay}
        clock += delay
        if disposal == 2:
            window[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear_index = 0, 0, -1


def histogram(picture: np.ndarray) -> np.ndarray:
    """64 counts: pixels that show by the two upper bits of red, green and blue."""
    red, green, blue, alpha = (picture[..., k] for k in range(4))
    bins = (red >> 6 << 4 | green >> 6 << 2 | blue >> 6)[alpha > 0]
    return np.bincount(bins, minlength=64)


def frames(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """(id, frame, start_cs, delay_cs, width, height, colours array<long>): one row a frame; a null frame number
    marks media that is null or no GIF."""
    kind = media.schema[id_column].dataType.simpleString()
    names = ["id", "frame", "start_cs", "delay_cs", "width", "height", "colours"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, data in zip(rows.iloc[:, 0], rows.iloc[:, 1]):
                try:
                    shown = [(k, f["start"], f["delay"], f["picture"].shape[1], f["picture"].shape[0], histogram(f["picture"]).tolist()) for k, f in enumerate(decode_gif(data or b""))]
                except ValueError:
                    shown = []
                out += [(key, *f) for f in shown] or [(key, None, None, None, None, None, None)]
            table = pd.DataFrame(out, columns=names)
            yield table.astype({c: "Int64" for c in names[1:6]})

    schema = f"id {kind}, frame long, start_cs long, delay_cs long, width long, height long, colours array<long>"
    return media.select(id_column, media_column).mapInPandas(run, schema)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of UNIT, as GIF."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [encode(t) for t in rows["text"]]
            media = [encode_gif(t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT), b"\0")) for t in texts]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_bytes": [len(t) for t in texts], "media": media})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digest columns of stored media, all computed from the media bytes and the pictures they show. The payload is the
    red of a picture's rows as far as the frame reaches, frame after frame; colours: the frames' histograms together;
    feature: those of its bins that greys fall in, dark to bright."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, n_frames long, duration_cs long, colours array<long>"
    )

    def digests(data: bytes | None) -> tuple:
        payload, colours, count, end = [], np.zeros(64, np.int64), 0, 0
        try:
            for f in decode_gif(data or b""):
                payload.append(f["picture"][: f["rows"], :, 0].tobytes())
                colours += histogram(f["picture"])
                count, end = count + 1, f["start"] + f["delay"]
        except ValueError:
            return (None,) * 9
        whole = b"".join(payload)
        feature = ",".join(map(str, colours[[0, 21, 42, 63]].tolist()))
        return len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, count, end, colours.tolist()

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(key, n, *digests(data)) for key, n, data in zip(rows["doc_id"], rows["n_bytes"], rows["media"])]
            table = pd.DataFrame(out, columns=names)
            yield table.astype(dict.fromkeys(["payload_bytes", "tail_crc32", "media_bytes", "n_frames", "duration_cs"], "Int64"))

    return stored.select("doc_id", "n_bytes", "media").mapInPandas(run, schema)
