import hashlib
import struct
import zlib

import numpy as np
import pytest

from gapline.llm import gif


def pad(data):
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def test_round_trip():
    rng = np.random.default_rng(1)
    alone = lambda f: f | {"picture": f["picture"].copy()}
    for data in (b"", b"a", b"ab" * 9000, rng.integers(0, 256, 30_000).astype(np.uint8).tobytes(), b"\0" * 200_000, "né ".encode() * 700_000):
        shown = [alone(f) for f in gif.decode_gif(gif.encode_gif(pad(data)))]
        assert b"".join(f["picture"][: f["rows"], :, 0].tobytes() for f in shown) == pad(data)
    assert len(shown) > 1 and shown[1]["start"] == gif.DELAY


def plain_lzw(codes_in, size):
    """A decoder kept as simple as can be, to hold the fast one against."""
    table, out, old = None, [], None
    for c in codes_in:
        if c == 1 << size:
            table, old = {i: bytes([i]) for i in range(1 << size)}, None
            free = (1 << size) + 2
        elif c == (1 << size) + 1:
            break
        else:
            text = table[c] if c in table else old + old[:1]
            if old is not None and free < 4096:
                table[free] = old + text[:1]
                free += 1
            out.append(text)
            old = text
    return b"".join(out)


def test_streams_of_other_writers():
    rng = np.random.default_rng(2)
    for size in (2, 4, 8):
        for n in (1, 5, 300, 6000):  # beyond a full table, without a clear code
            codes, entries = [1 << size], 0
            for k in range(n):
                top = (1 << size) if k == 0 else min((1 << size) + 2 + k, 4096)
                c = int(rng.integers(0, top))
                codes.append(c if c not in (1 << size, (1 << size) + 1) else 0)
            if n == 300:
                codes[150] = 1 << size
                codes[151:] = [c % (1 << size) for c in codes[151:]]
            codes.append((1 << size) + 1)
            bits, free, width = [], (1 << size) + 2, size + 1
            first = True
            for c in codes:
                bits += [c >> b & 1 for b in range(width)]
                if c == 1 << size:
                    free, width, first = (1 << size) + 2, size + 1, True
                elif first:
                    first = False
                else:
                    free += free < 4096
                    if free == 1 << width and width < 12:
                        width += 1
            stream = np.packbits(bits, bitorder="little").tobytes()
            want = plain_lzw(codes, size)
            assert gif.lzw_decode(stream, size, len(want)).tobytes() == want


def frame(samples, palette=None, left=0, top=0, control=None, interlaced=False):
    h, w = samples.shape
    if interlaced:
        order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
        samples = samples[order]
    out = b"" if control is None else b"\x21\xf9\x04" + struct.pack("<BHB", *control) + b"\0"
    flags = (0x40 if interlaced else 0) | (0 if palette is None else 0x81)
    out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (b"" if palette is None else palette)
    return out + b"\x08" + gif._blocks(gif.lzw_encode(samples.astype(np.uint8).tobytes()))


def test_palettes_disposal_transparency_interlace_and_times():
    red_green = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    head = b"GIF89a" + struct.pack("<HHBBB", 4, 9, 0x81, 0, 0) + red_green
    full = np.arange(36).reshape(9, 4) % 4
    dot = np.ones((1, 1), int)
    data = head + frame(full, control=(0, 7, 0), interlaced=True) + frame(np.array([[1, 2]]), left=1, top=1, control=(1 | 3 << 2, 5, 2))
    data += frame(dot, control=(2 << 2, 3, 0)) + frame(dot, palette=bytes(range(12)), left=3, control=(0, 0, 0)) + b";"
    a, b, c, d = (f | {"picture": f["picture"].copy()} for f in gif.decode_gif(data))
    assert (a["samples"] == full).all() and [f["start"] for f in (a, b, c, d)] == [0, 7, 12, 15]
    assert tuple(b["picture"][1, 1]) == (0, 255, 0, 255) and tuple(b["picture"][1, 2]) == tuple(a["picture"][1, 2])
    assert tuple(c["picture"][1, 1]) == tuple(a["picture"][1, 1]) and tuple(c["picture"][0, 0]) == (0, 255, 0, 255)
    assert tuple(d["picture"][0, 0]) == (0, 0, 0, 0) and tuple(d["picture"][0, 3]) == (3, 4, 5, 255)
    assert sum(gif.histogram(d["picture"])) == 35


def test_broken_data():
    whole = gif.encode_gif(b"a" * 64)
    for bad in (b"", b"GIF89a", b"PNG" + b"x" * 40, whole[:-60], *(whole[:n] for n in range(len(whole)))):
        with pytest.raises(ValueError):
            list(gif.decode_gif(bad))


def test_a_control_block_holds_for_one_frame():
    head = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6)
    one = frame(np.zeros((1, 1), int), control=(2 << 2, 9, 0)) + frame(np.ones((1, 1), int))
    assert [f["delay"] for f in gif.decode_gif(head + one + b";")] == [9, 0]


def plain_gif(data):
    """The payload, frames and grey histogram of a GIF as ``encode_gif`` writes it: one byte and one bit at a time."""
    at, payload, frames, end = 13 + 3 * 256, [], 0, 0
    width, height = struct.unpack("<HH", data[6:10])
    canvas = [None] * (width * height)
    greys = [0] * 4
    while data[at] != 0x3B:
        assert data[at : at + 3] == b"\x21\xf9\x04"
        control, delay, clear = struct.unpack("<BHB", data[at + 3 : at + 7])
        _, _, w, h, flags, size = struct.unpack("<HHHHBB", data[at + 9 : at + 19])
        assert data[at + 8] == 0x2C and flags == 0
        at, stream = at + 19, b""
        while data[at]:
            stream, at = stream + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        bits = "".join(f"{b:08b}"[::-1] for b in stream)
        codes, place, wide, free, first = [], 0, size + 1, (1 << size) + 2, True
        while not codes or codes[-1] != (1 << size) + 1:
            codes.append(int(bits[place : place + wide][::-1], 2))
            place += wide
            if codes[-1] == 1 << size:
                wide, free, first = size + 1, (1 << size) + 2, True
            elif first:
                first = False
            else:
                free += free < 4096
                wide += free == 1 << wide and wide < 12
        for k, c in enumerate(plain_lzw(codes, size)):
            if not (control & 1 and c == clear):
                canvas[k] = c
        for c in canvas:
            if c is not None:
                greys[c >> 6] += 1
        payload += [c or 0 for c in canvas[: w * h]]
        if control >> 2 & 7 == 2:
            canvas = [None] * (width * height)
        frames, end = frames + 1, end + delay
    return bytes(payload), ",".join(map(str, greys)), frames, end


def test_digests_against_a_plain_reader(spark):
    texts = ["abc", None, "", "né\0\0x", "x" * 64, "Ab c, " * 7000, "\n\x7f漢字" * 300]
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes int")
    stored = gif.store(docs)
    media = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    rows = {r["doc_id"]: r for r in gif.read_back(stored).collect()}
    for i, text in enumerate(texts):
        raw, r = (text or "").encode(), rows[i]
        payload, feature, frames, end = plain_gif(media[i])
        assert payload == pad(raw) and r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(media[i]) and r["media_sha256"] == hashlib.sha256(media[i]).hexdigest()
        assert r["feature"] == feature and (r["n_frames"], r["duration_cs"]) == (frames, end)
        assert len(r["colours"]) == 64 and sum(r["colours"]) == sum(map(int, feature.split(",")))
    assert rows[5]["n_frames"] == 3


def test_columns(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (2, ""), (None, "né"), (5, "x" * 64)], "doc_id long, text string")
    stored = gif.store(docs)
    rows = gif.read_back(stored).collect()
    assert sorted((r["n_bytes"], r["payload_bytes"]) for r in rows) == [(0, 64), (0, 64), (3, 64), (3, 64), (64, 64)]
    assert gif.frames(stored).filter("frame = 0 and width = 64").count() == 5
    broken = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"zz")), (3, 3, gif.encode_gif(b"a" * 64)), (4, 3, gif.encode_gif(b"a" * 64)[:-9])], "doc_id long, n_bytes long, media binary")
    assert gif.frames(broken).filter("frame is null").count() == 3
    read = {r["doc_id"]: r for r in gif.read_back(broken).collect()}
    assert read[3]["payload_bytes"] == 64 and all(read[i]["payload_bytes"] is None and read[i]["colours"] is None for i in (1, 2, 4))
    assert gif.read_back(stored.limit(0)).count() == 0


def test_a_huge_canvas_is_refused():
    data = b"GIF89a" + (65535).to_bytes(2, "little") * 2 + b"\x00\x00\x00;"
    with pytest.raises(ValueError, match="canvas"):
        list(gif.decode_gif(data))
