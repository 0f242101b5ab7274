"""GIF streams, payload round trips, media columns."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxspark.llm import gif, media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_payload_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload[: len(raw)] == raw
    assert gif.samples_of(gif.decode(gif.encode(payload))) == payload


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=4000))
def test_growing_width_streams(samples):
    for bits in (3, 8):
        assert gif.lzw_decode(gif.lzw_encode(bytes(samples), bits), bits, len(samples)).tobytes() == bytes(samples)


def test_long_streams_fill_and_reset_the_table():
    r = random.Random(1)
    for alphabet in (2, 5, 256):
        s = bytes(r.randrange(alphabet) for _ in range(60_000))
        assert gif.lzw_decode(gif.lzw_encode(s), 8, len(s)).tobytes() == s


def test_several_frames():
    payload = bytes(range(256)) * 8
    image = gif.decode(gif.encode(payload, max_rows=5, delay_ms=70))
    assert len(image.frames) == 7 and {f.delay_ms for f in image.frames} == {70}
    assert gif.samples_of(image) == payload


def picture(frames, width=4, height=4, interlaced=False):
    """A small colour GIF: frames are (indices, left, top, w, h, disposal, transparent)."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x81, 0, 0), palette]
    for indices, left, top, w, h, disposal, transparent in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), 5, transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 if interlaced else 0) + b"\x02" + gif._blocks(gif.lzw_encode(bytes(indices), 2)))
    return b"".join(out) + b"\x3b"


def test_disposal_and_transparency():
    data = picture([([1] * 16, 0, 0, 4, 4, 1, None), ([2, 0, 0, 2], 1, 1, 2, 2, 2, 0), ([3], 0, 0, 1, 1, 3, None), ([2], 3, 3, 1, 1, 0, None)])
    shown = [c for _, c in gif.composed(gif.decode(data))]
    assert (shown[0][..., 0] == 255).all()
    assert shown[1][1, 1].tolist() == [0, 255, 0, 255] and shown[1][1, 2].tolist() == [255, 0, 0, 255]
    assert shown[2][1, 1].tolist() == [0, 0, 0, 0] and shown[2][0, 0].tolist() == [0, 0, 255, 255]
    assert shown[3][0, 0].tolist() == [255, 0, 0, 255] and shown[3][3, 3].tolist() == [0, 255, 0, 255]
    assert sum(gif.histogram(shown[0])) == 16


def test_interlaced_rows():
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7]  # the stored order of nine rows
    data = picture([([r % 4 for r in rows for _ in range(2)], 0, 0, 2, 9, 0, None)], 2, 9, interlaced=True)
    assert gif.decode(data).frames[0].indices[:, 0].tolist() == [r % 4 for r in range(9)]


def test_unreadable_media(spark):
    df = spark.createDataFrame([(1, b"no"), (2, None), (3, picture([([1] * 16, 0, 0, 4, 4, 0, None)])), (4, picture([([1] * 16, 0, 0, 4, 4, 0, None)])[:30])], "k long, media binary")
    got = {r.k: r for r in media.gif_columns(df, keep=("k",)).collect()}
    assert got[3].error is None and got[3].frames[0].width == 4
    assert all(got[k].error and not got[k].frames for k in (1, 2, 4))


def test_query_rows(spark, tmp_path):
    texts = ["", None, "a" * 64, "é", "x" * 70_000, "same", "same"]
    spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in media.op8_media_gif(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert tuple(got[5])[1:] == tuple(got[6])[1:]


def test_empty_table(spark):
    assert media.text_to_gif(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bad_codes_are_errors():
    with pytest.raises(gif.GifError):
        gif.lzw_decode((256 | 300 << 9).to_bytes(3, "little"), 8, 4)


def plain_decode(data, bits):
    """A reader that takes one bit after the other, by the rules of the format."""
    stream = [byte >> k & 1 for byte in data for k in range(8)]
    clear, at, out = 1 << bits, 0, b""
    table, width, last = {}, bits + 1, None
    while at + width <= len(stream):
        code = sum(stream[at + k] << k for k in range(width))
        at += width
        if code == clear:
            table, width, last = {k: bytes([k]) for k in range(clear)}, bits + 1, None
            continue
        if code == clear + 1:
            return out
        word = table[code] if code in table else last + last[:1]
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = last + word[:1]
            if len(table) + 2 == 1 << width and width < 12:
                width += 1
        out, last = out + word, word
    raise AssertionError("no end code")


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(2, 8))
def test_streams_are_those_of_a_plain_reader(raw, bits):
    samples = bytes(x & (1 << bits) - 1 for x in raw)
    assert plain_decode(gif.lzw_encode(samples, bits), bits) == samples


def test_table_fills_for_a_plain_reader():
    r = random.Random(5)
    samples = bytes(r.randrange(256) for _ in range(9000))
    assert plain_decode(gif.lzw_encode(samples), 8) == samples and len(gif.lzw_codes(samples)) > 2


def test_media_are_smaller_and_vary():
    payload = media.padded(b"the same few words again and again. " * 2000)
    stored = gif.encode(payload)
    assert len(stored) < len(payload) / 2
    image = gif.decode(stored)
    assert {f.disposal for f in image.frames} == {0, 1, 2, 3} and {f.transparent for f in image.frames} == {32}
    assert len({f.palette.tobytes() for f in image.frames}) == 2


def test_features_are_those_of_plain_pictures(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("ab c\u00e9") for _ in range(n)) for n in (3, 5000, 17_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in media.text_to_gif(df).collect():
        payload = media.padded(texts[row.doc_id].encode())
        shown = {}  # (x, y) -> colour
        assert len(row.frames) == -(-len(payload) // 4096)
        for k, frame in enumerate(row.frames):
            part = payload[4096 * k : 4096 * (k + 1)]
            clear = max(range(256), key=lambda b: (part.count(b), -b))  # noqa: B023
            before = dict(shown)
            for at, b in enumerate(part):
                if b != clear:
                    shown[at % 64, at // 64] = (b, 255 - abs(2 * b - 255), 255 - b) if k % 2 else (b, b, b)
            want = [0] * 64
            for red, green, blue in shown.values():
                want[red // 64 * 16 + green // 64 * 4 + blue // 64] += 1
            assert frame.histogram == want and (frame.width, frame.height, frame.delay_ms) == (64, len(part) // 64, 100)
            disposal = (k + 1) % 4
            if disposal == 2:
                for at in range(len(part)):
                    shown.pop((at % 64, at // 64), None)
            elif disposal == 3:
                shown = before


def test_runs_longer_than_the_table():
    # an encoder may go on with a full table and no clear code: the width stays twelve bits
    r = random.Random(6)
    samples, table, codes, word = bytes(r.randrange(200) for _ in range(12_000)), {bytes([k]): k for k in range(256)}, [], b""
    for b in samples:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        codes.append(table[word])
        if len(table) + 2 < 4096:
            table[word + bytes([b])] = len(table) + 2
        word = bytes([b])
    codes.append(table[word])
    acc = 256
    at = 9
    for k, code in enumerate([*codes, 257]):
        acc |= code << at
        at += min(12, max(9, (257 + k).bit_length()))
    stream = acc.to_bytes(-(-at // 8), "little")
    assert plain_decode(stream, 8) == samples
    assert gif.lzw_decode(stream, 8, len(samples)).tobytes() == samples


def test_files_that_claim_too_much():
    huge = b"GIF89a" + struct.pack("<HHBBB", 65_535, 65_535, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65_535, 65_535, 0) + b"\x08\x01\x00\x00\x3b"
    assert media.read_media(huge)[1:3] == (None, []) and "samples" in media.read_media(huge)[3]
    wide = b"GIF89a" + struct.pack("<HHBBB", 65_535, 65_535, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x08\x02\x00\x01\x00\x3b"
    assert "canvas" in media.read_media(wide)[3]
    many = b"GIF89a" + struct.pack("<HHBBB", 9, 9, 0, 0, 0) + (b"\x2c" + struct.pack("<HHHHB", 0, 0, 8000, 8000, 0) + b"\x08\x01\x00\x00") * 9 + b"\x3b"
    assert "samples" in media.read_media(many)[3]


def peak_mb(data, n):
    import tracemalloc

    tracemalloc.start()
    got = gif.lzw_decode(data, 8, n)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(got) == n
    return peak


def test_streams_that_unfold_beyond_their_claim():
    """A stream of one colour: a megabyte of codes would unfold to gigabytes."""
    codes = np.concatenate([[256, 7], 258 + np.arange(3837), np.full(600_000, 4095)]).astype(np.int64)
    width = np.where(np.arange(len(codes)) < 1, 9, 12)
    first = np.arange(len(codes)) - 1  # codes since the clear code
    for w, least in ((9, 0), (10, 512 - 258 + 1), (11, 1024 - 258 + 1), (12, 2048 - 258 + 1)):
        width[(first >= least) & (np.arange(len(codes)) > 0)] = w
    bits = ((codes[:, None] >> np.arange(12)) & 1).astype(np.uint8)
    stream = np.packbits(bits[np.arange(12)[None] < width[:, None]], bitorder="little").tobytes()
    assert len(stream) > 900_000
    for n in (1, 1000, 100_000):
        assert peak_mb(stream, n) < 100
        assert set(gif.lzw_decode(stream, 8, n).tolist()) == {7}
