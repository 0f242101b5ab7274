"""GIF89a: LZW code streams, palettes, disposal and transparency, timed frames.

``decode`` reads any GIF (interlaced or not, local palettes, all disposal methods);
``encode`` stores 8-bit samples losslessly as palette indices of one or more frames, in LZW streams of
growing code width.  A code's width depends only on how many codes came since the last clear code, so
whole runs of codes are packed and cut out by numpy; the code table itself goes code by code.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass, field

import numpy as np

#: Samples are stored in rows of this width; payloads are padded to a multiple of it.
WIDTH = 64
#: Rows of a frame of ``encode``.
ROWS = 64
#: Codes of the table at most, and bits of a code.
CODES, CODE_BITS = 4096, 12
#: Samples that a foreign file may claim in all, and pixels of its canvas: more are refused before memory is taken.
MAX_SAMPLES, MAX_CANVAS = 1 << 26, 1 << 24
GRAY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
#: The local palette of every second frame: a ramp from blue to red, green in the middle.
RAMP = np.stack([np.arange(256), 255 - np.abs(2 * np.arange(256) - 255), 255 - np.arange(256)], axis=1).astype(np.uint8)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray  # uint8, rows x columns
    palette: np.ndarray  # uint8, colours x 3
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


class GifError(ValueError):
    """The bytes are not a readable GIF."""


# --- LZW --------------------------------------------------------------------------------------


@functools.lru_cache(8)
def _widths(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The width of the k-th code after a clear code, and the bits before it.

    Before code k the reader has (1 << bits) + 1 + k entries, and the next number must fit.
    """
    k = np.arange(CODES + 2)
    entries = (1 << bits) + 1 + k
    width = np.minimum(np.maximum(np.frexp(entries.astype(float))[1], bits + 1), CODE_BITS)
    width[0] = bits + 1
    return width, np.concatenate([[0], np.cumsum(width)[:-1]])


def lzw_codes(samples: bytes, bits: int = 8) -> list[list[int]]:
    """The codes of the samples, in runs that a clear code parts."""
    if not samples:
        return [[]]
    first = (1 << bits) + 2
    runs, out, table, number = [], [], {}, first
    get, rest = table.get, iter(samples)
    prefix = next(rest)
    for s in rest:
        key = prefix << 8 | s
        code = get(key)
        if code is not None:
            prefix = code
            continue
        out.append(prefix)
        prefix = s
        if number < CODES:
            table[key] = number
            number += 1
        else:
            runs.append(out)
            out, table, number = [], {}, first
            get = table.get
    out.append(prefix)
    return [*runs, out]


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """An LZW stream: a clear code before every run, the end code behind the last."""
    clear = 1 << bits
    width, before = _widths(bits)
    runs = lzw_codes(samples, bits)
    codes, places, at = [clear], [0], bits + 1
    parts = [(np.array(codes), np.array(places))]
    for k, run in enumerate(runs):
        run.append(clear if k < len(runs) - 1 else clear + 1)
        parts.append((np.array(run), at + before[: len(run)]))
        at += int(before[len(run) - 1] + width[len(run) - 1])
    code, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    value = code << (place & 7)  # of 19 bits: three bytes, no two codes share a bit
    size = (at + 7) // 8 + 2
    out = sum(np.bincount((place >> 3) + k, weights=(value >> 8 * k) & 255, minlength=size) for k in range(3))
    return out[: size - 2].astype(np.uint8).tobytes()


def _expanded(codes: np.ndarray, clear: int, room: int) -> np.ndarray:
    """The samples of a run of codes, of those codes only that begin within ``room`` samples.

    The k-th code adds the entry that is its own string and the next sample: entry k lies in the output
    where code k begins.  So a code's length is that of the code it points to and one, and each of its
    samples is a copy of an earlier one; both are followed by doubling, not code by code.
    """
    n = len(codes)
    own = np.arange(n)
    entry = codes - clear - 2
    literal = codes < clear
    if not (literal | ((entry >= 0) & (entry < own))).all():
        raise GifError("a code is beyond the table")
    up = np.where(literal, own, entry)
    length, at = (~literal).astype(np.int64), up
    while True:
        more = length[at]
        if not more.any():
            break
        length += more
        at = at[at]
    length += 1
    ends = np.cumsum(length)
    if ends[-1] > room:  # before memory is taken for what the other codes unfold to
        used = int(np.searchsorted(ends, room)) + 1
        codes, length, ends, up, literal = codes[:used], length[:used], ends[:used], up[:used], literal[:used]
    starts = ends - length
    # where each sample is copied from: itself for a literal
    source = np.arange(int(ends[-1])) + np.repeat(starts[up] - starts, length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    samples = np.zeros(len(source), np.uint8)
    samples[starts[literal]] = codes[literal]
    return samples[source]


def lzw_decode(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` samples of a code stream; short streams are filled with 0."""
    if not 2 <= bits <= 8:
        raise GifError(f"samples of {bits} bits")
    clear = 1 << bits
    width, before = _widths(bits)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    out, size, at, total = [], 0, 0, 8 * len(data)
    while size < n:
        codes, ended, k, held = [], True, 0, 0
        while True:  # a run may be longer than the table: its width stays
            place = at + (before if not k else np.arange(len(before)) * CODE_BITS)
            own = width if not k else np.full(len(before), CODE_BITS)
            fits = int(np.searchsorted(place + own, total, side="right"))
            place, own = place[:fits], own[:fits]
            first = place >> 3
            found = ((raw[first] | raw[first + 1] << 8 | raw[first + 2] << 16) >> (place & 7)) & ((1 << own) - 1)
            stops = np.flatnonzero((found == clear) | (found == clear + 1))
            if len(stops):
                stop = int(stops[0])
                codes.append(found[:stop])
                ended = bool(found[stop] == clear + 1)
                at = int(place[stop] + own[stop])
                break
            codes.append(found)
            held += fits
            if fits < len(before) or held >= n - size:
                break
            at, k = int(place[-1] + own[-1]), k + 1
        run = np.concatenate(codes)[: n - size]  # a code is a sample at least
        if len(run):
            out.append(_expanded(run, clear, n - size))
            size += len(out[-1])
        if ended:
            break
    got = np.concatenate(out)[:n] if out else np.zeros(0, np.uint8)
    return got if len(got) == n else np.concatenate([got, np.zeros(n - len(got), np.uint8)])


# --- container --------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    """Data cut into sub-blocks of at most 255 bytes, ended by an empty one."""
    whole = len(data) // 255
    out = np.empty((whole, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    # runs of full blocks are taken at once
    parts = []
    while True:
        if at >= len(data):
            raise GifError("a block is cut off")
        size = data[at]
        if size == 0:
            return b"".join(parts), at + 1
        if size == 255:
            heads = np.frombuffer(data, np.uint8)[at::256]
            full = int(np.argmax(heads != 255)) if (heads != 255).any() else len(heads)
            full = min(full, (len(data) - at) // 256)
            if full:
                run = np.frombuffer(data, np.uint8, full * 256, at).reshape(full, 256)
                parts.append(run[:, 1:].tobytes())
                at += full * 256
                continue
        if at + 1 + size > len(data):
            raise GifError("a block is cut off")
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size


def encode(samples: bytes, *, delay_ms: int = 100, max_rows: int = ROWS) -> bytes:
    """A GIF that holds ``samples`` (a positive multiple of 64 bytes) as palette indices, in order.

    Every frame has its most frequent sample transparent; frames take turns with the disposal methods
    and with the global grey palette and a local one of colours.
    """
    if not samples or len(samples) % WIDTH:
        raise GifError("samples must be a positive multiple of 64 bytes")
    rows = len(samples) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, max_rows), 0xF7, 0, 0), GRAY.tobytes()]
    for k, top in enumerate(range(0, rows, max_rows)):
        height = min(max_rows, rows - top)
        part = samples[top * WIDTH : (top + height) * WIDTH]
        common = int(np.bincount(np.frombuffer(part, np.uint8)).argmax())
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", (k + 1) % 4 << 2 | 1, delay_ms // 10, common) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, height, 0x87 if k % 2 else 0) + (RAMP.tobytes() if k % 2 else b"") + b"\x08")
        out.append(_blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def decode(data: bytes, max_samples: int | None = MAX_SAMPLES) -> Gif:
    """All frames of a GIF, as stored (before composition); ``max_samples``: of all frames, None for files of one's own."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, palette, gif, claimed = 13, GRAY, Gif(width, height), 0
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
        at += n * 3
    delay, disposal, transparent = 0, 0, None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return gif
        if kind == 0x21:
            label = data[at + 1]
            body, at = _read_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                bits, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = hundredths * 10, bits >> 2 & 7, index if bits & 1 else None
        elif kind == 0x2C:
            left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = palette
            if bits & 0x80:
                n = 2 << (bits & 7)
                own = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
                at += n * 3
            claimed += w * h
            if max_samples is not None and claimed > max_samples:
                raise GifError(f"frames of more than {max_samples} samples")
            code_bits = data[at]
            body, at = _read_blocks(data, at + 1)
            indices = lzw_decode(body, code_bits, w * h).reshape(h, w)
            if bits & 0x40:
                order = np.concatenate([np.arange(s, h, step) for s, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(indices)
                straight[order] = indices
                indices = straight
            gif.frames.append(Frame(left, top, w, h, indices, own, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise GifError(f"unknown block {kind:#x}")
    raise GifError("no trailer")


def samples_of(gif: Gif) -> bytes:
    """The stored samples of all frames, in order."""
    return b"".join(f.indices.tobytes() for f in gif.frames)


def composed(gif: Gif):
    """Yields (delay_ms, RGBA canvas) of each frame, with disposal and transparency applied."""
    height, width = max([gif.height, *(f.top + f.height for f in gif.frames)]), max([gif.width, *(f.left + f.width for f in gif.frames)])
    if height * width > MAX_CANVAS:
        raise GifError(f"a canvas of {width} x {height}")
    canvas = np.zeros((height, width), np.uint32)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        colours = np.zeros(256, np.uint32)
        own = f.palette.astype(np.uint32)
        colours[: len(own)] = own[:, 0] | own[:, 1] << 8 | own[:, 2] << 16 | 255 << 24
        colours[len(own) :] = colours[len(own) - 1]
        new = colours[f.indices]
        if f.transparent is not None:
            new = np.where(f.indices == f.transparent, area, new)
        area[...] = new
        yield f.delay_ms, canvas.astype("<u4").view(np.uint8).reshape(height, width, 4)
        if f.disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> list[int]:
    """Opaque pixels by colour: 4 x 4 x 4 bins of red, green, blue."""
    p = np.ascontiguousarray(canvas).view("<u4").ravel()
    p = p[p >= 1 << 24]
    return np.bincount(p >> 2 & 48 | p >> 12 & 12 | p >> 22 & 3, minlength=64).tolist()
