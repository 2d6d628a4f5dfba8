"""FLAC streams of 8-bit mono samples: encoding, and decoding of Rice residuals and linear predictors.

Bytes are samples with 128 subtracted. Blocks have a fixed size of 192 samples; a seek table names the sample and byte
offset of every SEEK_FRAMES-th frame. All steps work on many frames at once: the encoder on all frames of a chunk, the
decoder on one lane for each seek point, so that neither has a Python step per sample, and chunks bound the memory
whatever the length of a text. The decoder verifies the CRC-8 of every frame header, the CRC-16 of every frame, frame
numbers, offsets and the MD5 of the samples, and raises FlacError where one fails.

Defined results. Null and empty texts are one block of spaces. Rows with null identifier are stored like others; repeated
rows give equal rows. An identifier that is no number becomes null. An empty table gives an empty result. `decode_all` reads streams
of this kind: mono, 8 bits, blocks of 192 samples, one Rice partition, with a seek table; it refuses others.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import remove, written

BLOCK = 192
SEEK_FRAMES = 4
RATE = 8000
#: Order and coefficient bits of the encoder's own linear predictor; the decoder takes any.
LPC_ORDER, LPC_BITS = 4, 10
#: Frames coded, and lanes decoded, at a time.
CHUNK_FRAMES, CHUNK_LANES = 8192, 4096
#: Bytes of text from which a group of rows is worked off.
GROUP_BYTES = 1 << 20
#: Waves in which the query stores and reads streams: they take up that part of the streams' whole size at a time.
WAVES = 2

# Fixed values of the format: sync code, subframe types, fixed predictors.
SYNC = 0xFFF8
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32
FIXED_COEFFICIENTS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    pass


def _crc_table(polynomial: int, width: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        table = np.where(table >> (width - 1) & 1, table << 1 ^ polynomial, table << 1) & ((1 << width) - 1)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """CRCs of data[start : start + length], all ranges side by side."""
    crc = np.zeros(len(start), np.int64)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = len(start)
    mask = (1 << width) - 1
    for j in range(int(length[0]) if len(length) else 0):
        while length[active - 1] <= j:
            active -= 1
        c = crc[:active]
        crc[:active] = (c << 8 & mask) ^ table[(c >> (width - 8)) ^ data[start[:active] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 of the format: (rows of 6 bytes, lengths)."""
    out = np.zeros((len(numbers), 6), np.int64)
    size = np.ones(len(numbers), np.int64)
    for extra, least in enumerate((0x80, 0x800, 0x10000, 0x200000, 0x4000000), 2):
        size[numbers >= least] = extra
    for k in range(1, 7):
        at = size == k
        if at.any():
            n = numbers[at]
            lead = (0, 0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC)[k]
            out[at, 0] = lead | n >> 6 * (k - 1)
            for j in range(1, k):
                out[at, j] = 0x80 | (n >> 6 * (k - 1 - j) & 0x3F)
    return out, size


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients by Levinson-Durbin, their shifts, and where they are usable; a row per frame."""
    f = x.astype(np.float64)
    auto = np.stack([(f[:, k:] * f[:, : f.shape[1] - k]).sum(1) for k in range(LPC_ORDER + 1)], 1)
    good = auto[:, 0] > 0
    error = np.where(good, auto[:, 0], 1.0)
    a = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        r = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= r[:, None] * a[:, :i][:, ::-1]
        a[:, i] = r
        error = np.maximum(error * (1 - r * r), 1e-9)
    largest = np.abs(a).max(1)
    shift = np.clip(LPC_BITS - 2 - np.ceil(np.log2(np.maximum(largest, 1e-9))), 0, 15).astype(np.int64)
    c = np.rint(a * (1 << shift)[:, None]).astype(np.int64)
    bound = 1 << (LPC_BITS - 1)
    return c, shift, good & (c < bound).all(1) & (c >= -bound).all(1)


def _residual(x: np.ndarray, order: int, c, shift) -> np.ndarray:
    n = x.shape[1]
    guess = sum(np.asarray(c[k])[..., None] * x[:, order - 1 - k : n - 1 - k] for k in range(order)) if order else 0
    return x[:, order:] - (guess >> shift if order else 0)


def _zigzag(r: np.ndarray) -> np.ndarray:
    return r << 1 ^ r >> 31


class _Bits:
    """A field of bits, filled by position."""

    def __init__(self, size: int):
        self.bits = np.zeros(size * 8, np.uint8)

    def put(self, at: np.ndarray, width: int, value) -> np.ndarray:
        value = np.broadcast_to(np.asarray(value, np.int64), at.shape)
        for j in range(width):
            self.bits[at + j] = value >> (width - 1 - j) & 1
        return at + width


def encode_frames(blocks: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of the rows of `blocks` (samples, BLOCK each) one after the other, and their lengths in bytes."""
    x = blocks.astype(np.int32)
    count = len(x)
    c, shift, usable = _lpc(x)
    tried = [_zigzag(_residual(x, o, FIXED_COEFFICIENTS[o], 0)) for o in range(3)]
    tried.append(_zigzag(_residual(x, LPC_ORDER, c.T.astype(np.int32), shift[:, None].astype(np.int32))))
    orders = np.array([0, 1, 2, LPC_ORDER])
    extra = np.array([0, 8, 16, 8 * LPC_ORDER + 9 + LPC_BITS * LPC_ORDER])
    best_bits, best, best_k = np.full(count, 1 << 40), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for t, u in enumerate(tried):
        total = u.sum(1, dtype=np.int64)
        near = np.floor(np.log2(np.maximum(total / u.shape[1], 1))).astype(np.int64)
        for k in (near, np.maximum(near - 1, 0)):
            cost = extra[t] + u.shape[1] * (1 + k) + (u >> k[:, None].astype(np.int32)).sum(1, dtype=np.int64)
            better = (cost < best_bits) & (usable if t == 3 else True) & (k < 15)
            best_bits[better], best[better], best_k[better] = cost[better], t, k[better]
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (best_bits + 10 >= 8 * BLOCK)
    body = np.where(constant, 8, np.where(verbatim, 8 * BLOCK, best_bits + 10))

    coded, coded_size = _coded_numbers(numbers)
    head_size = 5 + coded_size
    frame_size = head_size + 1 + -(-body // 8) + 2
    start = np.concatenate([[0], np.cumsum(frame_size)[:-1]])
    out = _Bits(int(frame_size.sum()))

    head = np.concatenate([np.tile([SYNC >> 8, SYNC & 255, 0x14, 0x02], (count, 1)), coded], 1).astype(np.uint8)
    crc8 = _crc(head.reshape(-1), np.arange(count) * head.shape[1], 4 + coded_size, CRC8, 8)
    for j in range(head.shape[1]):
        has = j < 4 + coded_size
        out.put(8 * (start[has] + j), 8, head[has, j])
    out.put(8 * (start + 4 + coded_size), 8, crc8)
    kind = np.where(constant, CONSTANT, np.where(verbatim, VERBATIM, np.where(best == 3, LPC + LPC_ORDER - 1, FIXED + orders[best])))
    at = out.put(8 * (start + head_size), 8, kind << 1)
    out.put(at[constant], 8, x[constant, 0] & 255)
    for j in range(BLOCK if verbatim.any() else 0):
        out.put(at[verbatim] + 8 * j, 8, x[verbatim, j] & 255)
    for t, u in enumerate(tried):
        rows = np.flatnonzero((best == t) & ~constant & ~verbatim)
        if not len(rows):
            continue
        pos = at[rows]
        for j in range(orders[t]):
            pos = out.put(pos, 8, x[rows, j] & 255)
        if t == 3:
            pos = out.put(pos, 4, LPC_BITS - 1)
            pos = out.put(pos, 5, shift[rows])
            for j in range(LPC_ORDER):
                pos = out.put(pos, LPC_BITS, c[rows, j] & ((1 << LPC_BITS) - 1))
        pos = out.put(pos, 6, 0)  # Rice method 0, one partition
        pos = out.put(pos, 4, best_k[rows])
        for k in np.unique(best_k[rows]):  # rows of one parameter at a time
            mine = best_k[rows] == k
            v = u[rows[mine]]
            size = (v >> k) + 1 + k
            ends = np.cumsum(size, 1) + pos[mine][:, None]
            out.bits[ends - k - 1] = 1
            for j in range(k):
                out.bits[ends - k + j] = v >> (k - 1 - j) & 1
    packed = np.packbits(out.bits)
    crc16 = _crc(packed, start, frame_size - 2, CRC16, 16)
    packed[start + frame_size - 2], packed[start + frame_size - 1] = crc16 >> 8, crc16 & 255
    return packed.tobytes(), frame_size


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; payloads are positive multiples of BLOCK long."""
    samples = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).astype(np.int8).reshape(-1, BLOCK)
    counts = np.array([len(p) // BLOCK for p in payloads])
    numbers = np.concatenate([np.arange(n) for n in counts])
    parts, sizes = [], []
    for i in range(0, len(samples), CHUNK_FRAMES):
        data, size = encode_frames(samples[i : i + CHUNK_FRAMES], numbers[i : i + CHUNK_FRAMES])
        parts.append(data)
        sizes.append(size)
    data, sizes = b"".join(parts), np.concatenate(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out, first = [], 0
    for n in counts:
        own = ends[first : first + n + 1]
        md5 = hashlib.md5(samples[first : first + n].tobytes()).digest()
        out.append(_metadata(int(n), sizes[first : first + n], own[:-1] - own[0], md5) + data[own[0] : own[-1]])
        first += n
    return out


def _metadata(frames: int, sizes: np.ndarray, offsets: np.ndarray, md5: bytes) -> bytes:
    packed = RATE << 44 | 0 << 41 | 7 << 36 | frames * BLOCK
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += packed.to_bytes(8, "big") + md5
    at = np.arange(0, frames, SEEK_FRAMES)
    points = np.zeros(len(at), [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
    points["sample"], points["offset"], points["samples"] = at * BLOCK, offsets[at], BLOCK
    seek = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek


def _read_metadata(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Total samples, MD5, seek points and the place of the first frame."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, points, info = 4, False, None, b""
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = block
        elif kind == 3:
            points = np.frombuffer(block, [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        at += 4 + size
    if len(info) != 34 or points is None:
        raise FlacError("stream information or seek table missing")
    packed = int.from_bytes(info[10:18], "big")
    if struct.unpack(">HH", info[:4]) != (BLOCK, BLOCK) or packed >> 41 & 7 != 0 or packed >> 36 & 31 != 7:
        raise FlacError("only mono streams of 8-bit samples in blocks of 192 are read")
    return packed & ((1 << 36) - 1), info[18:34], points, at


class _Reader:
    """Bit readers over one buffer, one for each lane."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    def _window(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more of every lane, at the top of 64."""
        byte = at >> 3
        word = self.data[byte].astype(np.uint64)
        for j in range(1, 8):
            word = word << np.uint64(8) | self.data[byte + j]
        return word << (at & 7).astype(np.uint64)

    def take(self, width: int) -> np.ndarray:
        out = (self._window(self.at) >> np.uint64(64 - width)).astype(np.int64)
        self.at = self.at + width
        return out


def _clz32(x: np.ndarray) -> np.ndarray:
    return 32 - np.frexp(x.astype(np.float64))[1]


def _rice(words: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One Rice code of every lane: (residuals, positions after). words[i]: 64 bits from byte i."""

    def window(pos):
        return words[pos >> 3] << (pos & 7).astype(np.uint64)

    top = window(at)
    high = (top >> np.uint64(32)).astype(np.int64)
    zeros = _clz32(high)
    if (long := zeros == 32).any():  # a run of zeros beyond the window
        lanes = np.flatnonzero(long)
        zeros = zeros.astype(np.int64)
        while len(lanes):
            more = _clz32((window(at[lanes] + zeros[lanes]) >> np.uint64(32)).astype(np.int64))
            zeros[lanes] += more
            lanes = lanes[more == 32]
    after = at + zeros + 1
    rest = window(after) >> (64 - k).astype(np.uint64)
    rest = np.where(k > 0, rest, 0).astype(np.int64)
    u = zeros << k | rest
    return u >> 1 ^ -(u & 1), after + k


def _signed(value: np.ndarray, width) -> np.ndarray:
    return value - ((value >> (width - 1) & 1) << width)


def _decode_round(data: np.ndarray, words: np.ndarray, byte: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One frame of every lane: (samples, byte positions after the frames)."""
    lanes = len(byte)
    want, want_size = _coded_numbers(number)
    fixed = data[byte[:, None] + np.arange(4)]
    if (fixed != np.array([SYNC >> 8, SYNC & 255, 0x14, 0x02])).any():
        raise FlacError("no frame header")
    got = data[byte[:, None] + 4 + np.arange(6)]
    if ((got != want) & (np.arange(6) < want_size[:, None])).any():
        raise FlacError("wrong frame number")
    if (_crc(data, byte, 4 + want_size, CRC8, 8) != data[byte + 4 + want_size]).any():
        raise FlacError("frame header checksum differs")
    reader = _Reader(data, 8 * (byte + 5 + want_size))
    kind = reader.take(8) >> 1
    at = reader.at
    out = np.zeros((BLOCK, lanes), np.int64)
    predicted = kind >= FIXED
    for rows, width in ((np.flatnonzero(kind == CONSTANT), 1), (np.flatnonzero(kind == VERBATIM), BLOCK)):
        if len(rows):
            part = _signed(data[(at[rows] >> 3)[:, None] + np.arange(width)].astype(np.int64), 8)
            out[:, rows] = part.T
            at[rows] += 8 * width
    for order in np.unique(np.where(kind >= LPC, kind - LPC + 1, kind - FIXED)[predicted]):
        for linear in (False, True):
            rows = np.flatnonzero(kind == (LPC + order - 1 if linear else FIXED + order))
            if not len(rows) or linear and not order or not linear and order > 4:
                continue
            r = _Reader(data, at[rows])
            for j in range(order):
                out[j, rows] = _signed(r.take(8), 8)
            if linear:
                width = r.take(4) + 1
                shift = _signed(r.take(5), 5)
                c = []
                for _ in range(order):
                    value = r._window(r.at) >> (64 - width).astype(np.uint64)
                    c.append(_signed(value.astype(np.int64), width))
                    r.at = r.at + width
            else:
                c, shift = [np.int64(v) for v in FIXED_COEFFICIENTS[order]], np.int64(0)
            if r.take(6).any():
                raise FlacError("only one Rice partition of method 0 is read")
            k, pos = r.take(4), None
            pos = r.at
            past = [out[order - 1 - j, rows] for j in range(order)]
            for i in range(order, BLOCK):
                value, pos = _rice(words, pos, k)
                if order:
                    guess = past[0] * c[0]
                    for j in range(1, order):
                        guess = guess + past[j] * c[j]
                    value = value + (guess >> shift)
                    past = [value, *past[:-1]]
                out[i, rows] = value
            at[rows] = pos
    after = -(-at // 8)
    crc = _crc(data, byte, after - byte, CRC16, 16)
    if (crc != (data[after].astype(np.int64) << 8 | data[after + 1])).any():
        raise FlacError("frame checksum differs")
    return out.T.astype(np.int8), after + 2


def decode_all(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, through its seek points; checks all checksums."""
    if not streams:
        return []
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    lanes, totals, sums = [], [], []
    base = 0
    for stream, begin in zip(streams, begins, strict=False):
        total, md5, points, first = _read_metadata(stream)
        frames = total // BLOCK
        number = points["sample"].astype(np.int64) // BLOCK
        offset = points["offset"].astype(np.int64) + begin + first
        end = np.append(offset[1:], begin + len(stream))
        lanes.append(np.stack([offset, number, np.append(number[1:], frames), np.full(len(number), base), end], 1))
        totals.append(frames)
        sums.append(md5)
        base += frames
    lanes = np.concatenate(lanes)
    out = np.empty((base, BLOCK), np.int8)
    for i in range(0, len(lanes), CHUNK_LANES):
        part = lanes[i : i + CHUNK_LANES]
        lo, hi = int(part[:, 0].min()), int(part[:, 4].max())
        own = np.concatenate([data[lo:hi], np.zeros(16, np.uint8)])
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, 8)).view(">u8").reshape(-1).astype(np.uint64)
        byte, number, stop, row, end = (part[:, j].copy() for j in range(5))
        byte -= lo
        while len(byte):
            samples, byte = _decode_round(own, words, byte, number)
            out[row + number] = samples
            number = number + 1
            more = number < stop
            if (byte[~more] + lo != end[~more]).any():
                raise FlacError("a seek point doesn't meet the frames before it")
            byte, number, stop, row, end = byte[more], number[more], stop[more], row[more], end[more]
    found, at = [], 0
    for frames, md5 in zip(totals, sums, strict=True):
        samples = out[at : at + frames]
        if hashlib.md5(samples.tobytes()).digest() != md5:
            raise FlacError("the samples' checksum differs")
        found.append((samples.astype(np.int16) + 128).astype(np.uint8).tobytes())
        at += frames
    return found


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, padded with spaces to a positive multiple of BLOCK, and their number before."""
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


def feature(samples: bytes) -> str:
    """Peak, mean square and zero crossings of the decoded samples, and the number of blocks."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x < 0)))
    return f"peak={int(np.abs(x).max())};square={int((x * x).sum()) // len(x)};crossings={crossings};blocks={len(x) // BLOCK}"


def _groups(batches: Iterator[pa.RecordBatch], size) -> Iterator[tuple[list, list]]:
    """(identifiers, values) of about GROUP_BYTES."""
    ids, values, held = [], [], 0
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            value = value.as_py()
            ids.append(key)
            values.append(value)
            held += size(value)
            if held >= GROUP_BYTES:
                yield ids, values
                ids, values, held = [], [], 0
    if ids:
        yield ids, values


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _groups(batches, lambda t: len(t or "") + BLOCK):
        made = [payload(t) for t in texts]
        columns = [pa.array(ids, pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array(encode_all([p for p, _ in made]), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stream of every text."""
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, streams in _groups(batches, len):
        for key, samples in zip(ids, decode_all(streams), strict=True):
            for lo in range(0, len(samples), 4096 * BLOCK):
                part = [samples[i : i + BLOCK] for i in range(lo, min(lo + 4096 * BLOCK, len(samples)), BLOCK)]
                offsets = np.arange(lo, lo + len(part) * BLOCK, BLOCK)
                columns = [pa.array([key] * len(part), pa.int64()), pa.array(offsets // BLOCK, pa.int64()), pa.array(offsets, pa.int64()), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "block", "sample_offset", "pcm"])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """The decoded samples of streams (doc_id, media) as unsigned 8-bit PCM blocks with their sample offsets."""
    return media.select("doc_id", "media").mapInArrow(_blocks, "doc_id long, block long, sample_offset long, pcm binary")


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string"
)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sized = (b.select(["key", "media"]) for b in _with_key(batches))
    for keys, streams in _groups(sized, len):
        back = decode_all(streams)
        columns = [
            pa.array([k["doc_id"] for k in keys], pa.int64()),
            pa.array([k["n_bytes"] for k in keys], pa.int64()),
            pa.array([len(b) for b in back], pa.int64()),
            pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
            pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
            pa.array([len(s) for s in streams], pa.int64()),
            pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()),
            pa.array([feature(b) for b in back], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGESTS.split(",")])


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = pa.StructArray.from_arrays([batch.column("doc_id"), batch.column("n_bytes")], names=["doc_id", "n_bytes"])
        yield pa.RecordBatch.from_arrays([key, batch.column("media")], names=["key", "media"])


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of stored streams (doc_id, n_bytes, media), which are decoded and verified."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_describe, DIGESTS)


def digests(docs: DataFrame, waves: int = WAVES) -> DataFrame:
    """Store every text as a stream in the shared folder, read the stored streams back and describe both. The streams are not
    kept: they are written, read and removed in waves, each of which holds the texts of one range of hashes."""
    wave = F.pmod(F.xxhash64("text"), F.lit(waves))
    parts = []
    for k in range(waves):
        media = written(encode(docs.filter(wave == k)), "flac-media", {"compression": "uncompressed"})
        parts.append(written(describe(media), "flac-digests"))
        remove(media)
    return reduce(DataFrame.unionByName, parts)
