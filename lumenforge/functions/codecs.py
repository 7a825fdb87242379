"""Byte codecs, each a pair of functions on bytes or numpy arrays, and a way to run them over a column in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame


# -- fixed-point deltas -----------------------------------------------------------------------------------------------


def delta_scale(least: float, most: float) -> int:
    """The whole number that takes the greatest magnitude just below 2**62; 1 if there is no finite one."""
    peak = max(abs(least), abs(most))
    return max(1, int(((1 << 62) - 1) // peak)) if 0.0 < peak < float("inf") else 1


def delta_encode(values: np.ndarray, scale: int | None = None) -> tuple[np.ndarray, int]:
    """First differences of 62-bit fixed-point values, halves to even, and the scale. The first is held against 0."""
    v = np.asarray(values, np.float64)
    if v.ndim != 1 or scale is not None and scale <= 0:
        raise ValueError("one dimension and a positive scale are needed")
    if not len(v):
        return np.zeros(0, np.int64), scale or 1
    scale = scale or delta_scale(float(v.min()), float(v.max()))
    with np.errstate(invalid="ignore", over="ignore"):
        return np.diff(np.rint(v * float(scale)).astype(np.int64), prepend=np.int64(0)), scale


def delta_decode(deltas: np.ndarray, scale: int) -> np.ndarray:
    if scale <= 0:
        raise ValueError("a positive scale is needed")
    return np.cumsum(np.asarray(deltas, np.int64)).astype(np.float64) / float(scale)


# -- variable-length integers -----------------------------------------------------------------------------------------


def varints(values: np.ndarray) -> bytes:
    """LEB128 of unsigned 64-bit values, all at once: one column of bytes a position, then those that count, in order."""
    v = np.asarray(values, np.uint64)
    places = (v[:, None] >> (np.uint64(7) * np.arange(10, dtype=np.uint64))).astype(np.uint64)
    size = np.maximum(1, (places != 0).sum(axis=1))
    out = (places & np.uint64(0x7F)).astype(np.uint8)
    at = np.arange(10)
    out[at < size[:, None] - 1] |= 0x80
    return out[at < size[:, None]].tobytes()


def unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 0x80)
    if len(raw) and (not len(last) or last[-1] != len(raw) - 1):
        raise ValueError("the last number is cut short")
    first = np.r_[0, last[:-1] + 1].astype(np.int64) if len(last) else np.zeros(0, np.int64)
    if len(last) and (last - first).max() > 9:
        raise ValueError("a number has over 64 bits")
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64))
    return np.bitwise_or.reduceat(parts, first) if len(first) else np.zeros(0, np.uint64)


def zigzag(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.int64)
    return ((v << np.int64(1)) ^ (v >> np.int64(63))).view(np.uint64)


def unzigzag(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.uint64)
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


# -- packed bases and qualities -------------------------------------------------------------------------------------------

BASES = b"ACGT"
_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(BASES, np.uint8)] = np.arange(4)


def pack_bases(seq: bytes) -> bytes:
    """Version 0, length, packed length and number of other bytes (u32 BE), two bits a base, first base highest, then
    position and byte of the others."""
    raw = np.frombuffer(seq, np.uint8)
    code = _CODE[raw]
    odd = np.flatnonzero(code == 255)
    code = np.where(code == 255, 0, code)
    quads = np.zeros(-(-len(raw) // 4) * 4, np.uint8)
    quads[: len(raw)] = code
    packed = quads.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    others = np.zeros(len(odd), np.dtype([("at", ">u4"), ("byte", "u1")]))
    others["at"], others["byte"] = odd, raw[odd]
    return struct.pack(">BIII", 0, len(raw), len(quads) // 4, len(odd)) + packed.astype(np.uint8).tobytes() + others.tobytes()


def unpack_bases(data: bytes) -> bytes:
    version, n, size, odd = struct.unpack_from(">BIII", data)
    if version or size != -(-n // 4) or len(data) != 13 + size + 5 * odd:
        raise ValueError("packed bases are cut short or too long")
    quads = np.frombuffer(data, np.uint8, size, 13)
    code = (quads[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    out = np.frombuffer(BASES, np.uint8)[code.ravel()[:n]]
    others = np.frombuffer(data, np.dtype([("at", ">u4"), ("byte", "u1")]), odd, 13 + size)
    if odd and (others["at"][-1] >= n or (np.diff(others["at"].astype(np.int64)) <= 0).any()):
        raise ValueError("positions don't ascend")
    out[others["at"]] = others["byte"]
    return out.tobytes()


# Upper bound and representative of each of the eight quality ranges.
QUALITY_BOUNDS = [1, 9, 19, 24, 29, 34, 39]
QUALITY_LEVELS = [0, 5, 15, 22, 27, 32, 37, 40]


def pack_qualities(q: bytes) -> bytes:
    """Version and scheme 0, length (u32 BE), then the index of the quality's range in four bits, first highest. Lossy."""
    level = np.searchsorted(QUALITY_BOUNDS, np.frombuffer(q, np.uint8)).astype(np.uint8)
    both = np.r_[level, np.zeros(len(level) % 2, np.uint8)].reshape(-1, 2)
    return struct.pack(">BBI", 0, 0, len(q)) + (both[:, 0] << 4 | both[:, 1]).astype(np.uint8).tobytes()


def unpack_qualities(data: bytes) -> bytes:
    version, scheme, n = struct.unpack_from(">BBI", data)
    raw = np.frombuffer(data, np.uint8, -1, 6)
    level = np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n]
    if version or scheme or len(level) != n or (level > 7).any():
        raise ValueError("packed qualities are cut short or malformed")
    return np.array(QUALITY_LEVELS, np.uint8)[level].tobytes()


# -- entropy coding ---------------------------------------------------------------------------------------------------

_TOTAL, _LOW = 4096, 1 << 23
#: Bytes of a padded block of rows that are coded side by side, and rows of one with a table for every context.
_CELLS, _ROWS, _ROWS_1 = 8 << 20, 4096, 16
#: Rows that still have bytes, up to which each is coded by itself.
_FEW = 24


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Each row of counts scaled to a sum of 4096, rounded down, symbols that occur 1 at least. What is lacking goes round in
    steps of one from the most frequent symbol on, what is too much from the rarest on; of equals the lower symbol first."""
    c = np.atleast_2d(np.asarray(counts, np.int64))
    total = c.sum(axis=1, keepdims=True)
    f = np.where(c > 0, np.maximum(1, c * _TOTAL // np.maximum(total, 1)), 0)
    gap = np.where(total[:, 0] > 0, _TOTAL - f.sum(axis=1), 0)
    for r in np.flatnonzero(gap):
        ranked = np.argsort(-c[r] if gap[r] > 0 else np.where(c[r] > 0, c[r], np.iinfo(np.int64).max), kind="stable")[: int((c[r] > 0).sum())]
        left = int(gap[r])
        if left > 0:
            f[r][ranked] += left // len(ranked)
            f[r][ranked[: left % len(ranked)]] += 1
        while left < 0:
            able = ranked[f[r][ranked] > 1][:-left]
            f[r][able] -= 1
            left += len(able)
    return f.reshape(np.shape(counts))


def _blocks(sizes: np.ndarray, rows: int):
    """Indices of rows in blocks of similar size, the longest first, so that padding is little."""
    order, i = np.argsort(-sizes, kind="stable"), 0
    while i < len(order):
        n = max(1, min(rows, _CELLS // max(1, int(sizes[order[i]]))))
        yield order[i : i + n]
        i += n


def _padded(rows: list[bytes], at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at), int(sizes[at[0]])), np.uint8)
    for i, k in enumerate(at):
        out[i, : sizes[k]] = np.frombuffer(rows[k], np.uint8)
    return out


def _context_counts(m: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """Counts of symbols by row, and by the symbol before in order 1 (0 before the first)."""
    live = np.arange(m.shape[1]) < n[:, None]
    row, col = np.nonzero(live)
    if not order:
        return np.bincount(row * 256 + m[row, col], minlength=len(m) * 256).reshape(len(m), 256)
    before = np.where(col > 0, m[row, np.maximum(col - 1, 0)], 0).astype(np.int64)
    return np.bincount((row * 256 + before) * 256 + m[row, col], minlength=len(m) * 65536).reshape(len(m) * 256, 256)


def _table(freq: np.ndarray, order: int) -> bytes:
    """Order 0: 256 frequencies (u32 BE). Order 1: for each context the number of its symbols (u16 BE), then symbol and
    frequency (u16 BE) of each."""
    if not order:
        return freq.astype(">u4").tobytes()
    out = []
    for row in freq.reshape(256, 256):
        at = np.flatnonzero(row)
        pairs = np.zeros(len(at), np.dtype([("symbol", "u1"), ("freq", ">u2")]))
        pairs["symbol"], pairs["freq"] = at, row[at]
        out.append(struct.pack(">H", len(at)) + pairs.tobytes())
    return b"".join(out)


def _read_table(data: bytes, order: int) -> tuple[np.ndarray, int]:
    """Frequencies of a stream and where its payload begins."""
    if not order:
        if len(data) < 1033:
            raise ValueError("the table of frequencies is cut short")
        return np.frombuffer(data, ">u4", 256, 9).astype(np.int64), 1033
    out, at = np.zeros((256, 256), np.int64), 9
    for context in range(256):
        if at + 2 > len(data):
            raise ValueError("the table of frequencies is cut short")
        (n,) = struct.unpack_from(">H", data, at)
        if n > 256 or at + 2 + 3 * n > len(data):
            raise ValueError("the table of frequencies is cut short")
        pairs = np.frombuffer(data, np.dtype([("symbol", "u1"), ("freq", ">u2")]), n, at + 2)
        out[context, pairs["symbol"]] = pairs["freq"]
        at += 2 + 3 * n
    return out, at


def _encode_tail(x: int, data: bytes, start: int, before: int, freq: list, first: list, order: int) -> tuple[int, bytearray]:
    """State and bytes spilled after data[start:], coded from its end; freq and first by symbol, or by context and symbol."""
    out = bytearray()
    for i in range(len(data) - 1, start - 1, -1):
        s = data[i] + 256 * (data[i - 1] if i else before) if order else data[i]
        f = freq[s]
        while x >= f << 19:
            out.append(x & 255)
            x >>= 8
        x = x // f * _TOTAL + x % f + first[s]
    return x, out


def _decode_tail(x: int, body: bytes, at: int, n: int, last: int, freq: list, first: list, symbol: bytes, order: int) -> bytearray:
    """The next n bytes of a stream from its state and place; last is the byte before them."""
    out, base = bytearray(), 0
    for _ in range(n):
        base = 256 * last if order else 0
        slot = x & (_TOTAL - 1)
        last = symbol[base * 16 + slot]
        f = freq[base + last]
        if not f:
            raise ValueError("a context has no symbols")
        out.append(last)
        x = f * (x >> 12) + slot - first[base + last]
        while x < _LOW:
            if at >= len(body):
                raise ValueError("the stream is cut short")
            x = x << 8 | body[at]
            at += 1
    return out


def rans_encode_many(rows: list[bytes], order: int = 0) -> list[bytes]:
    """Streams of a range asymmetric numeral system of order 0 or 1, each self-contained: order, lengths of data and payload
    (u32 BE), table, state (u32 BE), bytes. The states of many rows step through their bytes side by side."""
    if order not in (0, 1):
        raise ValueError(f"no order {order}")
    out, sizes = [b""] * len(rows), np.fromiter(map(len, rows), np.int64, len(rows))
    for at in _blocks(sizes, _ROWS_1 if order else _ROWS):
        n = sizes[at]
        if not n[0]:
            flat = _table(np.full(256, 16), 0) if not order else _table(np.zeros((256, 256), np.int64), 1)
            for k in at:
                out[k] = struct.pack(">BII", order, 0, 4) + flat + struct.pack(">I", _LOW)
            continue
        m = _padded(rows, at, sizes)
        freq = frequencies(_context_counts(m, n, order))
        first = np.cumsum(freq, axis=1) - freq
        f, c = freq.ravel(), first.ravel()
        base = np.arange(len(at)) * (65536 if order else 256)
        x, spilled, used = np.full(len(at), _LOW, np.int64), np.zeros((len(at), 2 * m.shape[1] + 8), np.uint8), np.zeros(len(at), np.int64)
        cut = int(n[min(_FEW, len(n) - 1)]) if len(n) > _FEW else 0  # beyond it, rows are coded one by one
        for i in range(min(_FEW, len(at))):
            one = slice(i * 256, (i + 1) * 256) if order else i
            x[i], tail = _encode_tail(_LOW, rows[at[i]], cut, 0, freq[one].ravel().tolist(), first[one].ravel().tolist(), order)
            spilled[i, : len(tail)] = np.frombuffer(bytes(tail), np.uint8)
            used[i] = len(tail)
        for t in range(cut - 1, -1, -1):
            k = int(np.searchsorted(-n, -t, side="left"))  # the rows longer than t, which come first
            cell = base[:k] + m[:k, t]
            if order and t:
                cell += m[:k, t - 1].astype(np.int64) * 256
            g = f[cell]
            for _ in range(2):
                over = np.flatnonzero(x[:k] >= g << 19)
                if not len(over):
                    break
                spilled[over, used[over]] = x[over] & 255
                used[over] += 1
                x[over] >>= 8
            q, r = np.divmod(x[:k], g)
            x[:k] = q * _TOTAL + r + c[cell]
        for i, k in enumerate(at):
            payload = struct.pack(">I", int(x[i])) + spilled[i, : used[i]][::-1].tobytes()
            own = freq[i * 256 : (i + 1) * 256] if order else freq[i]
            out[k] = struct.pack(">BII", order, len(rows[k]), len(payload)) + (_table(own, order) if len(rows[k]) else _table(np.full(256, 16), 0) if not order else _table(own, 1)) + payload
    return out


def rans_decode_many(streams: list[bytes]) -> list[bytes]:
    """What rans_encode_many coded; a stream that is cut short or malformed is an error."""
    heads, tables = [], []
    for data in streams:
        if len(data) < 9 or data[0] > 1:
            raise ValueError("no stream of order 0 or 1")
        order, n, size = struct.unpack_from(">BII", data)
        freq, at = _read_table(data, order)
        sums = freq.reshape(-1, 256).sum(axis=1)
        if at + size != len(data) or size < 4 or not np.isin(sums, (0, _TOTAL)).all() or n and not sums.any():
            raise ValueError("lengths or frequencies don't add up")
        heads.append((order, n, at))
        tables.append(freq)
    out = [b""] * len(streams)
    for order in (0, 1):
        mine = np.array([i for i, h in enumerate(heads) if h[0] == order], np.int64)
        sizes = np.array([heads[i][1] for i in mine], np.int64)
        for block in _blocks(sizes, _ROWS_1 if order else _ROWS):
            at, n = mine[block], sizes[block]
            freq = np.concatenate([tables[i].reshape(-1, 256) for i in at])
            first = np.cumsum(freq, axis=1) - freq
            symbol = np.zeros((len(freq), _TOTAL), np.uint8)
            for r in np.flatnonzero(freq.sum(axis=1)):
                symbol[r] = np.repeat(np.arange(256, dtype=np.uint8), freq[r])
            whole = freq.sum(axis=1) > 0
            bodies = [streams[i][heads[i][2] + 4 :] for i in at]
            ends = np.fromiter(map(len, bodies), np.int64, len(bodies))
            body = np.zeros((len(at), int(ends.max(initial=0)) + 2), np.uint8)
            for i, raw in enumerate(bodies):
                body[i, : len(raw)] = np.frombuffer(raw, np.uint8)
            x = np.array([struct.unpack_from(">I", streams[i], heads[i][2])[0] for i in at], np.int64)
            used, made = np.zeros(len(at), np.int64), np.zeros((len(at), int(n[0]) if len(n) else 0), np.uint8)
            base = np.arange(len(at)) * (256 if order else 1)
            cut = int(n[min(_FEW, len(n) - 1)]) if len(n) > _FEW else 0
            for t in range(cut):
                k = int(np.searchsorted(-n, -t, side="left"))
                row = base[:k] + (made[:k, t - 1] if order and t else 0)
                if not whole[row].all():
                    raise ValueError("a context has no symbols")
                slot = x[:k] & (_TOTAL - 1)
                s = symbol[row, slot]
                made[:k, t] = s
                x[:k] = freq[row, s] * (x[:k] >> 12) + slot - first[row, s]
                for _ in range(2):
                    under = np.flatnonzero(x[:k] < _LOW)
                    if not len(under):
                        break
                    if (used[under] >= ends[under]).any():
                        raise ValueError("the stream is cut short")
                    x[under] = x[under] << 8 | body[under, used[under]]
                    used[under] += 1
            for i in range(min(_FEW, len(at))):
                if n[i] > cut:
                    one = slice(i * 256, (i + 1) * 256) if order else i
                    tail = _decode_tail(int(x[i]), bodies[i], int(used[i]), int(n[i]) - cut, int(made[i, cut - 1]) if cut else 0, freq[one].ravel().tolist(), first[one].ravel().tolist(), symbol[one].tobytes(), order)
                    made[i, cut : n[i]] = np.frombuffer(bytes(tail), np.uint8)
            for i, k in enumerate(at):
                out[k] = made[i, : n[i]].tobytes()
    return out


def rans_encode(data: bytes, order: int = 0) -> bytes:
    return rans_encode_many([bytes(data)], order)[0]


def rans_decode(data: bytes) -> bytes:
    return rans_decode_many([bytes(data)])[0]


def delta_rans_encode(data: bytes, size: int) -> bytes:
    """Differences of little-endian integers of 1, 4 or 8 bytes, wrapped, zigzagged, as varints, entropy-coded, after a header of 8 bytes."""
    if size not in (1, 4, 8) or len(data) % size:
        raise ValueError("whole elements of 1, 4 or 8 bytes are needed")
    v = np.frombuffer(data, f"<i{size}")
    with np.errstate(over="ignore"):
        d = np.diff(v, prepend=v.dtype.type(0))
    return b"DRA0" + bytes([1, size, 0, 0]) + rans_encode(varints(zigzag(d.astype(np.int64))))


def delta_rans_decode(data: bytes) -> bytes:
    if data[:5] != b"DRA0\x01" or data[5] not in (1, 4, 8):
        raise ValueError("no stream of deltas")
    d = unzigzag(unvarints(rans_decode(data[8:]))).astype(f"<i{data[5]}")
    return np.cumsum(d, dtype=d.dtype).tobytes()


def strings_encode(texts: list[str], order: int = 0) -> bytes:
    """Length (varint) and UTF-8 of each text, entropy-coded as one stream."""
    raw = [t.encode() for t in texts]
    return rans_encode(b"".join(varints(np.array([len(r)], np.uint64)) + r for r in raw), order)


def strings_decode(data: bytes) -> list[str]:
    raw, at, out = rans_decode(data), 0, []
    while at < len(raw):
        size, shift = 0, 0
        while True:
            if at >= len(raw):
                raise ValueError("the last length is cut short")
            size |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                break
        if at + size > len(raw):
            raise ValueError("the last text is cut short")
        out.append(raw[at : at + size].decode())
        at += size
    return out


# Codec numbers on the wire and in stored channels.
NONE, ZLIB, LZ4, NUMPRESS_DELTA, RANS_0, RANS_1, BASE_PACK, QUALITY_BINNED = range(8)
DELTA_RANS, FQZCOMP, MATE_INLINE, REF_DIFF, NAME_TOKENIZED = 11, 12, 13, 14, 15
#: Codecs that need columns beside their own.
CONTEXT_AWARE = frozenset({FQZCOMP, MATE_INLINE, REF_DIFF})


def wire_encode(data: bytes, codec: int) -> bytes:
    """A unit's slice of bytes under one of the codecs that a single slice can carry."""
    if codec == NONE:
        return data
    if codec in (RANS_0, RANS_1):
        return rans_encode(data, codec - RANS_0)
    if codec == BASE_PACK:
        return pack_bases(data)
    raise NotImplementedError(f"codec {codec} isn't for single slices of bytes")


def wire_decode(data: bytes, codec: int) -> bytes:
    if codec == NONE:
        return data
    if codec in (RANS_0, RANS_1):
        return rans_decode(data)
    if codec == BASE_PACK:
        return unpack_bases(data)
    raise NotImplementedError(f"codec {codec} isn't for single slices of bytes")


#: Codecs of whole byte strings by name, each for many strings at once.
BYTES: dict[str, tuple[Callable, Callable]] = {
    "bases": (lambda rows: [pack_bases(r) for r in rows], lambda rows: [unpack_bases(r) for r in rows]),
    "qualities": (lambda rows: [pack_qualities(r) for r in rows], lambda rows: [unpack_qualities(r) for r in rows]),
    "rans": (rans_encode_many, rans_decode_many),
    "rans1": (lambda rows: rans_encode_many(rows, 1), rans_decode_many),
}


#: Bytes of strings that a codec gets at once; a longer string comes alone.
AT_ONCE = 1 << 21


def with_bytes(df: DataFrame, column: str, to: str, *fs: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """df with fs, one after the other, each of which takes many strings at once, of a binary column as a new binary column; null
    stays null. Rows stay where they are. A batch is taken in parts of AT_ONCE bytes, since codecs need many times as much, and
    several functions share a worker."""
    limit = AT_ONCE

    def run(batches):
        for b in batches:
            at = b.schema.names.index(column)
            sizes = [0 if n is None else n for n in pa.compute.binary_length(b.column(at)).to_pylist()]
            start = 0
            while start < len(sizes):
                stop, held = start + 1, sizes[start]
                while stop < len(sizes) and held + sizes[stop] <= limit:
                    held += sizes[stop]
                    stop += 1
                part = b.slice(start, stop - start)
                given = part.column(at).to_pylist()
                made = [x for x in given if x is not None]
                for f in fs:
                    made = f(made)
                made = iter(made)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if x is None else next(made) for x in given], pa.binary())], names=[*b.schema.names, to])
                start = stop

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.BinaryType())]))


def numpress_columns(df: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """df with each channel (array of doubles) as <channel>_deltas and <channel>_scale."""
    from pyspark.sql import types as T

    rest = [f for f in df.schema.fields if f.name not in channels]
    schema = T.StructType([*rest, *(x for c in channels for x in (T.StructField(f"{c}_deltas", T.ArrayType(T.LongType())), T.StructField(f"{c}_scale", T.LongType())))])

    def run(batches):
        for b in batches:
            cols = [b.column(b.schema.names.index(f.name)) for f in rest]
            for c in channels:
                made = [(None, None) if x is None else delta_encode(np.asarray(x, np.float64)) for x in b.column(b.schema.names.index(c)).to_pylist()]
                cols += [pa.array([d for d, _ in made], pa.list_(pa.int64())), pa.array([None if s is None else min(s, (1 << 63) - 1) for _, s in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def numpress_restored(df: DataFrame, channels: list[str]) -> DataFrame:
    """The channels again."""
    from pyspark.sql import types as T

    packed = [f"{c}_{x}" for c in channels for x in ("deltas", "scale")]
    rest = [f for f in df.schema.fields if f.name not in packed]
    schema = T.StructType([*rest, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in channels)])

    def run(batches):
        for b in batches:
            column = lambda n: b.column(b.schema.names.index(n))  # noqa: E731, B023
            cols = [column(f.name) for f in rest]
            for c in channels:
                cols.append(pa.array([None if d is None else delta_decode(np.asarray(d, np.int64), s) for d, s in zip(column(f"{c}_deltas").to_pylist(), column(f"{c}_scale").to_pylist())], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return df.mapInArrow(run, schema)
