"""Codecs of read columns that lean on other columns: mates inline with their reads, and sequences against a reference."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .codecs import rans_decode, rans_encode, unvarints, unzigzag, varints, zigzag

# Fixed values of the wire formats.
SAME, CROSS, NO_MATE = 0, 1, 2
UNMAPPED_OWN = 0xFFFF
MATE_MAGIC, REF_MAGIC, SLICE_READS = b"MIv2", b"RDF2", 10_000
IN_MATCH, IN_INSERT, IN_CLIP = 0, 1, 2
BASES = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.full(256, 255, np.uint8)
_CODE[BASES] = np.arange(4)


def mate_class(mate: Column, own: Column) -> Column:
    """Class of a mate from the two chromosome numbers, -1 for none: on the same one, on another, or none."""
    return F.when(mate == -1, NO_MATE).when(mate == own, SAME).otherwise(CROSS)


def _pack2(codes: np.ndarray) -> bytes:
    """Two bits a code, the first lowest."""
    quads = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    quads[: len(codes)] = codes
    return (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()


def _unpack2(data: bytes, n: int) -> np.ndarray:
    if len(data) < -(-n // 4):
        raise ValueError("packed codes are cut short")
    return ((np.frombuffer(data, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()[:n]


def mates_encode(mate_chromosome, mate_position, template_length, own_chromosome, own_position) -> bytes:
    """Mates of reads in order. A header of 34 bytes, then the classes (packed, or entropy-coded if that is shorter), the
    numbers of other chromosomes, positions (against the read's own where the chromosome is the same) and template lengths."""
    mc, oc = np.asarray(mate_chromosome, np.int64), np.asarray(own_chromosome, np.int64)
    mp, op, tl = (np.asarray(v, np.int64) for v in (mate_position, own_position, template_length))
    if (mc < -1).any():
        raise ValueError("chromosome numbers below -1")
    oc = np.where(oc == UNMAPPED_OWN, -1, oc)
    kind = np.where(mc == -1, NO_MATE, np.where(mc == oc, SAME, CROSS)).astype(np.uint8)
    raw, coded = _pack2(kind), rans_encode(kind.tobytes())
    parts = [b"\x01" + coded if len(coded) < len(raw) else b"\x00" + raw]
    for values in (varints(mc[kind == CROSS].astype(np.uint64)), varints(zigzag(np.where(kind == SAME, mp - op, mp))), varints(zigzag(tl))):
        parts.append(rans_encode(values) if values else b"")
    head = MATE_MAGIC + bytes([1, 0]) + struct.pack("<QIIIII", len(mc), int((kind == CROSS).sum()), *map(len, parts))
    return head + b"".join(parts)


def mates_decode(data: bytes, own_chromosome, own_position) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mate chromosomes, positions and template lengths."""
    if data[:6] != MATE_MAGIC + b"\x01\x00" or len(data) < 34:
        raise ValueError("no stream of mates")
    n, cross, *sizes = struct.unpack_from("<QIIIII", data, 6)
    oc, op = np.asarray(own_chromosome, np.int64), np.asarray(own_position, np.int64)
    if len(oc) != n or 34 + sum(sizes) != len(data):
        raise ValueError("lengths don't add up")
    at, parts = 34, []
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    kind = np.frombuffer(rans_decode(parts[0][1:]), np.uint8) if parts[0][:1] == b"\x01" else _unpack2(parts[0][1:], n)
    if len(kind) != n or (kind > NO_MATE).any() or int((kind == CROSS).sum()) != cross:
        raise ValueError("classes of mates are malformed")
    numbers = [unvarints(rans_decode(p)) if p else np.zeros(0, np.uint64) for p in parts[1:]]
    chromosome = np.where(kind == NO_MATE, -1, np.where(oc == UNMAPPED_OWN, -1, oc))
    chromosome[kind == CROSS] = numbers[0].astype(np.int64)
    position = unzigzag(numbers[1])
    return chromosome, np.where(kind == SAME, position + op, position), unzigzag(numbers[2])


_OPS = re.compile(r"(\d+)(.)")


def _steps(cigar: str) -> list[tuple[int, str]]:
    found = [(int(n), op) for n, op in _OPS.findall(cigar)]
    if "".join(f"{n}{op}" for n, op in found) != re.sub(r"(?<!\d)0+(?=\d)", "", cigar) or any(op not in "MIDNSHP=X" for _, op in found):
        raise ValueError(f"malformed CIGAR {cigar!r}")
    return found


def _walk(cigars: list[str], positions: np.ndarray):
    """For each read (stream, length, reference place or -1) of its operations that hold read bases."""
    for cigar, position in zip(cigars, positions):
        at, out = int(position) - 1, []
        for n, op in _steps(cigar):
            if op in "M=X":
                out.append((IN_MATCH, n, at))
                at += n
            elif op in "IS":
                out.append((IN_INSERT if op == "I" else IN_CLIP, n, -1))
            elif op in "DN":
                at += n
        yield out


def _upper(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 97) & (b <= 122), b - 32, b).astype(np.uint8)


def _slice_encode(seqs: list[bytes], positions, cigars, reference: np.ndarray) -> bytes:
    pieces, flags, escapes, counts = {IN_MATCH: [], IN_INSERT: [], IN_CLIP: []}, [], [], [0, 0, 0]
    for seq, steps in zip(seqs, _walk(cigars, positions)):
        raw, r = np.frombuffer(seq, np.uint8), 0
        for stream, n, at in steps:
            bases = raw[r : r + n]
            if len(bases) < n or stream == IN_MATCH and (at < 0 or at + n > len(reference)):
                raise ValueError("a CIGAR reaches beyond its read or the reference")
            r += n
            if stream == IN_MATCH:
                unlike = _upper(bases) != _upper(reference[at : at + n])
                flags.append(unlike.astype(np.uint8))
                bases = bases[unlike]
            code = _CODE[bases]
            for i in np.flatnonzero(code == 255):
                escapes.append(bytes([stream]) + varints(np.array([counts[stream] + i], np.uint64)) + bytes([bases[i]]))
            counts[stream] += len(bases)
            pieces[stream].append(np.where(code == 255, 0, code))
    join = lambda parts: np.concatenate([np.zeros(0, np.uint8), *parts]).astype(np.uint8)
    bodies = [rans_encode(b) for b in (join(flags).tobytes(), *(_pack2(join(pieces[s])) for s in (IN_MATCH, IN_INSERT, IN_CLIP)), b"".join(escapes))]
    return struct.pack("<IIIIII", *map(len, bodies), 0) + b"".join(bodies)


def sequences_encode(seqs: list[bytes], positions, cigars: list[str], reference: bytes, md5: bytes, uri: str, slice_reads: int = SLICE_READS) -> bytes:
    """Aligned reads of one chromosome as what sets them apart from the reference, in slices that decode by themselves.
    Positions are 1-based. Letters of either case match; other bytes than ACGT that don't match are kept as they are."""
    if len(md5) != 16:
        raise ValueError("an MD5 of 16 bytes is needed")
    ref, pos, name = np.frombuffer(reference, np.uint8), np.asarray(positions, np.int64), uri.encode()
    index, bodies, at = [], [], 0
    for i in range(0, len(seqs), slice_reads):
        end = min(i + slice_reads, len(seqs))
        body = _slice_encode(seqs[i:end], pos[i:end], cigars[i:end], ref)
        index.append(struct.pack("<QIqqI", at, len(body), int(pos[i]), int(pos[end - 1]), end - i))
        bodies.append(body)
        at += len(body)
    return REF_MAGIC + b"\x01\0\0\0" + struct.pack("<IQ", len(bodies), len(seqs)) + md5 + struct.pack("<H", len(name)) + name + b"".join(index) + b"".join(bodies)


def sequences_header(data: bytes) -> dict:
    """Number of slices and reads, MD5 and URI of the reference."""
    if data[:5] != REF_MAGIC + b"\x01" or len(data) < 38:
        raise ValueError("no stream of reference differences")
    slices, reads = struct.unpack_from("<IQ", data, 8)
    (size,) = struct.unpack_from("<H", data, 36)
    return {"slices": slices, "reads": reads, "md5": data[20:36], "uri": data[38 : 38 + size].decode(), "end": 38 + size}


def sequences_decode(data: bytes, positions, cigars: list[str], reference: bytes) -> list[bytes]:
    """The reads again; where a letter matched, as the reference has it in upper case."""
    head, ref, pos = sequences_header(data), _upper(np.frombuffer(reference, np.uint8)), np.asarray(positions, np.int64)
    if head["reads"] != len(cigars):
        raise ValueError("another number of reads")
    start, out = head["end"] + 32 * head["slices"], []
    for i in range(head["slices"]):
        at, size, _, _, n = struct.unpack_from("<QIqqI", data, head["end"] + 32 * i)
        body = data[start + at : start + at + size]
        sizes = struct.unpack_from("<IIIIII", body)
        if sizes[5] or 24 + sum(sizes) != len(body):
            raise ValueError("a slice is cut short")
        parts, k = [], 24
        for size in sizes[:5]:
            parts.append(rans_decode(body[k : k + size]))
            k += size
        flags, other, k = np.frombuffer(parts[0], np.uint8), {}, 0
        while k < len(parts[4]):
            end = k + 1
            while parts[4][end] >= 128:
                end += 1
            other[parts[4][k], int(unvarints(parts[4][k + 1 : end + 1])[0])] = parts[4][end + 1]
            k = end + 2
        counts, f = [0, 0, 0], 0
        decoded = {s: BASES[_unpack2(parts[1 + s], 4 * len(parts[1 + s]))].copy() for s in (IN_MATCH, IN_INSERT, IN_CLIP)}
        for (s, at), byte in other.items():
            if s > IN_CLIP or at >= len(decoded[s]):
                raise ValueError("an escape is malformed")
            decoded[s][at] = byte
        for steps in _walk(cigars[len(out) : len(out) + n], pos[len(out) : len(out) + n]):
            read = []
            for stream, length, place in steps:
                if stream == IN_MATCH:
                    unlike = flags[f : f + length].astype(bool)
                    f += length
                    bases = ref[place : place + length].copy()
                    if len(unlike) < length or len(bases) < length:
                        raise ValueError("a slice is cut short")
                    k = int(unlike.sum())
                    bases[unlike] = decoded[stream][counts[stream] : counts[stream] + k]
                else:
                    k = length
                    bases = decoded[stream][counts[stream] : counts[stream] + k]
                counts[stream] += k
                read.append(bases.tobytes())
            out.append(b"".join(read))
    return out


def position_bucket(i: Column, length: Column) -> Column:
    """Bucket of a place in a read: its sixteenth, 15 at most."""
    return F.least(F.lit(15), F.floor(i * 16 / F.greatest(length, F.lit(1)))).cast("int")


def name_tokens(name: str) -> list[str]:
    """A read name in tokens: numbers without a leading zero (0 itself is one) of up to 63 bits, and what lies between."""
    out, text = [], ""
    for part in re.findall(r"[0-9]+|[^0-9]+", name):
        if part.isdigit() and (part == "0" or part[0] != "0") and int(part) < 1 << 63:
            out += [text] if text else []
            out.append(part)
            text = ""
        else:
            text += part
    return out + ([text] if text else [])


def with_mate_stream(reads: DataFrame, group: str = "run_name") -> DataFrame:
    """group, part, n and the stream of mates of each slice of SLICE_READS reads of a run in order of read_index. Expects
    integer columns chromosome_id and mate_chromosome_id, -1 for none."""
    cols = ["mate_chromosome_id", "mate_position", "template_length", "chromosome_id", "position"]

    def run(key, table):
        table = table.sort_by("read_index")
        stream = mates_encode(*[table.column(c).to_numpy() for c in cols])
        return pa.table({group: [key[0].as_py()], "part": [key[1].as_py()], "n": [table.num_rows], "stream": pa.array([stream], pa.binary())})

    sliced = reads.select(group, F.floor(F.col("read_index") / SLICE_READS).cast("long").alias("part"), "read_index", *[F.col(c).cast("long").alias(c) for c in cols])
    kind = dict(reads.dtypes)[group]
    return sliced.groupBy(group, "part").applyInArrow(run, f"{group} {kind}, part long, n long, stream binary")


# -- read names -----------------------------------------------------------------------------------------------------------

NAME_MAGIC, POOL, NAME_BLOCK = b"NTK2", 8, 4096
DUP, MATCH, COLUMNS, VERBATIM = range(4)


def _bits(values: list[int], width: int) -> bytes:
    """Values of so many bits each, the first in the highest bits."""
    if not values:
        return b""
    flat = (np.array(values, np.uint8)[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(flat.ravel()).tobytes()


def _unbits(data: bytes, n: int, width: int) -> list[int]:
    flat = np.unpackbits(np.frombuffer(data, np.uint8))
    if len(flat) < n * width:
        raise ValueError("a substream is cut short")
    return (flat[: n * width].reshape(n, width) @ (1 << np.arange(width - 1, -1, -1))).tolist()


def _uint(v: int) -> bytes:
    out = bytearray()
    while v >= 128:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


class _Reader:
    """Numbers and texts of a substream, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def uint(self) -> int:
        v = shift = 0
        while True:
            if self.at >= len(self.data) or shift > 63:
                raise ValueError("a substream is cut short")
            byte = self.data[self.at]
            self.at += 1
            v |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return v

    def sint(self) -> int:
        v = self.uint()
        return v >> 1 ^ -(v & 1)

    def text(self) -> str:
        n = self.uint()
        self.at += n
        if self.at > len(self.data):
            raise ValueError("a substream is cut short")
        return self.data[self.at - n : self.at].decode("ascii")


class _Columns:
    """What the rows of a block know of its columns: their kinds, the last number of each, and the texts seen in each."""

    def __init__(self):
        self.kinds, self.last, self.texts = None, {}, {}

    def learn(self, tokens: list, k: int) -> None:
        """The first k tokens came from another row: their numbers are the last ones now."""
        for j, t in enumerate(tokens[:k]):
            if isinstance(t, int):
                self.last[j] = t


def _typed(name: str) -> list:
    return [int(t) if t.isdigit() and (t == "0" or t[0] != "0") and int(t) < 1 << 63 else t for t in name_tokens(name)]


def _kinds(tokens: list) -> list[int]:
    return [0 if isinstance(t, int) else 1 for t in tokens]


def _names_block(names: list[str]) -> bytes:
    pool, state = [], _Columns()
    flags, picks, matched, deltas, codes, literals, verbatim = [], [], bytearray(), bytearray(), bytearray(), bytearray(), bytearray()
    for name in names:
        tokens = _typed(name)
        if not name.isascii() or len(tokens) > 255:
            raise ValueError(f"a name that can't be held: {name[:40]!r}")
        kinds = _kinds(tokens)
        fits = bool(tokens) and state.kinds in (None, kinds)
        same = next((i for i, (n, _) in enumerate(pool) if n == name), None)
        best = (0, 0)
        if same is None and fits:
            for i, (_, other) in enumerate(pool):
                k = 0
                while k < min(len(tokens), len(other)) and type(tokens[k]) is type(other[k]) and tokens[k] == other[k]:
                    k += 1
                if 1 <= k < len(tokens) and k > best[0]:
                    best = (k, i)
        if same is not None:
            flags.append(DUP)
            picks.append(same)
        elif fits:
            state.kinds, k = kinds, best[0]
            flags.append(MATCH if k else COLUMNS)
            if k:
                picks.append(best[1])
                matched += _uint(k)
                state.learn(tokens, k)
            for j in range(k, len(tokens)):
                t = tokens[j]
                if isinstance(t, int):
                    d = t - state.last.get(j, 0)
                    deltas += _uint(t) if j not in state.last else _uint(d << 1 if d >= 0 else ~(d << 1))
                    state.last[j] = t
                else:
                    seen = state.texts.setdefault(j, {})
                    codes += _uint(seen.get(t, len(seen)))
                    if t not in seen:
                        seen[t] = len(seen)
                        literals += _uint(len(t)) + t.encode()
        else:
            flags.append(VERBATIM)
            verbatim += _uint(len(name)) + name.encode()
        pool = [*pool, (name, tokens)][-POOL:]
    shape = bytes([len(state.kinds)]) + _bits(state.kinds, 1) if state.kinds else b""
    body = b""
    for part in (_bits(flags, 2), _bits(picks, 3), matched, shape, deltas, codes, literals, verbatim):
        raw = bytes(part)
        coded = rans_encode(raw) if raw else raw
        mode, data = (1, coded) if len(coded) < len(raw) else (0, raw)
        body += struct.pack("<IB", len(data), mode) + data
    return struct.pack("<II", len(names), len(body)) + body


def names_encode(names: list[str]) -> bytes:
    """Read names in blocks of NAME_BLOCK that decode by themselves. A name is the same as one of the last eight, or begins like
    one of them, or differs by column from the row before, or is kept as it is."""
    blocks = [_names_block(names[i : i + NAME_BLOCK]) for i in range(0, len(names), NAME_BLOCK)]
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1])).astype("<u4") if blocks else np.zeros(0, "<u4")
    return NAME_MAGIC + bytes([1, 0 if names else 1]) + struct.pack("<IH", len(names), len(blocks)) + starts.tobytes() + b"".join(blocks)


def _read_names(data: bytes) -> list[str]:
    n, size = struct.unpack_from("<II", data)
    if not 0 < n <= NAME_BLOCK or 8 + size > len(data):
        raise ValueError("a block is cut short or of no names")
    parts, at = [], 8
    for _ in range(8):
        length, mode = struct.unpack_from("<IB", data, at)
        if mode > 1 or at + 5 + length > 8 + size:
            raise ValueError("a substream is malformed")
        raw = data[at + 5 : at + 5 + length]
        parts.append(rans_decode(raw) if mode else raw)
        at += 5 + length
    if at != 8 + size:
        raise ValueError("substreams don't add up")
    flags = _unbits(parts[0], n, 2)
    picks = iter(_unbits(parts[1], sum(f in (DUP, MATCH) for f in flags), 3))
    matched, deltas, codes, literals, verbatim = _Reader(parts[2]), *map(_Reader, parts[4:8])
    kinds = _unbits(parts[3][1:], parts[3][0], 1) if parts[3] else []
    pool, state, out = [], _Columns(), []
    for f in flags:
        if f in (DUP, MATCH):
            pick = next(picks)
            if pick >= len(pool):
                raise ValueError("no such name before")
        if f == DUP:
            name, tokens = pool[pick]
        elif f == VERBATIM:
            name = verbatim.text()
            tokens = _typed(name)
        else:
            k = matched.uint() if f == MATCH else 0
            if f == MATCH and not 0 < k < len(kinds) or f == MATCH and _kinds(pool[pick][1][:k]) != kinds[:k]:
                raise ValueError("a match of no part of a name")
            tokens = list(pool[pick][1][:k]) if f == MATCH else []
            state.learn(tokens, k)
            for j in range(k, len(kinds)):
                if kinds[j] == 0:
                    state.last[j] = (state.last[j] + deltas.sint()) if j in state.last else deltas.uint()
                    tokens.append(state.last[j])
                else:
                    seen, code = state.texts.setdefault(j, []), codes.uint()
                    if code > len(seen):
                        raise ValueError("no such text before")
                    if code == len(seen):
                        seen.append(literals.text())
                    tokens.append(seen[code])
            name = "".join(map(str, tokens))
        pool = [*pool, (name, tokens)][-POOL:]
        out.append(name)
    return out


def names_decode(data: bytes, block: int | None = None) -> list[str]:
    """All names, or those of one block."""
    if len(data) < 12 or data[:5] != NAME_MAGIC + b"\x01" or data[5] > 1:
        raise ValueError("no stream of names")
    n, blocks = struct.unpack_from("<IH", data, 6)
    if 12 + 4 * blocks > len(data):
        raise ValueError("places of blocks are cut short")
    starts = np.frombuffer(data, "<u4", blocks, 12) + 12 + 4 * blocks
    if blocks and int(starts.max()) + 8 > len(data):
        raise ValueError("a block beyond the end")
    if block is not None:
        return _read_names(data[int(starts[block]) :])
    out = [x for s in starts for x in _read_names(data[int(s) :])]
    if len(out) != n:
        raise ValueError("another number of names")
    return out
