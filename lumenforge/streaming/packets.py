"""Packets of the transport stream: a 24-byte little-endian header and a payload, written, read, checked and filtered.

Whole columns are packed at once: the fixed prefixes of access units by numpy records, checksums for many packets side by
side. A stream is a table of packets with an order (section, dataset_id, au_sequence) until it is written as bytes.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.codecs import BASE_PACK, NONE, RANS_0, RANS_1, ZLIB, wire_decode, wire_encode
from ..plans.predicates import UnitFilter

# Fixed values of the wire format.
MAGIC, VERSION = b"TI", 1
HEADER, HEADER_SIZE = "<2sBBHHIIQ", 24
STREAM_HEADER, DATASET_HEADER, ACCESS_UNIT, PROTECTION, ANNOTATION, PROVENANCE, CHROMATOGRAM, END_OF_DATASET = range(1, 9)
END_OF_STREAM = 0xFF
ENCRYPTED, COMPRESSED, CHECKSUM, ENCRYPTED_HEADER = 0x0001, 0x0002, 0x0004, 0x0008
FORMAT_VERSION = "1.2"
CASTAGNOLI = 0x82F63B78
#: The filter keys that lead an access unit's payload, and its number of channels.
PREFIX = np.dtype([("spectrum_class", "u1"), ("acquisition_mode", "u1"), ("ms_level", "u1"), ("polarity", "u1"), ("retention_time", "<f8"), ("precursor_mz", "<f8"), ("precursor_charge", "u1"), ("ion_mobility", "<f8"), ("base_peak_intensity", "<f8"), ("n_channels", "u1")])
PIXEL, GENOMIC, MATE = "<III", "<qBH", "<qi"
CLASSES = {"MassSpectrum": 0, "NMRSpectrum": 1, "NMR2DSpectrum": 2, "FreeInductionDecay": 3, "MSImagePixel": 4, "GenomicRead": 5}
FLOAT64, UINT8 = 1, 6
GENOMIC_CHANNELS = ("sequences", "qualities", "cigar", "read_name", "mate_chromosome")
PACKETS = "type int, flags int, dataset_id int, au_sequence long, timestamp_ns long, payload binary"
#: Bytes up to which packets of many streams are checked side by side.
_CELLS = 32 << 20


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(CASTAGNOLI), out >> 1)
    return out


_CRC = _table()


def crc32c_many(rows: list[bytes]) -> np.ndarray:
    """Castagnoli checksums; the rows step through their bytes side by side, the longest first."""
    sizes, out, i = np.fromiter(map(len, rows), np.int64, len(rows)), np.zeros(len(rows), np.uint32), 0
    order = np.argsort(-sizes, kind="stable")
    while i < len(order):
        at = order[i : i + max(1, _CELLS // max(1, int(sizes[order[i]])))]
        i += len(at)
        n = sizes[at]
        m = np.zeros((int(n[0]), len(at)), np.uint8)
        for k, r in enumerate(at):
            m[: n[k], k] = np.frombuffer(rows[r], np.uint8)
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for t in range(len(m)):
            k = int(np.searchsorted(-n, -t, side="left"))
            crc[:k] = crc[:k] >> np.uint32(8) ^ _CRC[(crc[:k] ^ m[t, :k]) & np.uint32(255)]
        out[at] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(data: bytes) -> int:
    return int(crc32c_many([data])[0])


def pack_many(kind: int, payloads: list[bytes], datasets, sequences, stamps=None, checksum: bool = False, flags: int = 0) -> list[bytes]:
    flags |= CHECKSUM if checksum else 0
    sums = crc32c_many(payloads) if checksum else None
    stamps = [0] * len(payloads) if stamps is None else stamps
    head = struct.Struct(HEADER)
    return [head.pack(MAGIC, VERSION, kind, flags, int(d) & 0xFFFF, int(s) & 0xFFFFFFFF, len(p), int(t)) + p + (b"" if sums is None else int(sums[i]).to_bytes(4, "little")) for i, (p, d, s, t) in enumerate(zip(payloads, datasets, sequences, stamps))]


def pack(kind: int, payload: bytes, dataset_id: int = 0, sequence: int = 0, timestamp_ns: int = 0, checksum: bool = False) -> bytes:
    return pack_many(kind, [payload], [dataset_id], [sequence], [timestamp_ns], checksum)[0]


def unpack(stream: bytes) -> list[tuple]:
    """Packets of a stream up to and with its end, as tuples of PACKETS' fields; a malformed or cut stream is an error."""
    at, out, sums, view = 0, [], [], memoryview(stream)
    while at < len(stream):
        if len(stream) - at < HEADER_SIZE:
            raise ValueError("a header is cut short")
        magic, version, kind, flags, dataset, sequence, size, stamp = struct.unpack_from(HEADER, stream, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"no packet at {at}")
        if flags & ENCRYPTED_HEADER and not flags & ENCRYPTED:
            raise ValueError("a header is said to be encrypted in a clear packet")
        at += HEADER_SIZE
        payload = bytes(view[at : at + size])
        at += size + (4 if flags & CHECKSUM else 0)
        if at > len(stream):
            raise ValueError("a payload is cut short")
        if flags & CHECKSUM:
            sums.append((len(out), struct.unpack_from("<I", stream, at - 4)[0]))
        out.append((kind, flags, dataset, sequence, stamp, payload))
        if kind == END_OF_STREAM:
            break
    if sums and (crc32c_many([out[i][5] for i, _ in sums]) != np.array([c for _, c in sums], np.uint32)).any():
        raise ValueError("a checksum doesn't fit")
    return out


# -- strings and headers --------------------------------------------------------------------------------------------------


def _text(value: str, width: int = 2) -> bytes:
    raw = value.encode()
    return len(raw).to_bytes(width, "little") + raw


def _read_text(data: bytes, at: int, width: int = 2) -> tuple[str, int]:
    size = int.from_bytes(data[at : at + width], "little")
    if at + width + size > len(data):
        raise ValueError("a text is cut short")
    return data[at + width : at + width + size].decode(), at + width + size


def stream_header(title: str, investigation: str, features: list[str], datasets: int, version: str = FORMAT_VERSION) -> bytes:
    return _text(version) + _text(title) + _text(investigation) + struct.pack("<H", len(features)) + b"".join(map(_text, features)) + struct.pack("<H", datasets)


def parse_stream_header(data: bytes) -> dict:
    out, at = {}, 0
    for key in ("format_version", "title", "isa_investigation"):
        out[key], at = _read_text(data, at)
    (n,), at, found = struct.unpack_from("<H", data, at), at + 2, []
    for _ in range(n):
        text, at = _read_text(data, at)
        found.append(text)
    return out | {"features": found, "n_datasets": struct.unpack_from("<H", data, at)[0]}


def dataset_header(dataset_id: int, name: str, mode: int, spectrum_class: str, channels: list[str], instrument_json: str, expected: int = 0) -> bytes:
    return struct.pack("<H", dataset_id) + _text(name) + bytes([mode & 0xFF]) + _text(spectrum_class) + bytes([len(channels)]) + b"".join(map(_text, channels)) + _text(instrument_json, 4) + struct.pack("<I", expected & 0xFFFFFFFF)


def parse_dataset_header(data: bytes) -> dict:
    out = {"dataset_id": struct.unpack_from("<H", data)[0]}
    out["name"], at = _read_text(data, 2)
    out["acquisition_mode"] = data[at]
    out["spectrum_class"], at = _read_text(data, at + 1)
    n, at, found = data[at], at + 1, []
    for _ in range(n):
        text, at = _read_text(data, at)
        found.append(text)
    out["instrument_json"], at = _read_text(data, at, 4)
    return out | {"channel_names": found, "expected_au_count": struct.unpack_from("<I", data, at)[0]}


# -- access units ---------------------------------------------------------------------------------------------------------


def channel(name: str, precision: int, compression: int, n: int, data: bytes) -> bytes:
    return _text(name) + struct.pack("<BBII", precision, compression, n, len(data)) + data


def channels_of(payload: bytes) -> tuple[dict[str, tuple[int, int, int, bytes]], int]:
    """Precision, compression, number of elements and bytes of each channel of a unit, and where its suffix begins."""
    if len(payload) < PREFIX.itemsize:
        raise ValueError("an access unit is cut short")
    out, at = {}, PREFIX.itemsize
    for _ in range(payload[PREFIX.itemsize - 1]):
        name, at = _read_text(payload, at)
        precision, compression, n, size = struct.unpack_from("<BBII", payload, at)
        at += 10
        if at + size > len(payload):
            raise ValueError("a channel is cut short")
        out[name] = (precision, compression, n, payload[at : at + size])
        at += size
    return out, at


def values_of(found: tuple[int, int, int, bytes]) -> np.ndarray:
    """A channel's numbers, as doubles."""
    precision, compression, n, data = found
    raw = zlib.decompress(data) if compression == ZLIB else data
    kinds = {0: "<f4", 1: "<f8", 2: "<i4", 3: "<i8", 4: "<u4", 6: "u1"}
    values = np.frombuffer(raw, kinds[precision])
    if len(values) != n:
        raise ValueError(f"a channel of {len(values)} values says {n}")
    return values.astype(np.float64)


def wire_polarity(sign: np.ndarray) -> np.ndarray:
    """1, -1 and 0 (unknown) as 0, 1 and 2 on the wire."""
    return np.where(sign == 1, 0, np.where(sign == -1, 1, 2)).astype(np.uint8)


def _col(table, name: str, default=0.0) -> np.ndarray:
    at = table.schema.names.index(name)
    return table.column(at).to_numpy(zero_copy_only=False)


def pack_units(batch: pa.RecordBatch, channels: list[str], compress: bool) -> list[bytes]:
    """Payloads of a batch of spectra: prefixes at once, then each channel's slice of the flat buffer."""
    head = np.zeros(batch.num_rows, PREFIX)
    for name in ("spectrum_class", "acquisition_mode", "ms_level", "precursor_charge", "retention_time", "precursor_mz", "ion_mobility", "base_peak_intensity"):
        head[name] = _col(batch, name)
    head["polarity"], head["n_channels"] = wire_polarity(_col(batch, "polarity")), len(channels)
    size = PREFIX.itemsize
    raw, parts = head.tobytes(), []
    out = [[raw[i * size : (i + 1) * size]] for i in range(batch.num_rows)]
    for name in channels:
        lists = batch.column(batch.schema.names.index(name))
        flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<f8").view(np.uint8)
        ends = lists.offsets.to_numpy()
        for i in range(batch.num_rows):
            data = flat[8 * ends[i] : 8 * ends[i + 1]].tobytes()
            out[i].append(channel(name, FLOAT64, ZLIB if compress else NONE, int(ends[i + 1] - ends[i]), zlib.compress(data) if compress else data))
    xyz = [_col(batch, c) for c in ("pixel_x", "pixel_y", "pixel_z")]
    for i in np.flatnonzero(head["spectrum_class"] == CLASSES["MSImagePixel"]):
        out[i].append(struct.pack(PIXEL, *(int(v[i]) for v in xyz)))
    return [b"".join(x) for x in out]


#: Columns of spectra that an access unit carries, with what an absent one counts as.
_UNIT = {"spectrum_class": ("int", 0), "acquisition_mode": ("int", 0), "ms_level": ("int", 0), "polarity": ("int", 0), "retention_time": ("double", 0.0), "precursor_mz": ("double", 0.0), "precursor_charge": ("int", 0), "ion_mobility": ("double", 0.0), "base_peak_intensity": ("double", 0.0), "pixel_x": ("int", 0), "pixel_y": ("int", 0), "pixel_z": ("int", 0)}
_READ = {"chromosome": "string", "position": "long", "mapq": "int", "flags": "long", "mate_position": "long", "template_length": "int", "seq": "binary", "qual": "binary", "cigar": "string", "read_name": "string", "mate_chromosome": "string"}


def write_units(units: DataFrame, checksum: bool = True, channels: tuple[str, ...] = (), compress: bool = False) -> DataFrame:
    """dataset_id, au_sequence and packet for each spectrum; rows stay where they are. Absent columns count as 0, null ones
    too; channels are columns of arrays."""

    def run(batches):
        for b in batches:
            made = pack_many(ACCESS_UNIT, pack_units(b, list(channels), compress), _col(b, "dataset_id"), _col(b, "au_sequence"), checksum=checksum)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["dataset_id", "au_sequence", "packet"])

    cells = [F.coalesce(F.col(c).cast(kind), F.lit(zero)).alias(c) if c in units.columns else F.lit(zero).cast(kind).alias(c) for c, (kind, zero) in _UNIT.items()]
    arrays = [F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")).alias(c) for c in channels]
    typed = units.select(F.col("dataset_id").cast("long").alias("dataset_id"), F.col("au_sequence").cast("long").alias("au_sequence"), *cells, *arrays)
    return typed.mapInArrow(run, "dataset_id long, au_sequence long, packet binary")


def write_read_units(reads: DataFrame, checksum: bool = True, seq_codec: int = NONE, qual_codec: int = NONE, mode: int = 0) -> DataFrame:
    """The same for aligned reads: sequence and qualities under a codec, texts as they are, the mate after the place."""
    if {seq_codec, qual_codec} - {NONE, RANS_0, RANS_1, BASE_PACK}:
        raise NotImplementedError("a codec that single slices can't carry")

    def run(batches):
        for b in batches:
            v = {c: b.column(b.schema.names.index(c)).to_pylist() for c in _READ}
            head = np.zeros(b.num_rows, PREFIX)
            head["spectrum_class"], head["acquisition_mode"], head["polarity"], head["n_channels"] = CLASSES["GenomicRead"], mode, 2, len(GENOMIC_CHANNELS)
            raw, size, payloads = head.tobytes(), PREFIX.itemsize, []
            for i in range(b.num_rows):
                seq, qual = v["seq"][i] or b"", v["qual"][i] or b""
                parts = [raw[i * size : (i + 1) * size], channel("sequences", UINT8, seq_codec, len(seq), wire_encode(seq, seq_codec)), channel("qualities", UINT8, qual_codec, len(qual), wire_encode(qual, qual_codec))]
                for c in ("cigar", "read_name", "mate_chromosome"):
                    text = (v[c][i] or "").encode()
                    parts.append(channel(c, UINT8, NONE, len(text), text))
                parts += [_text(v["chromosome"][i] or ""), struct.pack(GENOMIC, v["position"][i] or 0, (v["mapq"][i] or 0) & 0xFF, (v["flags"][i] or 0) & 0xFFFF)]
                mate = v["mate_position"][i]
                parts.append(struct.pack(MATE, -1 if mate is None else mate, v["template_length"][i] or 0))
                payloads.append(b"".join(parts))
            made = pack_many(ACCESS_UNIT, payloads, _col(b, "dataset_id"), _col(b, "au_sequence"), checksum=checksum)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["dataset_id", "au_sequence", "packet"])

    typed = reads.select(F.col("dataset_id").cast("long").alias("dataset_id"), F.col("au_sequence").cast("long").alias("au_sequence"), *[(F.col(c).cast(kind) if c in reads.columns else F.lit(None).cast(kind)).alias(c) for c, kind in _READ.items()])
    return typed.mapInArrow(run, "dataset_id long, au_sequence long, packet binary")


def parse_units(packets: DataFrame, arrays: bool = False) -> DataFrame:
    """The filter keys of access units among packets (also a stream of them), ready for UnitFilter: those of the prefix, of
    pixels and of reads; with arrays also the channels of spectra, channels (map), and of reads seq, qual and texts."""
    fields = "dataset_id long, au_sequence long, " + ", ".join(f"{c} {kind}" for c, (kind, _) in _UNIT.items()) + ", chromosome string, position long, mapq int, flags long, mate_position long, template_length int"
    fields += ", channels map<string, array<double>>, seq binary, qual binary, cigar string, read_name string, mate_chromosome string" if arrays else ""

    def run(batches):
        for b in batches:
            payloads = b.column(2).to_pylist()
            if not payloads:
                continue
            if min(map(len, payloads)) < PREFIX.itemsize:
                raise ValueError("an access unit is cut short")
            head = np.frombuffer(b"".join(p[: PREFIX.itemsize] for p in payloads), PREFIX)
            sign = np.where(head["polarity"] == 0, 1, np.where(head["polarity"] == 1, -1, 0))
            n = len(payloads)
            pixel, place, extra = np.zeros((3, n), np.int32), [[None] * n for _ in range(6)], [[None] * n for _ in range(6)]
            for i in np.flatnonzero(head["spectrum_class"] >= CLASSES["MSImagePixel"]) if not arrays else range(n):
                found, at = channels_of(payloads[i])
                kind = head["spectrum_class"][i]
                if kind == CLASSES["MSImagePixel"]:
                    if len(payloads[i]) - at < 12:
                        raise ValueError("a pixel without its place")
                    pixel[:, i] = struct.unpack_from(PIXEL, payloads[i], at)
                elif kind == CLASSES["GenomicRead"]:
                    place[0][i], at = _read_text(payloads[i], at)
                    if len(payloads[i]) - at < 11:
                        raise ValueError("a read without its place")
                    place[1][i], place[2][i], place[3][i] = struct.unpack_from(GENOMIC, payloads[i], at)
                    place[4][i], place[5][i] = struct.unpack_from(MATE, payloads[i], at + 11) if len(payloads[i]) - at - 11 >= 12 else (-1, 0)
                if arrays and kind == CLASSES["GenomicRead"]:
                    for k, c in enumerate(GENOMIC_CHANNELS):
                        if c in found:
                            raw = wire_decode(found[c][3], found[c][1])
                            extra[1 + k][i] = raw if k < 2 else raw.decode()
                elif arrays:
                    extra[0][i] = [(c, values_of(x)) for c, x in found.items()]
            cols = [b.column(0), b.column(1)]
            for c, (kind, _) in _UNIT.items():
                values = sign if c == "polarity" else pixel["xyz".index(c[-1])] if c.startswith("pixel") else head[c]
                cols.append(pa.array(values.astype(np.int32 if kind == "int" else np.float64)))
            cols += [pa.array(v, t) for v, t in zip(place, [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()])]
            if arrays:
                cols += [pa.array(v, t) for v, t in zip(extra, [pa.map_(pa.string(), pa.list_(pa.float64())), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in fields.split(", ") if not f.startswith("array<")])

    units = packets.where(F.col("type") == ACCESS_UNIT).select(F.col("dataset_id").cast("long").alias("dataset_id"), F.col("au_sequence").cast("long").alias("au_sequence"), "payload")
    return units.mapInArrow(run, fields)


# -- whole streams --------------------------------------------------------------------------------------------------------

#: Sections of a stream in their order.
_HEAD, _DATASETS, _UNITS, _END = range(4)


def instrument_json(instrument) -> str:
    """The six instrument fields as JSON with sorted keys; absent ones are empty."""
    names = ("analyzer_type", "detector_type", "manufacturer", "model", "serial_number", "source_type")
    found = instrument.asDict() if hasattr(instrument, "asDict") else dict(instrument or {})
    return json.dumps({k: found.get(k) or "" for k in names}, sort_keys=True)


def class_number(name: str | None) -> int:
    """Number of a spectrum class on the wire, by its name with or without a prefix; 0 for an unknown one."""
    return next((n for c, n in CLASSES.items() if (name or "").endswith(c)), 0)


def numbered_runs(runs: DataFrame) -> list[dict]:
    """Rows of the run table as dictionaries with the dataset_id that a stream gives them: spectral runs by name from 1 on,
    then genomic ones. A run table is small: it is metadata of which each run has one row."""
    rows = [r.asDict() for r in runs.collect()]
    genomic = lambda r: r.get("modality") == "genomic" or (r.get("spectrum_class") or "").endswith("GenomicRead")
    rows.sort(key=lambda r: (genomic(r), r["run_name"]))
    return [r | {"dataset_id": i, "genomic": genomic(r)} for i, r in enumerate(rows, 1)]


def _numbered(df: DataFrame, runs: list[dict], index: str) -> DataFrame:
    ids = df.sparkSession.createDataFrame([(r["run_name"], r["dataset_id"], class_number(r.get("spectrum_class")), r.get("acquisition_mode") or 0) for r in runs], "run_name string, dataset_id long, spectrum_class int, acquisition_mode int")
    return df.drop("dataset_id", "spectrum_class", "acquisition_mode").join(F.broadcast(ids), "run_name").withColumn("au_sequence", F.col(index))


def dataset_stream(tables: dict[str, DataFrame], title: str = "", investigation: str = "", features: tuple[str, ...] = (), checksum: bool = False, compress: bool = False, only: UnitFilter | None = None) -> DataFrame:
    """section, dataset_id, au_sequence, packet: the whole stream of a dataset (runs, and spectra and reads as there are),
    for any sink; in that order it is the stream's bytes.

    With a filter it is what a server sends to a client: header, dataset headers (of the dataset asked for), those units that
    pass, max_au of them at most, and the ends; only spectral runs take part. Predicates are applied to the tables' columns,
    before anything is packed.
    """
    spark = tables["runs"].sparkSession
    runs = [r for r in numbered_runs(tables["runs"]) if only is None or not r["genomic"]]
    chosen = [r for r in runs if only is None or only.dataset_id is None or r["dataset_id"] == only.dataset_id]
    spectral, genomic = [r for r in runs if not r["genomic"]], [r for r in runs if r["genomic"]]
    counts, parts = {}, []
    if spectral and "spectra" in tables:
        units = _numbered(tables["spectra"], spectral, "spectrum_index")
        counts |= {r[0]: r[1] for r in units.groupBy("run_name").count().collect()}
        names = tuple(c for c in ("mz", "intensity", "chemical_shift", "wavenumber", "wavelength") if c in units.columns)
        names = names if any(r.get("channel_names") is None for r in spectral) else tuple(c for c in names if any(c in r["channel_names"] for r in spectral))
        parts.append(write_units(only.on(units) if only else units, checksum, names, compress))
    if genomic and "reads" in tables:
        units = _numbered(tables["reads"], genomic, "read_index")
        counts |= {r[0]: r[1] for r in units.groupBy("run_name").count().collect()}
        parts.append(write_read_units(units, checksum))
    frame = [(_HEAD, 0, 0, pack(STREAM_HEADER, stream_header(title, investigation, list(features), len(runs)), checksum=checksum))]
    for r in chosen:
        i, n = r["dataset_id"], counts.get(r["run_name"], 0)
        kind = "GenomicRead" if r["genomic"] else r.get("spectrum_class") or "MassSpectrum"
        channels = list(GENOMIC_CHANNELS) if r["genomic"] else list(r.get("channel_names") or ["mz", "intensity"])
        about = json.dumps({k: r.get(k) or "" for k in ("platform", "reference_uri", "sample_name")}, sort_keys=True) if r["genomic"] else instrument_json(r.get("instrument"))
        frame.append((_DATASETS, i, 0, pack(DATASET_HEADER, dataset_header(i, r["run_name"], r.get("acquisition_mode") or 0, kind, channels, about, n), i, checksum=checksum)))
        end = struct.pack("<HI", i, n)
        # A server ends all datasets after its units; a writer ends each after its own.
        frame.append((_UNITS if only is None else _END, i, 1 << 40, pack(END_OF_DATASET, end, i, checksum=checksum)))
    frame.append((_END, 1 << 20, 0, pack(END_OF_STREAM, b"", checksum=checksum)))
    out = spark.createDataFrame([(s, d, q, bytearray(p)) for s, d, q, p in frame], "section int, dataset_id long, au_sequence long, packet binary")
    for p in parts:
        out = out.unionByName(p.select(F.lit(_UNITS).alias("section"), "dataset_id", "au_sequence", "packet"))
    return out


def ordered(stream: DataFrame) -> DataFrame:
    return stream.orderBy("section", "dataset_id", "au_sequence")


def stream_bytes(stream: DataFrame) -> bytes:
    """The stream's bytes, for small streams."""
    return b"".join(bytes(r[0]) for r in ordered(stream).select("packet").toLocalIterator())


def write_stream(stream: DataFrame, path: str) -> None:
    """Writes the stream below a folder as part files, which follow each other by name; read_stream reads them."""
    from ..sources.files import write_parts

    write_parts(ordered(stream).select("packet"), path, "tis")


def read_packets(streams: DataFrame, content: str = "content") -> DataFrame:
    """Packets of whole streams in a binary column (spark.read.format("binaryFile") gives one), with their arrival in it."""

    def run(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                rows = [(*p, i) for i, p in enumerate(unpack(s or b""))]
                for i in range(0, len(rows), 10_000):
                    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), types)], ["type", "flags", "dataset_id", "au_sequence", "timestamp_ns", "payload", "arrival"])

    return streams.select(content).mapInArrow(run, PACKETS + ", arrival long")


def read_stream(spark: SparkSession, path: str, chunk: int = 64 << 20) -> DataFrame:
    """Packets of one stream in a file or a folder of parts, with arrival (part, place): one task a file walks the headers
    without the payloads, then runs of packets of `chunk` bytes are read by tasks of their own."""
    from ..sources.files import open_range

    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def walk(batches):
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = begun = 0
                with open_range(name) as f:
                    while at < size:
                        f.seek(at)
                        head = f.read(HEADER_SIZE)
                        if len(head) < HEADER_SIZE:
                            raise ValueError("a header is cut short")
                        magic, version, kind, flags, _, _, length, _ = struct.unpack(HEADER, head)
                        if magic != MAGIC or version != VERSION:
                            raise ValueError(f"no packet at {at} of {name}")
                        at += HEADER_SIZE + length + (4 if flags & CHECKSUM else 0)
                        if at > size:
                            raise ValueError("a payload is cut short")
                        if at - begun >= chunk or at == size or kind == END_OF_STREAM:
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([begun], pa.int64()), pa.array([at - begun], pa.int64())], ["path", "start", "size"])
                            begun = at
                        if kind == END_OF_STREAM:
                            break

    def load(batches):
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for b in batches:
            for name, start, size in zip(*(c.to_pylist() for c in b.columns)):
                with open_range(name) as f:
                    f.seek(start)
                    rows = [(name, start, *p, i) for i, p in enumerate(unpack(f.read(size)))]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), types)], ["path", "start", "type", "flags", "dataset_id", "au_sequence", "timestamp_ns", "payload", "arrival"])

    ranges = files.mapInArrow(walk, "path string, start long, size long").repartition("path", "start")
    out = ranges.mapInArrow(load, "path string, start long, " + PACKETS + ", arrival long")
    return out.withColumn("arrival", F.struct("path", "start", "arrival")).drop("path", "start")


def violations(packets: DataFrame) -> DataFrame:
    """dataset_id, au_sequence, rule of what breaks the order of a stream: a first packet that is no stream header, a second
    one, units before their dataset's header, and sequence numbers that don't ascend. Unknown kinds are passed over."""
    from pyspark.sql import Window

    heads = packets.where(F.col("type") == STREAM_HEADER).agg(F.min("arrival").alias("a"), F.count("*").alias("n"))
    first = packets.agg(F.min("arrival").alias("f"))
    stream = heads.crossJoin(first).select(F.when(F.col("n") == 0, "no stream header").when(F.col("n") > 1, "two stream headers").when(F.col("a") != F.col("f"), "stream header not first").alias("rule")).where("rule is not null")
    open_ = packets.where(F.col("type") == DATASET_HEADER).groupBy("dataset_id").agg(F.min("arrival").alias("opened"))
    units = packets.where(F.col("type") == ACCESS_UNIT).select("dataset_id", "au_sequence", "arrival").join(F.broadcast(open_), "dataset_id", "left")
    before = F.lag("au_sequence").over(Window.partitionBy("dataset_id").orderBy("arrival"))
    bad = units.withColumn("rule", F.when(F.col("opened").isNull() | (F.col("arrival") < F.col("opened")), "unit before its dataset").when(F.col("au_sequence") <= before, "sequence doesn't ascend"))
    return bad.where("rule is not null").select("dataset_id", "au_sequence", "rule").unionByName(stream.select(F.lit(None).cast("int").alias("dataset_id"), F.lit(None).cast("long").alias("au_sequence"), "rule"))


def read_dataset(packets: DataFrame) -> tuple[dict[str, DataFrame], dict]:
    """The tables (runs, spectra, reads) of the dataset that a stream holds, and its header. A stream that breaks the order is
    an error. Headers, of which there is one a run, come to the driver; units are parsed where they are."""
    spark = packets.sparkSession
    if found := violations(packets).limit(1).collect():
        raise ValueError(f"{found[0][2]}: dataset {found[0][0]}, unit {found[0][1]}")
    head = parse_stream_header(bytes(packets.where(F.col("type") == STREAM_HEADER).first()["payload"]))
    sets = [parse_dataset_header(bytes(r[0])) for r in packets.where(F.col("type") == DATASET_HEADER).select("payload").collect()]
    rows = []
    for s in sets:
        about = json.loads(s["instrument_json"] or "{}")
        genomic = s["spectrum_class"].endswith("GenomicRead")  # other programs put a prefix before a class's name
        rows.append((s["name"], "genomic" if genomic else "spectral", s["spectrum_class"], s["acquisition_mode"], s["channel_names"], s["dataset_id"], s["expected_au_count"], about.get("reference_uri"), about.get("platform"), about.get("sample_name")))
    runs = spark.createDataFrame(rows, "run_name string, modality string, spectrum_class string, acquisition_mode int, channel_names array<string>, dataset_id int, spectrum_count long, reference_uri string, platform string, sample_name string")
    units = parse_units(packets, arrays=True).join(F.broadcast(runs.select("run_name", F.col("dataset_id").cast("long").alias("dataset_id"))), "dataset_id")
    genomic = F.col("spectrum_class") == CLASSES["GenomicRead"]
    spectra = units.where(~genomic).select("run_name", F.col("au_sequence").alias("spectrum_index"), "retention_time", "ms_level", "polarity", "precursor_mz", "precursor_charge", "base_peak_intensity", F.size(F.map_values("channels")[0]).cast("long").alias("length"), F.col("channels")["mz"].alias("mz"), F.col("channels")["intensity"].alias("intensity"), "channels")
    reads = units.where(genomic).select("run_name", F.col("au_sequence").alias("read_index"), "read_name", "chromosome", "position", "mapq", "flags", "cigar", F.col("seq").cast("string").alias("seq"), "qual", "mate_chromosome", "mate_position", "template_length", F.octet_length("seq").cast("long").alias("length"))
    return {"runs": runs, "spectra": spectra, "reads": reads}, head


def ordered_stream(packets: DataFrame) -> DataFrame:
    """Violations in a stream of packets: access units whose sequence doesn't ascend, or that come before their dataset's
    header or after its end. State is three numbers a dataset."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def check(key, frames, state):
        last, header, ended = state.get if state.exists else (-1, False, False)
        bad = []
        for pdf in frames:
            for kind, seq in zip(pdf["type"], pdf["au_sequence"]):
                if kind == DATASET_HEADER:
                    header = True
                elif kind == END_OF_DATASET:
                    ended = True
                elif kind == ACCESS_UNIT:
                    if not header or ended or seq <= last:
                        bad.append((key[0], int(seq), "header" if not header else "ended" if ended else "order"))
                    last = max(last, int(seq))
        state.update((last, header, ended))
        yield pd.DataFrame(bad, columns=["dataset_id", "au_sequence", "rule"])

    return packets.groupBy("dataset_id").applyInPandasWithState(check, "dataset_id int, au_sequence long, rule string", "last long, header boolean, ended boolean", "append", GroupStateTimeout.NoTimeout)


def subscribe(spark: SparkSession, folder: str, only: UnitFilter) -> DataFrame:
    """The units that pass a filter, of stream files as they are dropped into a folder (a streaming table). The cap max_au is
    one client's count and belongs to its sink: see capped_sink."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return parse_units(read_packets(files), arrays=True).where(only.condition())


def capped_sink(write, most: int | None):
    """For foreachBatch: calls write with the rows of each batch, in the stream's order, until `most` rows are through."""
    left = [most]

    def batch(df: DataFrame, _: int) -> None:
        if left[0] is not None:
            df = df.orderBy("dataset_id", "au_sequence").limit(left[0]).persist()
            left[0] -= df.count()
        write(df)
        df.unpersist()

    return batch


def fetch(address: tuple[str, int], only: UnitFilter, timeout: float = 30.0) -> list[tuple]:
    """Asks a server of streams (see serve) with one line of JSON, and returns its packets up to the end of the stream."""
    import dataclasses
    import socket

    wanted = {k: v for k, v in dataclasses.asdict(only).items() if v is not None}
    with socket.create_connection(address, timeout) as s:
        s.sendall(json.dumps({"type": "query", "filters": wanted}).encode() + b"\n")
        with s.makefile("rb") as f:
            return unpack(f.read())


def serve(tables: dict[str, DataFrame], clients: int = 1, host: str = "127.0.0.1", port: int = 0, ready=None, **about) -> None:
    """Answers so many clients, one after the other: each sends one JSON query and gets the packets that pass. A query that
    is no JSON object accepts all."""
    import socket

    with socket.create_server((host, port)) as s:
        if ready:
            ready(s.getsockname())
        for _ in range(clients):
            peer, _ = s.accept()
            with peer, peer.makefile("rb") as f:
                only = UnitFilter.parse(f.readline().decode("utf-8", "replace"))
                for r in ordered(dataset_stream(tables, only=only, **about)).select("packet").toLocalIterator():
                    peer.sendall(bytes(r[0]))


# -- simulated acquisition ------------------------------------------------------------------------------------------------


def simulate(spark: SparkSession, scans: int, seed: int = 42, scan_rate: float = 10.0, ms1_fraction: float = 0.3, mz_range: tuple[float, float] = (100.0, 2000.0), n_peaks: int = 200, start: int = 0) -> DataFrame:
    """A synthetic run: scan i at i / scan_rate, of level 1 with the given chance, else 2 with the largest peak of the last
    scan of level 1 as precursor (drawn where there is none yet). Every scan draws from its own seed, so that tasks need no
    order; only the last large peak is carried across, by a running function over narrow rows."""
    from pyspark.sql import Window

    low, high = mz_range

    def draw(batches):
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng((seed, i))
                first = bool(rng.random() < ms1_fraction)
                n = max(1, n_peaks + int(rng.integers(-(n_peaks // 4), n_peaks // 4 + 1)))
                mz, intensity = np.sort(rng.uniform(low, high, n)), rng.uniform(10.0, 1e6, n)
                rows.append((i, 1 if first else 2, float(mz[intensity.argmax()]) if first else None, float(rng.uniform(low, high)), 0 if first else int(rng.integers(2, 4)), float(intensity.max()), mz, intensity))
            if rows:
                types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["spectrum_index", "ms_level", "top", "spare", "precursor_charge", "base_peak_intensity", "mz", "intensity"])

    scans_ = spark.range(start, start + scans).mapInArrow(draw, "spectrum_index long, ms_level int, top double, spare double, precursor_charge int, base_peak_intensity double, mz array<double>, intensity array<double>")
    last = F.last("top", ignorenulls=True).over(Window.orderBy("spectrum_index").rowsBetween(Window.unboundedPreceding, -1))
    carried = scans_.select("spectrum_index", "ms_level", "top", "spare").withColumn("precursor_mz", F.when(F.col("ms_level") == 1, 0.0).otherwise(F.coalesce(last, "spare"))).select("spectrum_index", "precursor_mz")
    return scans_.drop("top", "spare").join(carried, "spectrum_index").select(F.lit("simulated_run").alias("run_name"), "spectrum_index", (F.col("spectrum_index") / scan_rate).alias("retention_time"), "ms_level", F.lit(1).alias("polarity"), "precursor_mz", "precursor_charge", "base_peak_intensity", F.size("mz").cast("long").alias("length"), "mz", "intensity")


def simulated_stream(spark: SparkSession, rows_per_second: int = 10, **how) -> DataFrame:
    """The same scans, unordered and without precursors, as a stream in real time."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    seed, n_peaks = how.get("seed", 42), how.get("n_peaks", 200)
    low, high = how.get("mz_range", (100.0, 2000.0))
    drawn = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "value"), F.lit(1 << 30)) / float(1 << 30)
    peak: Column = F.transform(F.sequence(F.lit(0), F.lit(n_peaks - 1)), lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("value"), k), F.lit(1 << 30)) / float(1 << 30))
    return rate.select(F.col("value").alias("spectrum_index"), F.col("timestamp"), F.when(drawn(-1) < how.get("ms1_fraction", 0.3), 1).otherwise(2).alias("ms_level"), F.array_sort(F.transform(peak, lambda x: low + x * (high - low))).alias("mz"))


# -- encrypted streams ----------------------------------------------------------------------------------------------------

CIPHER = "aes-256-gcm"


def protection_metadata(cipher: str = CIPHER, kek: str = "", wrapped: bytes = b"", signature: str = "", public: bytes = b"") -> bytes:
    """Cipher, algorithm and bytes of the wrapped key, algorithm of signatures and public key."""
    return _text(cipher) + _text(kek) + len(wrapped).to_bytes(4, "little") + wrapped + _text(signature) + len(public).to_bytes(4, "little") + public


def parse_protection(data: bytes) -> dict:
    out = {}
    out["cipher"], at = _read_text(data, 0)
    out["kek_algorithm"], at = _read_text(data, at)
    size = int.from_bytes(data[at : at + 4], "little")
    out["wrapped_dek"], at = data[at + 4 : at + 4 + size], at + 4 + size
    out["signature_algorithm"], at = _read_text(data, at)
    size = int.from_bytes(data[at : at + 4], "little")
    return out | {"public_key": data[at + 4 : at + 4 + size]}


def _segment_bytes(s: dict) -> bytes:
    return bytes(s["iv"]) + bytes(s["tag"]) + bytes(s["ciphertext"])


def write_sealed_units(units: DataFrame, channels: tuple[str, ...], checksum: bool = True) -> DataFrame:
    """dataset_id, au_sequence and packet of units whose channels are segments (protect.seal_channels), and whose filter keys
    are one too if they have a column header (protect.seal_headers). Bytes pass through as they are; no key is needed."""
    whole = "header" in units.columns
    flags = ENCRYPTED | (ENCRYPTED_HEADER if whole else 0)
    cells = [F.coalesce(F.col(c).cast(kind), F.lit(zero)).alias(c) if c in units.columns else F.lit(zero).cast(kind).alias(c) for c, (kind, zero) in _UNIT.items()]
    rows = units.select(F.col("dataset_id").cast("long").alias("dataset_id"), F.col("au_sequence").cast("long").alias("au_sequence"), *cells, *channels, *(["header"] if whole else []))

    def run(batches):
        for b in batches:
            found = {c: b.column(b.schema.names.index(c)).to_pylist() for c in [*channels, *(["header"] if whole else [])]}
            head = np.zeros(b.num_rows, PREFIX)
            for c in ("spectrum_class", "acquisition_mode", "ms_level", "precursor_charge", "retention_time", "precursor_mz", "ion_mobility", "base_peak_intensity"):
                head[c] = _col(b, c)
            head["polarity"], head["n_channels"] = wire_polarity(_col(b, "polarity")), len(channels)
            raw, size, payloads = head.tobytes(), PREFIX.itemsize, []
            for i in range(b.num_rows):
                first = bytes([head["spectrum_class"][i], len(channels)]) + _segment_bytes(found["header"][i]) if whole else raw[i * size : (i + 1) * size]
                payloads.append(first + b"".join(channel(c, FLOAT64, NONE, found[c][i]["length"] // 8, _segment_bytes(found[c][i])) for c in channels))
            made = pack_many(ACCESS_UNIT, payloads, _col(b, "dataset_id"), _col(b, "au_sequence"), checksum=checksum, flags=flags)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["dataset_id", "au_sequence", "packet"])

    return rows.mapInArrow(run, "dataset_id long, au_sequence long, packet binary")


def sealed_stream(units: DataFrame, runs: DataFrame, features: tuple[str, ...], channels: tuple[str, ...] = ("mz", "intensity"), title: str = "", checksum: bool = False, **protection) -> DataFrame:
    """The stream of a dataset whose rows are sealed: as dataset_stream, with a packet of protection metadata for each dataset
    after the stream's header. A dataset that doesn't say it is sealed is refused."""
    if "opt_per_au_encryption" not in features:
        raise ValueError("the dataset isn't sealed row by row: it lacks opt_per_au_encryption")
    spark, found = units.sparkSession, numbered_runs(runs)
    own = _numbered(units.drop("au_sequence"), found, "spectrum_index").withColumn("spectrum_class", F.lit(0))
    counts = {r[0]: r[1] for r in own.groupBy("run_name").count().collect()}
    about = protection_metadata(**protection)
    frame = [(_HEAD, 0, 0, pack(STREAM_HEADER, stream_header(title, "", list(features), len(found)), checksum=checksum))]
    for r in found:
        i, n = r["dataset_id"], counts.get(r["run_name"], 0)
        frame.append((_HEAD, i, 0, pack(PROTECTION, about, i, checksum=checksum)))
        frame.append((_DATASETS, i, 0, pack(DATASET_HEADER, dataset_header(i, r["run_name"], r.get("acquisition_mode") or 0, r.get("spectrum_class") or "MassSpectrum", list(channels), instrument_json(r.get("instrument")), n), i, checksum=checksum)))
        frame.append((_UNITS, i, 1 << 40, pack(END_OF_DATASET, struct.pack("<HI", i, n), i, checksum=checksum)))
    frame.append((_END, 1 << 20, 0, pack(END_OF_STREAM, b"", checksum=checksum)))
    out = spark.createDataFrame([(s, d, q, bytearray(p)) for s, d, q, p in frame], "section int, dataset_id long, au_sequence long, packet binary")
    return out.unionByName(write_sealed_units(own, channels, checksum).select(F.lit(_UNITS).alias("section"), "dataset_id", "au_sequence", "packet"))


def read_sealed(packets: DataFrame) -> tuple[DataFrame, list[str]]:
    """Units with their segments as they came (dataset_id, au_sequence, filter keys if they are clear, header, and channels, a
    map of names to segments), and the features a receiver adds. Nothing is decrypted. Units of a dataset without a header
    are an error."""
    if found := violations(packets).limit(1).collect():
        raise ValueError(f"{found[0][2]}: dataset {found[0][0]}, unit {found[0][1]}")
    kind = "struct<iv: binary, tag: binary, ciphertext: binary, length: int>"
    units = packets.where(F.col("type") == ACCESS_UNIT)
    sealed = units.agg(F.count_if(F.col("flags").bitwiseAND(ENCRYPTED) != 0), F.count_if(F.col("flags").bitwiseAND(ENCRYPTED_HEADER) != 0)).first()

    def run(batches):
        cut = lambda x, n: {"iv": x[:12], "tag": x[12:28], "ciphertext": x[28:], "length": n}
        for b in batches:
            heads, clear, maps = [], [], []
            for flags, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if flags & ENCRYPTED_HEADER:
                    n, at = p[1], 2 + 28 + 36
                    heads.append(cut(p[2:at], 36))
                    clear.append(None)
                else:
                    n, at = p[PREFIX.itemsize - 1], PREFIX.itemsize
                    heads.append(None)
                    clear.append(p[:at])
                found = []
                for _ in range(n):
                    name, at = _read_text(p, at)
                    _, _, count, size = struct.unpack_from("<BBII", p, at)
                    found.append((name, cut(p[at + 10 : at + 10 + size], 8 * count)))
                    at += 10 + size
                    if at > len(p):
                        raise ValueError("a channel is cut short")
                maps.append(found)
            s = pa.struct([("iv", pa.binary()), ("tag", pa.binary()), ("ciphertext", pa.binary()), ("length", pa.int32())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, s), pa.array(clear, pa.binary()), pa.array(maps, pa.map_(pa.string(), s))], ["dataset_id", "au_sequence", "header", "prefix", "channels"])

    out = units.select(F.col("dataset_id").cast("long").alias("dataset_id"), F.col("au_sequence").cast("long").alias("au_sequence"), "flags", "payload").mapInArrow(run, f"dataset_id long, au_sequence long, header {kind}, prefix binary, channels map<string, {kind}>")
    return out, (["opt_per_au_encryption"] if sealed[0] else []) + (["opt_encrypted_au_headers"] if sealed[1] else [])
