"""Readers and writers of sequence text: SAM, FASTA, FASTQ. Splittable formats are read and parsed by Spark's own functions."""

from __future__ import annotations

import gzip
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import fold

#: Mandatory SAM fields in order.
SAM = ["read_name", "flags", "chromosome", "position", "mapq", "cigar", "mate_chromosome", "mate_position", "template_length", "seq", "qual"]
FASTQ = "read_index long, read_name string, seq string, qual binary"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments in file order (source, block and line_no order them). RNEXT = reads as the read's own chromosome, SEQ and
    QUAL * as empty; positions stay 1-based. Fewer than 11 fields, or SEQ and QUAL of different lengths, are an error."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"))
    f = raw.where(~F.startswith("value", F.lit("@")) & (F.col("value") != "")).withColumn("f", F.split("value", "\t"))
    whole = F.when(F.size("f") < 11, F.raise_error(F.concat(F.lit("SAM line of too few fields: "), "value"))).otherwise(F.col("f"))
    out = f.select("source", "block", "line_no", whole.alias("f")).select("source", "block", "line_no", *[F.col("f")[i].alias(c) for i, c in enumerate(SAM)])
    star = lambda c: F.when(F.col(c) == "*", "").otherwise(F.col(c))
    out = out.withColumns({"mate_chromosome": F.when(F.col("mate_chromosome") == "=", F.col("chromosome")).otherwise(F.col("mate_chromosome")), "seq": star("seq"), "qual": star("qual")})
    odd = (F.col("seq") != "") & (F.col("qual") != "") & (F.length("seq") != F.length("qual"))
    ints = {c: F.col(c).cast("long" if c in ("flags", "position", "mate_position") else "int") for c in ("flags", "position", "mapq", "mate_position", "template_length")}
    return out.withColumns(ints | {"qual": F.when(odd, F.raise_error(F.concat(F.lit("SEQ and QUAL differ in length: "), "read_name"))).otherwise(F.col("qual"))})


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """record (SQ, RG, PG ...) and tags (map) of each header line but comments, in file order."""
    return header_records(spark.read.text(path).where(F.startswith("value", F.lit("@")) & ~F.startswith("value", F.lit("@CO"))))


def header_records(lines: DataFrame) -> DataFrame:
    """The same of header lines in the column value."""
    fields = F.filter(F.split("value", "\t"), lambda x, i: i > 0)
    tags = F.map_from_entries(F.transform(fields, lambda x: F.struct(F.substring(x, 1, 2), F.regexp_replace(x, "^..:", ""))))
    return lines.select(F.substring("value", 2, 2).alias("record"), tags.alias("tags"))


def run_of_sam(header: DataFrame, sample_name: str | None = None) -> dict:
    """Sample and platform of the first read group, the first reference's name, and a provenance record for each program."""
    rows = [(r["record"], r["tags"]) for r in header.collect()]
    group = next((t for k, t in rows if k == "RG"), {})
    steps = [{"software": t.get("PN") or t.get("ID", ""), "parameters": {k: v for k, v in t.items() if k in ("ID", "VN", "CL", "PP")}} for k, t in rows if k == "PG"]
    return {"sample_name": sample_name or group.get("SM", ""), "platform": group.get("PL", ""), "reference_uri": next((t.get("SN", "") for k, t in rows if k == "SQ"), ""), "provenance": steps}


def in_sam_region(region: str) -> Column:
    """Reads that overlap chr, chr:start or chr:start-end, places from 1, both ends in."""
    from ..operators.anonymize import reference_span

    name, _, span = region.partition(":")
    out = F.col("chromosome") == name
    if span:
        low, _, high = span.replace(",", "").partition("-")
        end = F.col("position") + F.greatest(reference_span(F.col("cigar")), F.lit(1)) - 1
        out = out & (end >= int(low))
        if high:
            out = out & (F.col("position") <= int(high))
    return out


#: Length that a synthesised header gives each reference, since runs don't know it.
SQ_LENGTH = 2147483647


def sam_header_lines(reads: DataFrame, sample_name: str = "", platform: str = "", provenance: tuple[dict, ...] = (), sort: bool = True, lengths: dict[str, int] | None = None) -> list[str]:
    """Header lines of a run: references in order of first appearance, a read group, and a program for each provenance record,
    whose repeated names get numbers."""
    from ..operators.index import encounter_order

    seen = encounter_order(reads.where("chromosome is not null and chromosome not in ('', '*')"), "chromosome", "read_index").orderBy("ordinal").collect()
    out = [f"@HD\tVN:1.6\tSO:{'coordinate' if sort else 'unsorted'}"]
    out += [f"@SQ\tSN:{r['chromosome']}\tLN:{(lengths or {}).get(r['chromosome'], SQ_LENGTH)}" for r in seen]
    if sample_name or platform:
        out.append("\t".join(["@RG", "ID:rg1", *([f"SM:{sample_name}"] if sample_name else []), *([f"PL:{platform}"] if platform else [])]))
    used: set[str] = set()
    for i, p in enumerate(provenance):
        base = name = p.get("software") or f"pg{i}"
        n = 1
        while name in used:
            name, n = f"{base}.{n}", n + 1
        used.add(name)
        line = (p.get("parameters") or {}).get("CL")
        out.append("\t".join(["@PG", f"ID:{name}", f"PN:{p.get('software') or ''}", *([f"CL:{line}"] if line else [])]))
    return out


def sam_lines(reads: DataFrame) -> DataFrame:
    """One SAM line a read: a mate on the same chromosome is =, a negative mate position 0, empty texts and qualities that are
    all 0xFF are *."""
    star = lambda c: F.when(F.coalesce(F.octet_length(c), F.lit(0)) == 0, "*").otherwise(F.col(c).cast("string"))
    mate = F.when((F.col("mate_chromosome") == F.col("chromosome")) & (F.col("chromosome") != "*"), "=").otherwise(star("mate_chromosome"))
    none = F.hex(F.col("qual").cast("binary")).rlike("^(FF)+$")
    fields = {"read_name": star("read_name"), "chromosome": star("chromosome"), "cigar": star("cigar"), "mate_chromosome": mate, "mate_position": F.greatest("mate_position", F.lit(0)), "seq": star("seq"), "qual": F.when((star("seq") == "*") | none, "*").otherwise(star("qual"))}
    return reads.select(F.concat_ws("\t", *[fields.get(c, F.col(c)).cast("string") for c in SAM]).alias("value"))


def write_sam(reads: DataFrame, path: str, sort: bool = True, **about) -> None:
    """A SAM file of one run as parts in order: the header, then the reads, by coordinate or as they are numbered. Sorting is a
    range partitioning over all tasks."""
    from ..operators.index import coordinate_sorted
    from .files import put, write_parts

    header = sam_header_lines(reads, sort=sort, **about)
    put(f"{path}/0-header.sam", ("\n".join(header) + "\n").encode())
    ranked = coordinate_sorted(reads) if sort else reads.withColumn("sort_rank", F.col("read_index"))
    unplaced = F.when(F.coalesce(F.col("chromosome"), F.lit("*")).isin("", "*"), 1).otherwise(0) if sort else F.lit(0)
    lines = ranked.orderBy(unplaced, "run_name", "sort_rank") if "run_name" in reads.columns else ranked.orderBy(unplaced, "sort_rank")
    write_parts(sam_lines(lines).select(F.concat("value", F.lit("\n")).cast("binary")), f"{path}/1-reads", "sam")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (the header's first word), seq (letters as they are) and length of each record. A header is a > at a line's start:
    the separator of the scan is a line end with >, so one file is read by many tasks and a > within a header is none of its
    business; only single records need to fit into memory. Files without any record are an error, found by a look at the
    first one."""
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.trim(F.regexp_replace("value", r"[\r\n>]", "")) != "")
    value = F.regexp_replace("value", "^>", "")
    seq = F.regexp_replace(F.regexp_replace(value, r"^[^\n]*(\n|$)", ""), r"\s", "")
    out = rows.select(F.regexp_extract(value, r"^[ \t]*(\S*)", 1).alias("name"), seq.alias("seq"))
    if out.isEmpty():
        raise ValueError(f"{path} has no record")
    return out.withColumn("length", F.length("seq").cast("long"))


def unaligned(records: DataFrame) -> DataFrame:
    """Records (name, seq) as unaligned reads: sentinels in all alignment columns, qualities 0xFF."""
    return records.select(F.col("name").alias("read_name"), F.lit(4).cast("long").alias("flags"), F.lit("*").alias("chromosome"), F.lit(0).cast("long").alias("position"), F.lit(255).alias("mapq"), F.lit("*").alias("cigar"), F.lit("*").alias("mate_chromosome"), F.lit(-1).cast("long").alias("mate_position"), F.lit(0).alias("template_length"), "seq", F.unhex(F.repeat(F.lit("ff"), F.length("seq"))).alias("qual"), F.length("seq").cast("long").alias("length"))


def fasta_lines(records: DataFrame, width: int = 60) -> DataFrame:
    return records.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace(fold(F.col("seq"), width), "\n$", "")).alias("value"))


def phred_offset(least: int | None, most: int | None) -> int:
    """64 if every byte lies in 64 to 104, else 33."""
    return 64 if least is not None and least >= 64 and most <= 104 else 33


#: Bytes of a plain FASTQ file that one task parses.
CHUNK = 32 << 20


def _records(stream, size: int | None):
    """Four lines each of the records that begin within the first `size` bytes of a stream (None: all of them)."""
    now, at = [], 0
    for line in stream:
        if not now and not line.strip():
            at += len(line)
            continue
        if not now and size is not None and at >= size:
            return
        at += len(line)
        now.append(line.rstrip(b"\r\n"))
        if len(now) == 4:
            name, seq, plus, qual = now
            if name[:1] != b"@" or plus[:1] != b"+" or len(seq) != len(qual):
                raise ValueError(f"malformed FASTQ record {name!r}")
            yield name, seq, qual
            now = []
    if now:
        raise ValueError("the last FASTQ record is cut short")


def _record_start(f, start: int) -> int:
    """The first place from start on where a record begins: a line that starts with @, and, two lines on, one with +, whose
    lengths fit. Qualities may begin with @ too, but then the line two on is a sequence."""
    if not start:
        return 0
    f.seek(start - 1)
    at = start - 1 + len(f.readline())
    while True:
        f.seek(at)
        lines = [f.readline() for _ in range(4)]
        if not lines[0]:
            return at
        if lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1].strip()) == len(lines[3].strip()):
            return at
        at += len(lines[0])


def read_fastq(spark: SparkSession, path: str, offset: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Records of FASTQ files, numbered within their file (source), with Phred+33 qualities. Plain files are cut into ranges,
    each parsed from its first record on by a task of its own; gzip can't be cut. Blank lines between records are passed over;
    other lines out of place, or lengths that differ, are an error. Without an offset, the least and the greatest quality
    byte of all files tell it: 64 if all lie in 64 to 104, else 33."""
    from ..operators.index import reindexed
    from .files import open_range

    files = spark.read.format("binaryFile").load(path).select("path", "length", F.expr("path like '%.gz'").alias("zipped"))
    cut = F.when(F.col("zipped"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk).cast("long")))
    ranges = files.select("path", "zipped", F.explode(cut).alias("start")).repartition("path", "start")

    def parse(batches):
        for b in batches:
            for name, zipped, start in zip(*(c.to_pylist() for c in b.columns)):
                with open_range(name) as raw:
                    if zipped:
                        found = _records(gzip.open(raw), None)
                    else:
                        first, end = _record_start(raw, start), _record_start(raw, start + chunk)
                        raw.seek(first)
                        found = _records(raw, max(0, end - first))
                    rows = []
                    for i, (title, seq, qual) in enumerate(found):
                        words = title[1:].split()
                        rows.append((name, (start << 20) + i, words[0].decode() if words else "", seq.decode(), qual, min(qual, default=None), max(qual, default=None)))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    names = "source string, read_index long, read_name string, seq string, qual binary, least int, most int"
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32()]
    _batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in names.split(", ")])
    reads = ranges.mapInArrow(parse, names)
    if offset is None:
        offset = phred_offset(*reads.agg(F.min("least"), F.max("most")).first())
    reads = reindexed(reads.drop("least", "most"), "source", "read_index")
    return shift_qualities(reads, 33 - offset) if offset != 33 else reads


def shift_qualities(reads: DataFrame, by: int) -> DataFrame:
    """Adds to every quality byte, modulo 256."""

    def run(batches):
        for b in batches:
            at = b.schema.names.index("qual")
            made = [None if q is None else (np.frombuffer(q, np.uint8) + np.uint8(by % 256)).tobytes() for q in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return reads.mapInArrow(run, reads.schema)


def fasta_index(records: DataFrame, order: str, width: int = 60) -> DataFrame:
    """name, length, offset, line_bases and line_bytes of each record of a FASTA file that fasta_lines writes in an order."""
    from ..operators.index import running_bytes

    head, n = F.octet_length("name") + 2, F.length("seq")
    lines = F.ceil(n / width)
    sized = running_bytes(records.withColumn("_all", F.lit(0)), ["_all"], order, head + n + lines, "at")
    return sized.select("name", n.cast("long").alias("length"), (F.col("at") + head).alias("offset"), F.least(n, F.lit(width)).cast("long").alias("line_bases"), (F.least(n, F.lit(width)) + 1).cast("long").alias("line_bytes"))


def write_fasta(records: DataFrame, path: str, order: str, width: int = 60) -> None:
    """A FASTA file as parts in order, and its index beside it; names seen before get their number."""
    from ..operators.index import unique_names
    from .files import write_parts

    named = unique_names(records, "name", order).withColumn("name", F.col("unique_name")).drop("unique_name")
    write_parts(fasta_lines(named.orderBy(order), width).select(F.concat("value", F.lit("\n")).cast("binary")), path, "fa")
    write_parts(fasta_index(named, order, width).orderBy("offset").select(F.concat(F.concat_ws("\t", "name", "length", "offset", "line_bases", "line_bytes"), F.lit("\n")).cast("binary")), path.rstrip("/") + "-fai", "fai")


def write_fastq(reads: DataFrame, path: str, offset: int = 33, order: str = "read_index") -> None:
    """A FASTQ file as parts in order; names seen before get their number; qualities that are missing are the lowest one."""
    from ..operators.index import unique_names
    from .files import write_parts

    if offset not in (33, 64):
        raise ValueError(f"no offset {offset}")
    named = unique_names(reads, "read_name", order).withColumn("read_name", F.col("unique_name")).drop("unique_name")
    filled = fastq_lines(named.orderBy(order), offset)
    write_parts(filled.select(F.concat("value", F.lit("\n")).cast("binary")), path, "fq")


def fastq_lines(reads: DataFrame, offset: int = 33) -> DataFrame:
    """Four lines a read in one value; missing qualities (0xFF) are written as !, all others moved up to the offset."""
    by = offset - 33

    def run(batches):
        for b in batches:
            out = []
            for name, seq, qual in zip(*(c.to_pylist() for c in b.columns)):
                q = np.frombuffer(qual or b"", np.uint8)
                q = np.where(q == 255, 33, q) + np.uint8(by)
                out.append(f"@{name}\n{seq}\n+\n" + q.astype(np.uint8).tobytes().decode("latin-1"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return reads.select("read_name", F.col("seq").cast("string"), F.col("qual").cast("binary")).mapInArrow(run, "value string")


# -- BAM ------------------------------------------------------------------------------------------------------------------

_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
BAM = "read_name string, flags long, chromosome string, position long, mapq int, cigar string, mate_chromosome string, mate_position long, template_length int, seq string, qual string"


def _blocks(path: str) -> list[tuple[int, int]]:
    """Place and size of each zlib block of a BAM file, from the sizes in the blocks' own headers; nothing is inflated."""
    from .files import open_range

    out, at = [], 0
    with open_range(path) as f:
        while True:
            f.seek(at)
            head = f.read(18)
            if len(head) < 18:
                break
            if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
                raise ValueError(f"no block at {at} of {path}")
            size = int.from_bytes(head[16:18], "little") + 1
            out.append((at, size))
            at += size
    if not out:
        raise ValueError(f"{path} is empty")
    return out


def _inflate(f, at: int, size: int) -> bytes:
    f.seek(at)
    raw = f.read(size)
    return zlib.decompress(raw[18:-8], -15)


def _bam_header(path: str) -> tuple[str, list[str], int]:
    """The header's text, the references' names and the place in the inflated file where reads begin."""
    from .files import open_range

    data = b""
    with open_range(path) as f:
        blocks = iter(_blocks(path))

        def need(n: int) -> None:
            nonlocal data
            while len(data) < n:
                data += _inflate(f, *next(blocks))

        need(12)
        if data[:4] != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        (length,) = struct.unpack_from("<i", data, 4)
        need(12 + length)
        text, at = data[8 : 8 + length].rstrip(b"\0").decode(), 8 + length
        (n,), at, names = struct.unpack_from("<i", data, at), at + 4, []
        for _ in range(n):
            need(at + 4)
            (size,) = struct.unpack_from("<i", data, at)
            need(at + 8 + size)
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
    return text, names, at


def _bam_read(raw: bytes, names: list[str]) -> tuple:
    ref, pos, size, mapq, _, ops, flags, n, mate, mate_pos, length = struct.unpack_from("<iiBBHHHiiii", raw)
    name, at = raw[32 : 31 + size].decode(), 32 + size
    cigar = "".join(f"{v >> 4}{_OPS[v & 15]}" for v in struct.unpack_from(f"<{ops}I", raw, at)) or "*"
    at += 4 * ops
    packed = np.frombuffer(raw, np.uint8, (n + 1) // 2, at)
    codes = np.stack([packed >> 4, packed & 15], axis=1).ravel()[:n]
    seq = np.frombuffer(_BASES.encode(), np.uint8)[codes].tobytes().decode()
    q = np.frombuffer(raw, np.uint8, n, at + len(packed))
    qual = "" if not n or (q == 255).all() else (q + np.uint8(33)).tobytes().decode("latin-1")
    known = lambda i: names[i] if i >= 0 else "*"
    return name, flags, known(ref), pos + 1, mapq, cigar, known(mate), mate_pos + 1, length, seq, qual


def read_bam(spark: SparkSession, path: str, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads of a BAM file in its order (line_no), as read_sam gives them, and its header lines as sam_header does.

    Blocks are inflated by many tasks at once. Reads may lie across blocks, so inflated sizes are summed up to places first,
    and a walk over the sizes of reads, which needs no more than their first four bytes, tells which block each begins in.
    """
    text, names, first = _bam_header(path)
    blocks = _blocks(path)
    from .files import open_range

    def sizes(batches):
        for b in batches:
            with open_range(path) as f:
                out = []
                for at, size in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    f.seek(at + size - 4)
                    out.append(int.from_bytes(f.read(4), "little"))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["nth", "inflated"])

    table = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(blocks)], "nth long, at long, size long").repartition(max(1, min(64, len(blocks) // 256 + 1)))
    plain = dict(table.mapInArrow(sizes, "nth long, inflated long").collect())
    starts = np.concatenate(([0], np.cumsum([plain[i] for i in range(len(blocks))])))
    # The walk: reads' places in the inflated file, cut into runs of whole reads of some megabytes for the tasks.
    cuts, at, total, n = [], first, int(starts[-1]), 0
    with open_range(path) as f:
        held = (-1, b"")

        def peek(place: int) -> int:
            nonlocal held
            out = b""
            while len(out) < 4:
                i = int(np.searchsorted(starts, place + len(out), "right")) - 1
                if held[0] != i:
                    held = (i, _inflate(f, *blocks[i]))
                k = place + len(out) - int(starts[i])
                out += held[1][k : k + 4 - len(out)]
            return struct.unpack("<i", out)[0]

        while at < total:
            if not cuts or at - cuts[-1][0] >= 4 << 20:
                cuts.append((at, n))
            at += 4 + peek(at)
            n += 1
    if at != total:
        raise ValueError("the last read is cut short")
    spans = [(a, (cuts[i + 1][0] if i + 1 < len(cuts) else total), k) for i, (a, k) in enumerate(cuts)]

    def parse(batches):
        for b in batches:
            with open_range(path) as f:
                for begin, end, k in zip(*(c.to_pylist() for c in b.columns)):
                    low, high = int(np.searchsorted(starts, begin, "right")) - 1, int(np.searchsorted(starts, end, "left"))
                    data = b"".join(_inflate(f, *blocks[i]) for i in range(low, high))[begin - int(starts[low]) :]
                    rows, at = [], 0
                    while at < end - begin:
                        (size,) = struct.unpack_from("<i", data, at)
                        rows.append((k + len(rows), *_bam_read(data[at + 4 : at + 4 + size], names)))
                        at += 4 + size
                    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["line_no", *SAM])

    reads = spark.createDataFrame(spans, "begin long, stop long, k long") if spans else spark.createDataFrame([], "begin long, stop long, k long")
    reads = reads.repartition(max(1, len(spans))).mapInArrow(parse, "line_no long, " + BAM)
    lines = spark.createDataFrame([(line,) for line in text.splitlines() if line.startswith("@") and not line.startswith("@CO")] or [("@HD\tVN:1.6",)], "value string")
    return (reads.where(in_sam_region(region)) if region else reads), header_records(lines)


def _bam_bytes(row: dict, ids: dict[str, int]) -> bytes:
    name, seq = (row["read_name"] or "*").encode() + b"\0", "" if row["seq"] in (None, "*") else row["seq"]
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    codes = [_BASES.index(c) if c in _BASES else 15 for c in seq.upper()]
    codes += [0] * (len(codes) % 2)
    raw_q = (row["qual"] or "").encode("latin-1")
    qual = bytes(v - 33 for v in raw_q) if raw_q and raw_q != b"*" else b"\xff" * len(seq)
    chromosome = row["chromosome"] or "*"
    mate = chromosome if row["mate_chromosome"] == "=" else row["mate_chromosome"] or "*"
    span = sum(n for n, op in ops if op in "MDN=X") or 1
    pos = row["position"] - 1
    body = struct.pack("<iiBBHHHiiii", ids.get(chromosome, -1), pos, len(name), row["mapq"], _bin(pos, pos + span), len(ops), row["flags"], len(seq), ids.get(mate, -1), max(0, row["mate_position"] or 0) - 1, row["template_length"] or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | _OPS.index(op)) for n, op in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + qual
    return struct.pack("<i", len(body)) + body


def _bin(begin: int, end: int) -> int:
    """Number of the smallest of the nested bins of 16 kb to 512 Mb that holds a span."""
    if begin < 0:
        return 4680
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def _deflate(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


#: The empty block that ends a file, and the bytes of a block before it is packed.
_END, _PLAIN = _deflate(b""), 60_000


def write_bam(reads: DataFrame, path: str, sort: bool = True, **about) -> None:
    """A BAM file of one run as parts in order, which put together are the file: header, reads in blocks, end. Every task packs
    its own reads; references get the numbers of the header."""
    from ..operators.index import coordinate_sorted
    from .files import put, write_parts

    header = sam_header_lines(reads, sort=sort, **about)
    refs = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in header if line.startswith("@SQ")]
    ids, text = {r["SN"]: i for i, r in enumerate(refs)}, ("\n".join(header) + "\n").encode()
    raw = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(r["SN"]) + 1) + r["SN"].encode() + b"\0" + struct.pack("<i", int(r["LN"])) for r in refs)
    put(f"{path}/0-header.bam", b"".join(_deflate(raw[i : i + _PLAIN]) for i in range(0, len(raw), _PLAIN)))

    def packed(batches):
        held = b""
        for b in batches:
            for row in b.to_pylist():
                held += _bam_bytes(row, ids)
                while len(held) >= _PLAIN:
                    yield pa.RecordBatch.from_arrays([pa.array([_deflate(held[:_PLAIN])], pa.binary())], ["block"])
                    held = held[_PLAIN:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_deflate(held)], pa.binary())], ["block"])

    ranked = coordinate_sorted(reads) if sort else reads.withColumn("sort_rank", F.col("read_index"))
    unplaced = F.when(F.coalesce(F.col("chromosome"), F.lit("*")).isin("", "*"), 1).otherwise(0) if sort else F.lit(0)
    own = ranked.orderBy(unplaced, "sort_rank").select(*[F.col(c).cast("string" if c in ("seq", "qual") else dict(reads.dtypes)[c]) for c in SAM])
    write_parts(own.mapInArrow(packed, "block binary"), f"{path}/1-reads", "bam")
    put(f"{path}/2-end.bam", _END)


def dump_reads(reads: DataFrame, name: str, about: dict, order: str = "line_no") -> dict:
    """What a dump of a file of reads says, for canonical JSON: columns in order, and MD5s of all sequences and all qualities. It is
    for files that a person compares; rows stream through the driver."""
    import hashlib

    seq, qual, lists = hashlib.md5(), hashlib.md5(), {}
    fields = {"read_names": "read_name", "positions": "position", "chromosomes": "chromosome", "flags": "flags", "mapping_qualities": "mapq", "cigars": "cigar", "mate_chromosomes": "mate_chromosome", "mate_positions": "mate_position", "template_lengths": "template_length"}
    lists = {k: [] for k in fields}
    for r in reads.orderBy(order).toLocalIterator():
        for k, c in fields.items():
            lists[k].append(r[c])
        seq.update((r["seq"] or "").encode())
        qual.update((r["qual"] or "").encode())
    return {"name": name, "read_count": len(lists["read_names"]), "sample_name": about["sample_name"], "platform": about["platform"], "reference_uri": about["reference_uri"], **lists, "sequences_md5": seq.hexdigest(), "qualities_md5": qual.hexdigest(), "provenance_count": len(about["provenance"])}


def read_cram(*_, **__):
    """CRAM needs htslib, which isn't here; convert to BAM or SAM first."""
    raise NotImplementedError("CRAM needs htslib: convert it to BAM or SAM first")
