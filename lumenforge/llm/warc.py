"""WARC archives with an index: records are written once, an index row (archive, offset, length, URL, digest) with each;
selected records are read back by byte ranges, sorted and coalesced."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.files import filesystem
from .common import drop_table, fresh_path, materialize, small_or_shuffled

#: Payloads under so many bytes are never revisits.
REVISIT_FROM = 100
#: HTML bytes an archive gets on average.
ARCHIVE_BYTES = 256 << 20
#: Ranges of one archive that lie at most GAP apart are read at once, up to MOST bytes.
GAP, MOST = 64 << 10, 8 << 20
#: Nothing in a record depends on the time of writing, so a task that runs again writes the same bytes.
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, url string, digest string, record_type string, archive string, offset long, length long"


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member with one record. A revisit carries the headers of its payload only."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        *([] if url is None else [f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D', 37: '%25'})}"]),
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises ValueError if it is cut short or malformed."""
    unpack = zlib.decompressobj(31)
    raw = unpack.decompress(member) + unpack.flush()
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not (unpack.eof and found and lines[0].startswith("WARC/")):
        raise ValueError("not a whole WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError(f"a record of {size} bytes has {len(rest) - 4}")
    return headers, rest[:size]


def _page(urn: str):
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "None" else int(found)


def _url(headers: dict[str, str]) -> str | None:
    """The URL as it was given: line ends and percent signs are escaped in a header; a record without one has no URL."""
    found = headers.get("WARC-Target-URI")
    return None if found is None else found.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def write_archives(pages: DataFrame, to: str) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) below the folder `to`, which all executors share, and returns
    the index, itself a table in the shared folder.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of REVISIT_FROM bytes or more the one with
    the least page_id (null last) is a response, the others refer to it; of repeated rows with that page_id one is. Where all
    ids of a payload are null there is none to refer to, and all are responses. URLs may be null. Whatever other columns pages has is left out. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    # Only digests, ids and sizes are held against each other; the payloads move once, to their archive.
    meta = materialize(own.select("page_id", "digest", "size"), "warc-meta")
    leaders = meta.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    total = meta.agg(F.sum("size")).first()[0] or 0
    archives = max(2 * spark.sparkContext.defaultParallelism, -(-total // ARCHIVE_BYTES))
    rows = own.join(small_or_shuffled(leaders), "digest", "left").select("page_id", "url", "html", "digest", "size", "leader")

    def write(batches):
        fs, folder = filesystem(to)
        fs.create_dir(folder, recursive=True)
        # The name comes from the task's first row: a task that runs again writes the same bytes to the same name.
        name = part = out = None
        at, seen, index = 0, set(), []
        try:
            for b in batches:
                for page, url, html, digest, size, leader in zip(*(c.to_pylist() for c in b.columns)):
                    payload = html.encode()
                    if out is None:
                        name = hashlib.sha256(f"{page}|{url}|{digest}".encode()).hexdigest()[:24] + ".warc.gz"
                        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                        out = fs.open_output_stream(part, compression=None)
                    first = leader is not None and page == leader and digest not in seen
                    if first:
                        seen.add(digest)
                    refers = None if leader is None or first else leader
                    member = _record(page, url, payload, digest, refers)
                    out.write(member)
                    index.append((page, url, digest, "response" if refers is None else "revisit", name, at, len(member)))
                    at += len(member)
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(part)
            raise
        if out is not None:
            out.close()
        if out is not None:
            fs.move(part, f"{folder}/{name}")
        for i in range(0, len(index), 10_000):
            columns = list(zip(*index[i : i + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])], ["page_id", "url", "digest", "record_type", "archive", "offset", "length"])

    placed = rows.repartition(int(archives), F.xxhash64("page_id", "digest")).sortWithinPartitions("page_id", "url", "digest")
    index = materialize(placed.mapInArrow(write, INDEX), "warc-index")
    drop_table(meta)
    return index


def read_records(index: DataFrame, at: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit) of the index rows.

    The rows are sorted by archive and offset, neighbouring ranges read at once. Every record is held against its index row,
    and a response's payload against its digest. An empty index gives no rows; repeated index rows read a record again.
    """

    def read(batches):
        fs, folder = filesystem(at)

        def runs():
            run, end = [], 0
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    archive, offset, length = row[1:]
                    if run and (archive != run[0][1] or offset - end > GAP or offset + length - run[0][2] > MOST):
                        yield run
                        run = []
                    run.append(row)
                    end = offset + length
            if run:
                yield run

        for run in runs():
            with fs.open_input_file(f"{folder}/{run[0][1]}") as f:
                block = f.read_at(run[-1][2] + run[-1][3] - run[0][2], run[0][2])
            out = []
            for digest, _, offset, length in run:
                headers, payload = parse(block[offset - run[0][2] :][:length])
                kind, said = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(headers["WARC-Payload-Length"])
                if said != digest or kind == "response" and (hashlib.sha256(payload).hexdigest() != said or len(payload) != size):
                    raise ValueError(f"{run[0][1]} at {offset}: the payload isn't what the index says")
                refers = _page(headers["WARC-Refers-To"]) if kind == "revisit" else None
                out.append((_page(headers["WARC-Record-ID"]), _url(headers), kind, refers, size, said, payload if kind == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    wanted = index.select("digest", "archive", "offset", "length").repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return wanted.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    to = fresh_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), to)
    return read_records(index, to).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes from pages),
r as (select *, min(page_id) over (partition by payload_digest) as leader from p)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes < 100 or page_id = leader then 'response' else 'revisit' end as record_type,
    case when payload_bytes < 100 or page_id = leader then null else leader end as refers_to
from r
"""
