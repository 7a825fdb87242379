"""Benchmark decontamination: hashed windows of benchmark words, broadcast; token windows of each document looked up in
them, and every hit verified word by word. Spans or whole documents can then be removed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import columns_free, drop_table, materialize, share, utf8

WINDOW = 10
#: The benchmark is broadcast up to so many bytes of text, in one piece; beyond, in pieces of that size, one scan for each, so
#: that a task holds one piece's index at a time.
PIECE_BYTES = 32 << 20
#: On UTF-8 bytes after A-Z were lower-cased, this is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on code points.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MUL = 0x9E3779B97F4A7C15


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


class WindowIndex:
    """Windows of benchmark items by length, as arrays: sorted hashes and the place of each window among all words, which are
    numbers of a vocabulary. Built once, on the driver, and sent as it is: some 25 bytes a word."""

    def __init__(self, items, window: int = WINDOW):
        self.ids, self.items, parts, starts = {}, [], [], {}
        at = 0
        for item, text in items:
            w = words(text)
            if w:
                size = min(window, len(w))
                starts.setdefault(size, []).append(np.arange(at, at + len(w) - size + 1, dtype=np.int64))
                parts.append(np.fromiter((self.ids.setdefault(x, len(self.ids) + 1) for x in w), np.uint32, len(w)))
                self.items.append((at, "" if item is None else str(item)))
                at += len(w)
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.begins = np.array([i for i, _ in self.items], np.int64)
        self.items = [name for _, name in self.items]
        self.windows = {}
        for size, found in starts.items():
            places = np.concatenate(found)
            hashes = self._roll(self.flat, size)[places]
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], places[order].astype(np.uint32)

    @staticmethod
    def _roll(ids: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(ids) - size + 1, np.uint64)
        for i in range(size):
            out *= np.uint64(_MUL)
            out ^= out >> np.uint64(29)
            out += ids[i : len(ids) - size + 1 + i]
        return out

    def scan(self, w: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items with occurring windows; words are compared one by one
        where hashes are equal."""
        hit, items = np.zeros(len(w) + 1, np.int32), set()
        known = self.ids.get
        ids = np.fromiter((known(x, 0) for x in w), np.uint32, len(w))
        for size, (hashes, places) in self.windows.items():
            if len(w) < size:
                continue
            rolled = self._roll(ids, size)
            low = np.searchsorted(hashes, rolled)
            low[low == len(hashes)] = 0
            at = np.flatnonzero(hashes[low] == rolled)
            for i, first, end in zip(at.tolist(), low[at].tolist(), np.searchsorted(hashes, rolled[at], "right").tolist()):
                same = (self.flat[places[first:end, None] + np.arange(size, dtype=np.uint32)] == ids[i : i + size]).all(axis=1)
                if same.any():
                    owners = np.unique(np.searchsorted(self.begins, places[first:end][same], "right") - 1)
                    items.update(self.items[k] for k in owners.tolist())
                    hit[i] += 1
                    hit[i + size] -= 1
        return np.cumsum(hit[:-1]) > 0, items


def _pieces(bench: DataFrame):
    """Lists of (item_id, text as bytes) of bounded size each, streamed from the benchmark."""
    piece, size = [], 0
    for row in bench.select("item_id", "text").toLocalIterator():
        text = row[1].encode() if row[1] is not None else None
        piece.append((row[0], text))
        size += len(text or b"")
        if size >= PIECE_BYTES:
            yield piece
            piece, size = [], 0
    yield piece


def _spans(low: bytes, hit: np.ndarray) -> list[int]:
    """Start and end, in bytes, of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).reshape(-1, 2)
    at = [m.span() for m in WORD.finditer(low)]
    return [x for i, j in edge.tolist() for x in (at[i][0], at[j - 1][1])]


def _unmark(low: bytes, spans: list[int]) -> np.ndarray:
    at = np.array([m.start() for m in WORD.finditer(low)], np.int64)
    return np.searchsorted(spans, at, "right") % 2 == 1 if spans else np.zeros(len(at), bool)


def scan_documents(docs: DataFrame, bench: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs, all columns or those to keep, with one more, and its name: a struct of n_words, n_hit, items (sorted array of item
    ids) and spans (array of starts and ends of the hit parts, in bytes of the UTF-8 text).

    A word is hit if it lies in any occurrence of any window of any item. Null text has no words; repeated documents are
    scanned alike; an item without words has no window; a null item_id reads as ''; repeated items count once. An empty
    benchmark hits nothing; an empty table gives no rows. Other columns pass through, whatever their names. Nothing is
    shuffled. A benchmark beyond PIECE_BYTES is scanned for piece by piece; the table is written between two pieces.
    """
    (name,) = columns_free(docs, "scan")
    kind = "struct<n_words: long, n_hit: long, items: array<string>, spans: array<long>>"
    out, at = docs.withColumn(name, F.lit(None).cast(kind)), docs.columns.index("text")
    pieces, last = _pieces(bench), None
    piece = next(pieces)
    while piece is not None:
        shared, piece = share(docs.sparkSession, WindowIndex(piece, window)), next(pieces, None)
        kept = range(len(docs.columns)) if piece is not None or keep is None else [docs.columns.index(c) for c in keep]
        names = [docs.columns[i] for i in kept]

        def scan(batches, shared=shared, kept=list(kept), names=names):
            index = shared()
            for b in batches:
                rows = []
                for text, before in zip(utf8(b.column(at)), b.column(b.num_columns - 1).to_pylist()):
                    low = (text or b"").lower()
                    w = WORD.findall(low)
                    hit, items = index.scan(w)
                    if before and before["items"]:
                        hit, items = hit | _unmark(low, before["spans"]), items | set(before["items"])
                    rows.append({"n_words": len(w), "n_hit": int(hit.sum()), "items": sorted(items), "spans": _spans(low, hit) if items else []})
                found = pa.array(rows, b.schema.field(b.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), found], names=[*names, name])

        schema = T.StructType([*(out.schema.fields[i] for i in kept), out.schema[name]])
        out = out.mapInArrow(scan, schema)
        if piece is not None:
            out = materialize(out, "scanned")
            if last is not None:
                drop_table(last)
            last = out
    return out, name


def remove_spans(docs: DataFrame, bench: DataFrame, most: float = 0.0, window: int = WINDOW) -> DataFrame:
    """docs without benchmark text, all columns kept: documents of which more than the share `most` of words is hit go; from
    the others the hit spans are cut out. With most = 0 every hit document goes; with most = 1 only spans go. Documents with
    null or empty text have no words and stay as they are; repeated rows share their fate; an empty table gives no rows."""
    scanned, name = scan_documents(docs, bench, window)
    at = docs.columns.index("text")

    def cut(batches):
        for b in batches:
            texts = []
            for text, found in zip(utf8(b.column(at)), b.column(b.num_columns - 1).to_pylist()):
                if found["spans"]:
                    edge = [0, *found["spans"], len(text)]
                    text = b"".join(text[i:j] for i, j in zip(edge[::2], edge[1::2]))
                texts.append(text)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    kept = scanned.where(F.col(name)["n_hit"] <= F.lit(most) * F.col(name)["n_words"])
    return kept.mapInArrow(cut, docs.schema) if most else kept.select(*[kept[f"`{c}`"] for c in docs.columns])


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scanned, s = scan_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return scanned.select(
        "doc_id",
        f"{s}.n_words",
        f"{s}.n_hit",
        F.size(f"{s}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{s}.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col(s)["n_hit"] > 0).alias("contaminated"),
    )


OP6_SQL = r"""
with d as (select row_number() over () as row_id, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bs as (select item_id, w, least(10, len(w)) as size from b where len(w) > 0),
items as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as words from (select *, unnest(range(1, len(w) - size + 2)) as i from bs)),
sizes as (select distinct size from items),
win as (select row_id, i, size, array_to_string(w[i:i + size - 1], ' ') as words from (select row_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
hits as (select row_id, i, win.size as size, item_id from win join items on win.size = items.size and win.words = items.words),
hit_words as (select row_id, count(distinct p) as n_hit from (select row_id, unnest(range(i, i + size)) as p from hits) group by row_id),
hit_items as (select row_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct row_id, cast(item_id as varchar) as item from hits) group by row_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (row_id) left join hit_items using (row_id)
"""
