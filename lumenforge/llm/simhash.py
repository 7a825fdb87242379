"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into two halves of 32 bits. If two fingerprints differ in 3 bits or fewer, one half differs in 1 or
none. The anchors of a half are the words of the perfect Hamming code of length 31 (the half's top bit is left out): every
31-bit word is within covering radius 1 of exactly one anchor, its home. A fingerprint goes to its home and to every anchor
within radius + 1 = 2 bits (15 or 16 in all), so that it meets each fingerprint one bit away at that one's home. Anchors are
2**31-spaced keys of 26 free bits for each half. Homes are compared with all fingerprints of their anchor, and only the
edges of a spanning forest leave the task, never all pairs.

An anchor is in reach of 497 halves at most, so it is crowded only if a half near it has many fingerprints. Fingerprints of
crowded anchors are dealt anew by each quarter of their other bits, one of which is equal where three differ; what is
crowded even then is compared block by block. So no task holds more than a bounded group, whatever the fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_table, materialize, small_or_shuffled, utf8
from .components import connected_components

SHINGLE, BITS_APART, SEED = 3, 3, 42
#: Fingerprints of one half from which the anchors in its reach count as crowded; fingerprints of a block beyond that.
CROWD, BLOCK = 64, 8192
#: Fingerprints that are expanded at once, some 31 rows each.
ABREAST = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of UTF-8 text; A-Z count as a-z; 0 if there is no word."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    ends = np.fromiter(map(len, words), np.int64, n)
    ends += 1
    np.cumsum(ends, out=ends)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    ones, total = np.zeros(64, np.int64), len(starts)
    for i in range(0, total, 65536):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i : i + 65536], stops[i : i + 65536])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        fp = np.array([fingerprint(t) for t in utf8(b.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])


#: 1 to 31: the syndrome of each single bit of the Hamming code.
_AT = np.arange(1, 32, dtype=np.uint32)
#: For each syndrome, the flips that lead to the anchors within two bits: the home first, then pairs i ^ j = syndrome.
_FLIPS = [[1 << (s - 1) if s else 0] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if s and i < i ^ s] for s in range(32)]


def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.uint32)
    for bit in range(5):
        mask = np.uint32(sum(1 << (int(p) - 1) for p in _AT if p >> bit & 1))
        out |= (np.bitwise_count(half & mask).astype(np.uint32) & np.uint32(1)) << np.uint32(bit)
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, fingerprint, whether it is the fingerprint's home) for each fingerprint and anchor in reach."""
    keys, whose, home = [], [], []
    bits = fp.view(np.uint64)
    for side in (0, 1):
        half = ((bits >> np.uint64(32 * side)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        syndrome = _syndrome(half)
        for s in range(32):
            at = np.flatnonzero(syndrome == s)
            for k, flip in enumerate(_FLIPS[s]):
                keys.append((half[at] ^ np.uint32(flip)).astype(np.int64) | (side << 32))
                whose.append(fp[at])
                home.append(np.full(len(at), k == 0))
    return np.concatenate(keys), np.concatenate(whose), np.concatenate(home)


def _expand(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), ABREAST):
            a, f, h = anchors(fp[i : i + ABREAST])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(f), pa.array(h)], ["anchor", "fp", "home"])


def _forest(fp: np.ndarray, home: np.ndarray, apart: int):
    """Edges of a spanning forest over one anchor's links between homes and all; each search step is one vector operation."""
    bits, left, out = fp.view(np.uint64), np.ones(len(fp), bool), []
    for first in np.flatnonzero(home):
        if not left[first]:
            continue
        left[first], todo = False, [first]
        while todo:
            x = todo.pop()
            rest = np.flatnonzero(left if home[x] else left & home)
            near = rest[np.bitwise_count(bits[rest] ^ bits[x]) <= apart]
            left[near] = False
            out += [(fp[x], fp[y]) for y in near]
            todo += near.tolist()
    return out


def _compare(batches, apart: int = BITS_APART):
    """Input sorted by anchor. Groups that reach over batches are joined first."""

    def links(anchor, fp, home):
        cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size, homes = np.diff(np.r_[cut, len(anchor)]), np.add.reduceat(home.astype(np.int64), cut)
        edges = []
        for at in np.flatnonzero((size > 1) & (homes > 0)):
            span = slice(cut[at], cut[at] + size[at])
            edges += _forest(fp[span], home[span], apart)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    kept = [np.array([], np.int64), np.array([], np.int64), np.array([], bool)]
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        a, f, h = (np.concatenate(x) for x in zip(kept, new))
        cut = int(np.searchsorted(a, a[-1]))
        if cut:
            yield links(a[:cut], f[:cut], h[:cut])
        kept = [a[cut:], f[cut:], h[cut:]]
    if len(kept[0]):
        yield links(*kept)


def _crowded(fps: DataFrame) -> DataFrame:
    """The anchors in reach of halves that CROWD fingerprints or more have."""
    halves = F.array(*[F.shiftrightunsigned("fp", 32 * side).bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(side << 32)) for side in (0, 1)])
    full = fps.select(F.explode(halves).alias("half")).groupBy("half").count().where(F.col("count") >= CROWD)

    def reach(batches):
        for b in batches:
            half = b.column(0).to_numpy(zero_copy_only=False)
            for side in (0, 1):
                mine = (half[half >> 32 == side] & 0x7FFFFFFF) << (32 * side)
                for i in range(0, len(mine), ABREAST):
                    a, _, _ = anchors(mine[i : i + ABREAST])
                    yield pa.RecordBatch.from_arrays([pa.array(a[a >> 32 == side])], ["anchor"])

    return full.select("half").mapInArrow(reach, "anchor long").distinct()


def _quarters(fp: str = "fp") -> Column:
    """For each anchor row the keys of the four quarters of the 33 bits that its half leaves."""
    other = F.when(F.col("anchor") >= F.lit(1 << 32), F.shiftrightunsigned(fp, 63).bitwiseOR(F.shiftleft(F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)), 1))).otherwise(F.shiftrightunsigned(fp, 31))
    return F.array(*[F.xxhash64("anchor", F.lit(q), F.shiftright(other, at).bitwiseAND(F.lit((1 << n) - 1))) for q, (at, n) in enumerate(((0, 9), (9, 8), (17, 8), (25, 8)))])


def _blocks(rows: DataFrame) -> DataFrame:
    """key, fp, home with keys of large groups replaced by those of every two blocks of the group."""
    large = rows.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    large = materialize(large, "simhash-large")
    if large.isEmpty():
        drop_table(large)
        return rows
    dealt = rows.join(small_or_shuffled(large), "key", "left")
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    return dealt.select(F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "fp", "home")


def near_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints of column fp at most three bits apart, enough to connect all that link."""
    spread = fps.repartition(max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), F.xxhash64("fp"))  # not by fp itself, by which it is dealt to fewer tasks already
    placed = spread.mapInArrow(_expand, "anchor long, fp long, home boolean")
    compare = lambda rows: rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "a long, b long")
    crowded = materialize(_crowded(fps), "simhash-crowded")
    if crowded.isEmpty():
        drop_table(crowded)
        return compare(placed.withColumnRenamed("anchor", "key"))
    known = small_or_shuffled(crowded)
    calm = compare(placed.join(known, "anchor", "left_anti").withColumnRenamed("anchor", "key"))
    full = placed.join(known, "anchor", "left_semi")
    return calm.unionByName(compare(_blocks(full.select(F.explode(_quarters()).alias("key"), "fp", "home"))))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64 bits), component_id (least doc_id that links reach) for each row of docs.

    Null or empty text and text without words: fingerprint 0, linked like any other. Repeated rows stay, each with its
    component. A null doc_id is kept but is no component's name unless all of it are null. An empty table gives no rows.
    """
    fps = materialize(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    edges = materialize(near_links(first.select("fp")), "simhash-links")
    roots = connected_components(edges)
    named = first.join(small_or_shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left")
    # A fingerprint that only one row has, and that links to none, needs no label: its row names itself.
    least = named.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id"))
    label = named.where("n > 1 or root is not null").select("fp", "root", "first_id")
    label = label.join(small_or_shuffled(least), "root", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), F.lit(True).alias("labelled"))
    label = materialize(label, "simhash-labels")
    drop_table(edges)
    found = fps.join(small_or_shuffled(label), "fp", "left")
    return found.select("doc_id", "fp", F.when(F.col("labelled"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_simhash_anchors(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their component, all columns; of repeated rows with one doc_id, one stays.

    Rows without a doc_id can't be named and stay. Only ids move, unless more rows go than may be broadcast.
    """
    found = materialize(simhash_components(docs), "simhash-kept")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(small_or_shuffled(gone), "doc_id", "left_anti")
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.isEmpty():
        many = small_or_shuffled(twice)
        once = left.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        left = left.join(many, "doc_id", "left_anti").unionByName(once)
    return left.select(docs.columns)
