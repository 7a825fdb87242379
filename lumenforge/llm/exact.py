"""Exact dedup by content-defined chunk recipes.

A text without blanks is cut where a rolling hash of its last bytes says so, so equal texts have equal chunks. Chunks are
deduplicated once, by content, which verifies their 64-bit keys; a key that stands for more than one content is told apart
by content. A document then is the ordered list of its chunk identifiers, and only these short lists are grouped and joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import drop_table, materialize, small_bytes_or_shuffled, utf8

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of a chunk: least, on average (a power of two) and most.
LEAST, MEAN, MOST = 512, 2048, 16384
#: One random 32-bit word a byte value, from a fixed seed.
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
_PART = 1 << 22


def _marks(data: np.ndarray) -> np.ndarray:
    """Positions after which a cut may fall: the gear hash of the last 32 bytes has its upper bits at zero."""
    h, step = _GEAR[data], 1
    while step < 32:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    return np.flatnonzero(h < np.uint32((1 << 32) // MEAN)) + 1


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data. The empty text is one empty chunk."""
    raw, marks = np.frombuffer(data, np.uint8), []
    if len(data) > LEAST:
        for i in range(0, len(raw), _PART):
            lead = max(0, i - 31)
            found = _marks(raw[lead : i + _PART]) + lead
            marks.append(found[found > i])
        marks = np.concatenate(marks).tolist()
    ends, at = [], 0
    for m in marks:
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST:
            at = m
            ends.append(at)
    while len(data) - at > MOST:
        at += MOST
        ends.append(at)
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


def chunks(text: bytes | None, key_bits: int = 64):
    """(key, chunk) of the normalised text, in order. Keys of fewer bits are for tests."""
    data, at = (text or b"").translate(None, BLANKS), 0
    mask = (1 << key_bits) - 1
    for end in cuts(data):
        part = data[at:end]
        key = xxhash.xxh3_64_intdigest(part) & mask
        yield (key - (1 << 64) if key >> 63 else key), part
        at = end


def _recipes(key_bits: int):
    def recipes(batches):
        for b in batches:
            keys, sha = [], []
            for text in utf8(b.column(1)):
                keys.append([k for k, _ in chunks(text, key_bits)])
                sha.append(hashlib.sha256((text or b"").translate(None, BLANKS)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.list_(pa.int64())), pa.array(sha)], ["doc_id", "points", "recipe", "text_sha256"])

    return recipes


def _contents(key_bits: int):
    def contents(batches):
        for b in batches:
            seen, size = {}, 0
            for text in utf8(b.column(0)):
                for k, part in chunks(text, key_bits):
                    if (k, part) not in seen:
                        seen[k, part] = None
                        size += len(part)
                if size > 16 << 20:
                    yield _pairs(seen)
                    seen, size = {}, 0
            yield _pairs(seen)

    return contents


def _pairs(seen) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int64()), pa.array([p for _, p in seen], pa.binary())], ["key", "content"])


def _told_apart(docs: DataFrame, clashing: DataFrame, dictionary: DataFrame, recipes: DataFrame, key_bits: int) -> DataFrame:
    """recipes with the place of each chunk's content among those of its key behind each clashing key, found by content.

    Only texts that contain such a key are chunked again; keys of 64 bits almost never clash.
    """
    from pyspark.sql import Window

    places = dictionary.join(clashing, "key", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("content")).cast("long"))

    def occurrences(batches):
        for b in batches:
            for sha, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                found = list(chunks(text, key_bits))
                yield pa.RecordBatch.from_arrays([pa.array([sha] * len(found)), pa.array(range(len(found)), pa.int64()), pa.array([k for k, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], ["text_sha256", "seq", "key", "content"])

    normal = docs.select(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "").cast("binary"), 256).alias("text_sha256"), "text")
    told = (
        normal.mapInArrow(occurrences, "text_sha256 string, seq long, key long, content binary")
        .join(places, ["key", "content"], "left")
        .select("text_sha256", "seq", "key", F.coalesce("place", F.lit(0)).alias("place"))
        .distinct()
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "key", "place"))).alias("told"))
        .select("text_sha256", F.flatten(F.transform("told", lambda x: F.array(x["key"], x["place"]))).alias("recipe"))
    )
    return recipes.drop("recipe").join(told, "text_sha256")


def exact_groups(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Texts are equal if they are after every blank (space, tab to carriage return) is deleted; null counts as empty, and
    empty texts are equal. Of a group the row with most code points in its original text stays, then the least doc_id (null
    last); of repeated rows with that doc_id all are marked kept. An empty table gives no rows.
    """
    own = docs.select("doc_id", "text")
    table = own.withColumn("points", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    recipes = materialize(table.mapInArrow(_recipes(key_bits), "doc_id long, points long, recipe array<long>, text_sha256 string"), "recipes")
    dictionary = own.select("text").mapInArrow(_contents(key_bits), "key long, content binary").distinct()
    clashing = materialize(dictionary.groupBy("key").count().where("count > 1").select("key"), "clashes")
    if not clashing.isEmpty():
        recipes = materialize(_told_apart(own, clashing, dictionary, recipes, key_bits), "recipes")
    drop_table(clashing) if not clashing.isEmpty() else None
    best = F.min_by("doc_id", F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id"))
    groups = recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("keep_id"))
    many = groups.where("group_size > 1")
    return (
        recipes.join(small_bytes_or_shuffled(many, F.size("recipe").cast("long") * 8), "recipe", "left")
        .select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def op7_chunk_recipes(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
with t as (select doc_id, coalesce(length(text), 0) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select *, first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from t)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""
