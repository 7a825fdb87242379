"""Protection: row by row AES-GCM with Spark's own functions, keyed digests of ordered columns, wrapped keys, cipher catalogue."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Unsupported(NotImplementedError):
    """An algorithm that this installation has no library for."""


# -- catalogue ------------------------------------------------------------------------------------------------------------

# Category, key bytes (public key of asymmetric ones; None: any), private key bytes, nonce, tag or signature, status.
CIPHERS = {
    "aes-256-gcm": ("AEAD", 32, None, 12, 16, "active"),
    "ml-kem-1024": ("KEM", 1568, 3168, 0, 0, "active"),
    "hmac-sha256": ("MAC", None, None, 0, 32, "active"),
    "ml-dsa-87": ("Signature", 2592, 4896, 0, 4627, "active"),
    "sha-256": ("Hash", 0, None, 0, 32, "active"),
    "shake256": ("XOF", 0, None, 0, 0, "reserved"),
}
_CIPHER_FIELDS = ("category", "key_size", "private_key_size", "nonce_size", "tag_size", "status")


def cipher(algorithm: str) -> dict:
    if algorithm not in CIPHERS:
        raise Unsupported(f"unknown algorithm {algorithm!r}")
    return dict(zip(_CIPHER_FIELDS, CIPHERS[algorithm]))


def algorithms(status: str | None = None) -> list[str]:
    return [a for a in CIPHERS if status is None or cipher(a)["status"] == status]


def is_supported(algorithm: str) -> bool:
    return algorithm in algorithms("active")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, *v) for a, v in CIPHERS.items()], "algorithm string, category string, key_size int, private_key_size int, nonce_size int, tag_size int, status string")


def validate_key(algorithm: str, key: bytes, role: str = "symmetric") -> None:
    """Raises ValueError for a key of the wrong length or role (symmetric, public or private)."""
    entry = cipher(algorithm)
    if entry["status"] != "active":
        raise Unsupported(f"{algorithm} is reserved")
    asymmetric = entry["category"] in ("KEM", "Signature")
    if asymmetric != (role != "symmetric"):
        raise ValueError(f"{algorithm} is {'a' if asymmetric else ''}symmetric, the key is {role}")
    size = entry["private_key_size" if role == "private" else "key_size"]
    if size is None and not key or size is not None and len(key) != size:
        raise ValueError(f"{algorithm} takes a {role} key of {size or 'some'} bytes, not {len(key)}")


def post_quantum(*_, **__):
    """Key encapsulation and signatures that withstand quantum computers need a library that isn't here."""
    raise Unsupported("ML-KEM-1024 and ML-DSA-87 need liboqs")


# -- rows -----------------------------------------------------------------------------------------------------------------


def _little(c: Column, n: int) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)]))


def aad(dataset_id: Column, sequence: Column, channel: Column) -> Column:
    """Dataset (u16 LE), sequence (u32 LE; of wider ones the low 32 bits) and channel name, as additional authenticated data."""
    return F.concat(_little(dataset_id.cast("long"), 2), _little(F.pmod(sequence, F.lit(1 << 32)).cast("long"), 4), channel.cast("binary"))


def seal(value: Column, key: Column, data: Column) -> Column:
    """A fresh 12-byte nonce, the ciphertext and the 16-byte tag."""
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), data)


def unseal(sealed: Column, key: Column, data: Column) -> Column:
    return F.aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), data)


def segment(sealed: Column, length: Column) -> Column:
    """iv, tag and ciphertext of sealed bytes, and the plain length; a clear value has neither iv nor tag."""
    parts = lambda s: F.struct(F.substring(s, 1, 12).alias("iv"), F.substring(s, F.octet_length(s) - 15, F.lit(16)).alias("tag"), F.substring(s, F.lit(13), F.octet_length(s) - 28).alias("ciphertext"), length.alias("length"))
    # Bound by a lambda: each evaluation of the sealed value would draw a nonce of its own.
    return F.transform(F.array(sealed), parts)[0]


def clear_segment(value: Column) -> Column:
    none = F.lit(b"").cast("binary")
    return F.struct(none.alias("iv"), none.alias("tag"), value.alias("ciphertext"), F.octet_length(value).alias("length"))


def open_segment(s: Column, key: Column, data: Column) -> Column:
    """The plain bytes of a segment. A length that doesn't fit is an error, as is an encrypted segment without a key."""
    plain = F.when(F.octet_length(s["iv"]) == 0, s["ciphertext"]).when(key.isNull(), F.raise_error(F.lit("no key for an encrypted segment")).cast("binary")).otherwise(unseal(F.concat(s["iv"], s["ciphertext"], s["tag"]), key, data))
    return F.when(F.octet_length(plain) == s["length"], plain).otherwise(F.raise_error(F.lit("a segment of another length")).cast("binary"))


def packed_doubles(df: DataFrame, column: str, to: str) -> DataFrame:
    """df with the little-endian bytes of a column of doubles' arrays; null stays null."""
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            made = [None if x is None else np.asarray(x, "<f8").tobytes() for x in b.column(b.schema.names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.BinaryType())]))


def unpacked_doubles(df: DataFrame, column: str, to: str) -> DataFrame:
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            made = [None if x is None else np.frombuffer(x, "<f8") for x in b.column(b.schema.names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float64()))], names=[*b.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.DoubleType()))]))


def seal_channels(units: DataFrame, key: bytes, channels: tuple[str, ...], dataset_id: str = "dataset_id", sequence: str = "au_sequence") -> DataFrame:
    """units with each channel (an array of doubles or bytes) replaced by its segment, one operation a row and channel."""
    validate_key("aes-256-gcm", key)
    kinds, out = dict(units.dtypes), units
    for c in channels:
        if kinds[c].startswith("array"):
            out = packed_doubles(out, c, "_raw").drop(c).withColumnRenamed("_raw", c)
        out = out.withColumn(c, segment(seal(F.col(c).cast("binary"), F.lit(key), aad(F.col(dataset_id), F.col(sequence), F.lit(c))), F.octet_length(c)))
    return out


def open_channels(units: DataFrame, key: bytes, channels: tuple[str, ...], doubles: bool = True, dataset_id: str = "dataset_id", sequence: str = "au_sequence") -> DataFrame:
    validate_key("aes-256-gcm", key)
    out = units
    for c in channels:
        out = out.withColumn(c, open_segment(F.col(c), F.lit(key), aad(F.col(dataset_id), F.col(sequence), F.lit(c))))
        if doubles:
            out = unpacked_doubles(out, c, "_values").drop(c).withColumnRenamed("_values", c)
    return out


#: The 36 bytes of a unit's header as they are encrypted.
UNIT_HEADER = np.dtype([("acquisition_mode", "u1"), ("ms_level", "u1"), ("polarity", "u1"), ("retention_time", "<f8"), ("precursor_mz", "<f8"), ("precursor_charge", "u1"), ("ion_mobility", "<f8"), ("base_peak_intensity", "<f8")])
_WHOLE = {"acquisition_mode", "ms_level", "polarity", "precursor_charge"}


def packed_headers(units: DataFrame, to: str = "header") -> DataFrame:
    """units with the packed header; columns that are absent or null count as 0; a negative polarity wraps to a byte."""
    from pyspark.sql import types as T

    names = UNIT_HEADER.names
    ready = units.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in units.columns else F.lit(0.0) for c in names})

    def run(batches):
        for b in batches:
            head = np.zeros(b.num_rows, UNIT_HEADER)
            for c in names:
                v = b.column(b.schema.names.index(f"_{c}")).to_numpy(zero_copy_only=False)
                head[c] = v.astype(np.int64) & 0xFF if c in _WHOLE else v
            raw, n = head.tobytes(), UNIT_HEADER.itemsize
            made = pa.array([raw[i * n : (i + 1) * n] for i in range(b.num_rows)], pa.binary())
            kept = [i for i, c in enumerate(b.schema.names) if not (c.startswith("_") and c[1:] in names)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), made], names=[*(b.schema.names[i] for i in kept), to])

    return ready.mapInArrow(run, T.StructType([*units.schema.fields, T.StructField(to, T.BinaryType())]))


def unpacked_headers(units: DataFrame, column: str = "header") -> DataFrame:
    """units with the fields of a packed header in place of it; bytes of another number are an error."""
    from pyspark.sql import types as T

    names = [f for f in UNIT_HEADER.names if f not in units.columns]
    rest = [f for f in units.schema.fields if f.name != column]

    def run(batches):
        for b in batches:
            raw = b.column(b.schema.names.index(column)).to_pylist()
            if any(len(x) != UNIT_HEADER.itemsize for x in raw):
                raise ValueError("a header of other than 36 bytes")
            head = np.frombuffer(b"".join(raw), UNIT_HEADER)
            cols = [pa.array(head[c].astype(np.int32 if c in _WHOLE else np.float64)) for c in names]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(f.name)) for f in rest), *cols], names=[*(f.name for f in rest), *names])

    return units.mapInArrow(run, T.StructType([*rest, *(T.StructField(c, T.IntegerType() if c in _WHOLE else T.DoubleType()) for c in names)]))


def seal_headers(units: DataFrame, key: bytes, dataset_id: str = "dataset_id", sequence: str = "au_sequence") -> DataFrame:
    """units with their filter keys taken away and header, the segment of them; offsets and lengths stay in the clear."""
    validate_key("aes-256-gcm", key)
    packed = packed_headers(units).drop(*UNIT_HEADER.names)
    return packed.withColumn("header", segment(seal(F.col("header"), F.lit(key), aad(F.col(dataset_id), F.col(sequence), F.lit("header"))), F.octet_length("header")))


def open_headers(units: DataFrame, key: bytes, dataset_id: str = "dataset_id", sequence: str = "au_sequence") -> DataFrame:
    plain = open_segment(F.col("header"), F.lit(key), aad(F.col(dataset_id), F.col(sequence), F.lit("header")))
    return unpacked_headers(units.withColumn("header", plain))


#: The name in a region's key map under which the index columns themselves are encrypted.
HEADERS_KEY = "_headers"


def _with_keys(reads: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    for k in keys.values():
        validate_key("aes-256-gcm", k)
    known = reads.sparkSession.createDataFrame([(c, bytearray(k)) for c, k in keys.items() if c != HEADERS_KEY] or [("\0", bytearray(32))], "_c string, _key binary")
    return reads.join(F.broadcast(known), reads["chromosome"].eqNullSafe(known["_c"]), "left").drop("_c")


def seal_regions(reads: DataFrame, keys: dict[str, bytes], channels: tuple[str, ...] = ("seq", "qual"), dataset_id: str = "dataset_id", sequence: str = "read_index") -> DataFrame:
    """reads with each channel as a segment, sealed under its chromosome's key; reads of others stay clear segments. A key
    named _headers seals the index columns into index_header; if it is the only one, the channels are left alone."""
    out = reads
    if set(keys) != {HEADERS_KEY}:
        out = _with_keys(out, keys)
        for c in channels:
            raw = F.col(c).cast("binary")
            shut = segment(seal(raw, F.col("_key"), aad(F.col(dataset_id), F.col(sequence), F.lit(c))), F.octet_length(raw))
            out = out.withColumn(c, F.when(F.col("_key").isNull(), clear_segment(raw)).otherwise(shut))
        out = out.drop("_key")
    if HEADERS_KEY in keys:
        validate_key("aes-256-gcm", keys[HEADERS_KEY])
        index = F.to_json(F.struct("chromosome", "position", "mapq", "flags")).cast("binary")
        out = out.withColumn("index_header", segment(seal(index, F.lit(keys[HEADERS_KEY]), aad(F.col(dataset_id), F.col(sequence), F.lit("header"))), F.octet_length(index))).drop("chromosome", "position", "mapq", "flags")
    return out


def open_regions(reads: DataFrame, keys: dict[str, bytes], channels: tuple[str, ...] = ("seq", "qual"), dataset_id: str = "dataset_id", sequence: str = "read_index") -> DataFrame:
    """The reads again. A segment that is sealed under a key that isn't given is an error."""
    out = reads
    if "index_header" in reads.columns:
        if HEADERS_KEY not in keys:
            raise ValueError("the index columns are sealed, and the key _headers isn't given")
        plain = open_segment(F.col("index_header"), F.lit(keys[HEADERS_KEY]), aad(F.col(dataset_id), F.col(sequence), F.lit("header")))
        out = out.withColumn("_index", F.from_json(plain.cast("string"), "chromosome string, position long, mapq int, flags long")).select("*", "_index.*").drop("_index", "index_header")
    kinds = dict(reads.dtypes)
    if not all(kinds[c].startswith("struct") for c in channels):
        return out
    out = _with_keys(out, keys)
    for c in channels:
        out = out.withColumn(c, open_segment(F.col(c), F.col("_key"), aad(F.col(dataset_id), F.col(sequence), F.lit(c))))
    return out.drop("_key")


# -- canonical bytes and signatures -----------------------------------------------------------------------------------------

# Little-endian types of numbers by Spark's names.
_LITTLE = {"float": "<f4", "double": "<f8", "tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8"}


def canonical_rows(df: DataFrame, columns: list[str], order: list[str], kinds: dict[str, str] | None = None):
    """Chunks of the canonical bytes of columns over rows in order: numbers little-endian (kinds overrides a column's type,
    such as u4), texts and bytes with their length (u32 LE), arrays element by element; row after row. Rows are sorted by
    all tasks and stream through the driver a few at a time, since the digests made of them have no parts."""
    types = {c: (kinds or {}).get(c) or _LITTLE.get(t) for c, t in df.select(*columns).dtypes}

    def one(value, kind):
        if kind:
            return np.asarray(value).astype(kind if kind[0] == "<" else "<" + kind).tobytes()
        if isinstance(value, (list, tuple)):
            return b"".join(np.asarray(v, "<f8").tobytes() if isinstance(v, float) else one(v, None) for v in value)
        raw = b"" if value is None else bytes(value) if isinstance(value, (bytes, bytearray)) else str(value).encode()
        return len(raw).to_bytes(4, "little") + raw

    for row in df.orderBy(*order).select(*columns).toLocalIterator(prefetchPartitions=True):
        yield b"".join(one(row[c], types[c]) for c in columns)


def signature(payload, key: bytes, algorithm: str = "hmac-sha256") -> str:
    """v2: and the base64 HMAC of bytes, or of chunks of bytes."""
    if algorithm != "hmac-sha256":
        post_quantum()
    validate_key(algorithm, key)
    digest = hmac.new(key, digestmod=hashlib.sha256)
    for chunk in [payload] if isinstance(payload, (bytes, bytearray)) else payload:
        digest.update(chunk)
    return "v2:" + base64.b64encode(digest.digest()).decode()


def verify(payload, key: bytes, signed: str | None, algorithm: str = "hmac-sha256") -> bool:
    """False for no signature or one that doesn't fit; the prefix of another algorithm is an error; none is an old v2."""
    if not signed:
        return False
    if signed.startswith("v3:") != (algorithm == "ml-dsa-87"):
        raise ValueError("signed with another algorithm")
    return hmac.compare_digest(signature(payload, key, algorithm), signed if signed.startswith("v2:") else "v2:" + signed)


#: Columns of reads that a run's signatures cover, with the type they are signed as where it isn't the table's.
SIGNED = {"seq": None, "qual": None, "length": "u4", "position": "<i8", "mapq": "u1", "flags": "u4", "chromosome": None}


def sign_run(reads: DataFrame, key: bytes, index: str = "read_index") -> dict[str, str]:
    """Signatures of each present column of a run of reads, over its rows in order of the index."""
    return {c: signature(canonical_rows(reads, [c], [index], {c: k} if k else None), key) for c, k in SIGNED.items() if c in reads.columns}


def verify_run(reads: DataFrame, key: bytes, signed: dict[str, str], index: str = "read_index") -> bool:
    """Whether every present column is signed and fits; a column without a signature fails."""
    return all(verify(canonical_rows(reads, [c], [index], {c: k} if k else None), key, signed.get(c)) for c, k in SIGNED.items() if c in reads.columns)


def row_signatures(df: DataFrame, columns: list[str], key: bytes, name: str = "signature") -> DataFrame:
    """A signature for each row, of its columns' texts and bytes with their lengths, made where the row is; for tables that
    are too long to be signed in one go."""
    from pyspark.sql import types as T

    ready = df.withColumn("_body", F.concat(*[F.concat(_little(F.coalesce(F.octet_length(F.col(c).cast("binary")), F.lit(0)).cast("long"), 4), F.coalesce(F.col(c).cast("binary"), F.lit(b"").cast("binary"))) for c in columns]))

    def run(batches):
        for b in batches:
            made = [signature(x, key) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.string())], names=[*b.schema.names[:-1], name])

    return ready.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


# -- wrapped keys ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class KeyInfo:
    """A data key wrapped under another, and the keys it was wrapped under before."""

    wrapped: bytes
    kek_id: str
    algorithm: str
    wrapped_at: str
    history: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"dek_wrapped": base64.b64encode(self.wrapped).decode(), "kek_id": self.kek_id, "kek_algorithm": self.algorithm, "wrapped_at": self.wrapped_at, "key_history": self.history}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> KeyInfo:
        d = json.loads(text)
        history = d.get("key_history")
        return cls(base64.b64decode(d["dek_wrapped"]), d["kek_id"], d["kek_algorithm"], d["wrapped_at"], history if isinstance(history, list) else [])


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _aes(spark: SparkSession, f, value: bytes, key: bytes) -> bytes:
    row = spark.createDataFrame([(bytearray(value), bytearray(key))], "v binary, k binary")
    return bytes(row.select(f("v", "k", F.lit("GCM"))).first()[0])


def _wrap(spark: SparkSession, dek: bytes, kek: bytes, algorithm: str) -> bytes:
    if algorithm == "ml-kem-1024":
        post_quantum()
    validate_key(algorithm, kek)
    return _aes(spark, F.aes_encrypt, dek, kek)


def wrap_new_key(spark: SparkSession, kek: bytes, kek_id: str, algorithm: str = "aes-256-gcm") -> tuple[bytes, KeyInfo]:
    """A fresh data key of 32 bytes, and what is to be stored of it."""
    dek = os.urandom(32)
    return dek, KeyInfo(_wrap(spark, dek, kek, algorithm), kek_id, algorithm, _now())


def unwrap_key(spark: SparkSession, info: KeyInfo, kek: bytes) -> bytes:
    """The data key; a key that doesn't fit is an error."""
    if info.algorithm == "ml-kem-1024":
        post_quantum()
    validate_key(info.algorithm, kek)
    return _aes(spark, F.aes_decrypt, info.wrapped, kek)


def rotate_key(spark: SparkSession, info: KeyInfo, old: bytes, new: bytes, new_id: str, new_algorithm: str | None = None) -> KeyInfo:
    """The same data key under another key. No data are touched; the old key's name goes to the history."""
    dek, algorithm = unwrap_key(spark, info, old), new_algorithm or info.algorithm
    past = {"timestamp": info.wrapped_at, "kek_id": info.kek_id, "kek_algorithm": info.algorithm}
    return replace(info, wrapped=_wrap(spark, dek, new, algorithm), kek_id=new_id, algorithm=algorithm, wrapped_at=_now(), history=[*info.history, past])
