"""A dataset is a folder of Parquet tables with a small metadata file of title and feature flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .schema import LAYOUT, TABLES


@dataclass
class Dataset:
    tables: dict[str, DataFrame]
    title: str = ""
    features: list[str] = field(default_factory=list)

    def has(self, flag: str) -> bool:
        return flag in self.features

    def required(self) -> list[str]:
        return [f for f in self.features if not f.startswith("opt_")]

    def runs_for_sample(self, uri: str) -> DataFrame:
        """Runs of which a provenance record names the sample among its inputs."""
        return runs_with_input(self.tables["runs"], self.tables["provenance"], uri)

    def runs_of_modality(self, modality: str) -> DataFrame:
        return self.tables["runs"].where(F.col("modality") == modality)


def runs_with_input(runs: DataFrame, provenance: DataFrame, uri: str) -> DataFrame:
    return runs.join(provenance.where(F.array_contains("input_refs", uri)), "run_name", "left_semi")


def all_runs(*precedence: DataFrame) -> DataFrame:
    """Union of run tables in which a name belongs to the first table that has it."""
    out = precedence[0]
    for later in precedence[1:]:
        out = out.unionByName(later.join(out.select("run_name"), "run_name", "left_anti"))
    return out


def split_runs(*tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spectral and genomic runs of several run tables; a name that occurs twice is an error."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    twice = out.groupBy("run_name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"run {twice[0][0]!r} is there twice")
    genomic = F.coalesce(F.col("modality") == "genomic", F.lit(False))
    return out.where(~genomic), out.where(genomic)


def with_chromosome_names(reads: DataFrame, names: DataFrame, column: str = "chromosome_id", to: str = "chromosome") -> DataFrame:
    """reads with the name of a chromosome's number in place of it; names (id, name) has a row for each, 65,535 at most; a number
    without a name is *."""
    table = names.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    return reads.join(F.broadcast(table), F.col(column) == F.col("_id"), "left").withColumn(to, F.coalesce("_name", F.lit("*"))).drop("_id", "_name", column)


def resolve_references(reads: DataFrame, runs: DataFrame, references: DataFrame) -> DataFrame:
    """reads with reference_seq: their chromosome's sequence of the reference that their run names. Chromosomes are few and long:
    they are joined by (uri, chromosome), once a chromosome and run, and a missing one leaves null."""
    uri = runs.select("run_name", "reference_uri")
    named = reads.join(F.broadcast(uri), "run_name", "left")
    r = references.select(F.col("uri").alias("_u"), F.col("chromosome").alias("_c"), F.col("seq").alias("reference_seq"))
    return named.join(r, (F.col("reference_uri") == F.col("_u")) & (F.col("chromosome") == F.col("_c")), "left").drop("_u", "_c")


def resolve_reference(embedded: DataFrame | None, uri: str, md5: str, chromosome: str, external: DataFrame | None = None) -> bytes:
    """One chromosome's sequence: the embedded one if its MD5 fits, else that of an external FASTA table (name, seq), whose MD5
    is of the chromosome in upper case. None of them, or another MD5, is an error."""
    import hashlib

    if embedded is not None:
        row = embedded.where((F.col("uri") == uri) & (F.col("chromosome") == chromosome)).select("seq", F.col("md5") if "md5" in embedded.columns else F.md5(F.col("seq").cast("binary")).alias("md5")).first()
        if row is not None:
            if row["md5"] != md5:
                raise ValueError(f"the embedded {uri} has another MD5")
            return bytes(row["seq"]) if not isinstance(row["seq"], str) else row["seq"].encode()
    row = external.where(F.col("name") == chromosome).select("seq").first() if external is not None else None
    if row is None:
        raise LookupError(f"no reference {uri!r} with {chromosome!r}")
    seq = row[0].encode()
    if hashlib.md5(seq.upper()).hexdigest() != md5:
        raise ValueError(f"{chromosome} of the external reference has another MD5")
    return seq


class Cursor:
    """Rows of one run in order of an index, one at a time. Partitions stream to the driver as they are needed."""

    def __init__(self, rows: DataFrame, index: str = "spectrum_index"):
        self._rows, self._index, self.size = rows, index, rows.count()
        self.reset()

    def reset(self) -> None:
        self.seek(0)

    def seek(self, position: int) -> bool:
        """False, and no move, for a place outside 0 to size."""
        if not 0 <= position <= self.size:
            return False
        self.position = position
        self._left = self._rows.orderBy(self._index).offset(position).toLocalIterator(prefetchPartitions=True)
        return True

    def has_more(self) -> bool:
        return self.position < self.size

    def __iter__(self):
        return self

    def __next__(self):
        if not self.has_more():
            raise StopIteration
        self.position += 1
        return next(self._left)


class RunWriter:
    """Spectra that are appended and written with each flush, as files beside those written before; what isn't flushed is lost
    on close. For a stream of spectra use append_stream."""

    def __init__(self, spark: SparkSession, path: str, run_name: str, table: str = "spectra"):
        self._spark, self._path, self._run, self._schema = spark, f"{path}/{table}", run_name, TABLES[table]
        self._held, self._n = [], 0

    def append(self, **spectrum) -> None:
        self._held.append({"run_name": self._run, "spectrum_index": self._n + len(self._held)} | spectrum)

    def flush(self) -> None:
        if self._held:
            names = [f.name for f in self._spark.createDataFrame([], self._schema).schema]
            rows = [tuple(r.get(c) for c in names) for r in self._held]
            self._spark.createDataFrame(rows, self._schema).write.mode("append").partitionBy("run_name").parquet(self._path)
            self._n, self._held = self._n + len(self._held), []

    def close(self) -> None:
        self._held = []


def append_stream(spectra: DataFrame, path: str, checkpoint: str, table: str = "spectra"):
    """Writes a stream of spectra to a dataset's table as it comes; each row once, also over restarts."""
    return spectra.writeStream.format("parquet").partitionBy(*LAYOUT[table]).option("checkpointLocation", checkpoint).outputMode("append").start(f"{path}/{table}")


#: How a run's tables may be packed, as Parquet knows it.
COMPRESSION = {"none": "uncompressed", "gzip": "gzip", "zlib": "gzip", "lz4": "lz4", "zstd": "zstd", "snappy": "snappy"}
DETAIL = ("activation_method", "isolation_target_mz", "isolation_lower_offset", "isolation_upper_offset")


def check_detail(spectra: DataFrame) -> bool:
    """Whether spectra have the details of fragmentation; some of their columns without the others are an error."""
    there = [c for c in DETAIL if c in spectra.columns]
    if there and len(there) < len(DETAIL):
        raise ValueError(f"columns of fragmentation come all or not at all, here {there}")
    return bool(there)


def write_dataset(data: Dataset, path: str, compression: str = "zstd", fixed_point: tuple[str, ...] = ()) -> None:
    """Writes every table; a run name that two tables of runs share is an error, as is a table of unknown name. Channels named
    in fixed_point are kept as differences of 62-bit fixed-point numbers (deltas and scale), which open_dataset undoes.
    opt_genomic and opt_ms2_activation_detail are added to the features where the tables need them."""
    from .functions.codecs import numpress_columns

    if compression not in COMPRESSION:
        raise ValueError(f"no compression {compression!r}")
    spark = next(iter(data.tables.values())).sparkSession
    if unknown := set(data.tables) - set(TABLES):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    if "runs" in data.tables:
        twice = data.tables["runs"].groupBy("run_name").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"run {twice[0][0]!r} is there twice")
    flags = list(data.features)
    if "reads" in data.tables and "opt_genomic" not in flags:
        flags.append("opt_genomic")
    if "spectra" in data.tables and check_detail(data.tables["spectra"]) and "opt_ms2_activation_detail" not in flags:
        some = F.coalesce(F.col("activation_method"), F.lit(0)) != 0
        for c in DETAIL[1:]:
            some = some | (F.coalesce(F.col(c), F.lit(0.0)) != 0)
        if not data.tables["spectra"].where(some).isEmpty():
            flags.append("opt_ms2_activation_detail")
    for name, df in data.tables.items():
        if name == "spectra" and fixed_point:
            df = numpress_columns(df, fixed_point)
        writer = df.write.mode("overwrite").option("compression", COMPRESSION[compression])
        (writer.partitionBy(*LAYOUT[name]) if name in LAYOUT else writer).parquet(f"{path}/{name}")
    spark.createDataFrame([(data.title, flags)], "title string, features array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/_meta_")


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    """Lazy tables of the dataset at path, any file system that Spark reads; absent tables are left out."""
    from pyspark.errors import AnalysisException

    tables = {}
    for name, schema in TABLES.items():
        try:
            found = spark.read.parquet(f"{path}/{name}")
            fixed = [c[:-7] for c in found.columns if c.endswith("_deltas")]
            if not fixed:
                found = spark.read.schema(schema).parquet(f"{path}/{name}")
            else:
                from .functions.codecs import numpress_restored

                found = numpress_restored(found, fixed)
            tables[name] = found
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    meta = spark.read.schema("title string, features array<string>").json(f"{path}/_meta_").first()
    return Dataset(tables, meta[0] or "", list(meta[1] or []))
