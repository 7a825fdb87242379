"""Row-preserving and row-dropping transforms of the anonymiser."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..dataset import Dataset
from .index import reindexed

#: Bins of reads and regions in the overlap join.
BIN = 1 << 14


def is_variant(entity: str = "chemical_entity") -> Column:
    return F.upper(entity).contains("SAAV") | F.upper(entity).contains("VARIANT")


def redact_variants(spectra: DataFrame, ids: DataFrame) -> DataFrame:
    """Spectra with no identification of a sequence variant, numbered anew in each run."""
    keys = ids.where(is_variant()).select("run_name", "spectrum_index").distinct()
    return reindexed(spectra.join(keys, ["run_name", "spectrum_index"], "left_anti"), "run_name", "spectrum_index")


def kept_identifications(ids: DataFrame, kept: DataFrame) -> DataFrame:
    """Identifications whose index is below the number of spectra their run has left; indices aren't mapped to new ones."""
    counts = kept.groupBy("run_name").agg(F.count("*").alias("n_kept"))
    return ids.join(counts, "run_name").where("spectrum_index < n_kept").drop("n_kept")


def coarsen(values: Column, decimals: int) -> Column:
    """Rounds every value to so many decimals, halves to even."""
    scale = float(10**decimals)
    return F.transform(values, lambda x: F.rint(x * scale) / scale)


def quantile(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array; null if empty."""
    s = F.sort_array(values)
    at = (F.size(s) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return F.when(F.size(s) > 0, a + (b - a) * (at - low))


def mask_below_quantile(values: Column, q: float) -> Column:
    """Zeroes what is strictly below the array's own quantile, which is worked out once an array: it is bound by a lambda over
    an array of one."""
    bound = F.array(F.struct(values.alias("v"), quantile(values, q).alias("t")))
    return F.transform(bound, lambda s: F.transform(s["v"], lambda x: F.when(x < s["t"], 0.0).otherwise(x)))[0]


def rare_spectra(ids: DataFrame, prevalence: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Keys of spectra with an identification of an entity whose prevalence is below threshold; unlisted entities aren't rare."""
    return ids.join(prevalence.where(F.col("prevalence") < threshold), "chemical_entity", "left_semi").select("run_name", "spectrum_index").distinct()


def mask_rare(spectra: DataFrame, ids: DataFrame, prevalence: DataFrame, threshold: float = 0.05) -> DataFrame:
    keys = rare_spectra(ids, prevalence, threshold).withColumn("_rare", F.lit(True))
    return spectra.join(keys, ["run_name", "spectrum_index"], "left").withColumn("intensity", F.when(F.col("_rare"), F.transform("intensity", lambda x: F.lit(0.0))).otherwise(F.col("intensity"))).drop("_rare")


def reference_span(cigar: Column) -> Column:
    """Reference bases an alignment covers; 0 for an empty, unknown or malformed CIGAR."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1)
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return F.when(cigar.rlike(r"^(\d+[MIDNSHP=X])+$"), total).otherwise(F.lit(0).cast("long"))


#: Regions up to which they are sent to all tasks and reads are tested where they are.
FEW_REGIONS = 10_000


def _spans(reads: DataFrame) -> DataFrame:
    return reads.withColumn("_end", F.col("position") + F.greatest(reference_span(F.col("cigar")), F.lit(1)) - 1)


def marked_regions(reads: DataFrame, regions: DataFrame, mark: str = "in_region", bin_size: int = BIN, few: int = FEW_REGIONS) -> DataFrame:
    """reads with mark: whether the aligned span overlaps a closed region [start, end] of the read's chromosome; a read without a
    span counts by its position.

    Few regions travel to the reads, as one sorted array a chromosome of disjoint spans; nothing is shuffled. More are met by
    an equi-join on bins with an exact test after it; regions are clipped to the places that reads of the chromosome have, so
    that an open-ended one isn't cut to endless bins.
    """
    if regions.limit(few + 1).count() <= few:
        by = regions.groupBy(F.col("chromosome").alias("_c")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e")))).alias("_r"))
        out = _spans(reads).join(F.broadcast(by), F.col("chromosome") == F.col("_c"), "left")
        hit = F.exists("_r", lambda r: ~((F.col("_end") < r["s"]) | (F.col("position") > r["e"])))
        return out.withColumn(mark, F.coalesce(hit, F.lit(False))).drop("_c", "_r", "_end")
    spans = _spans(reads)
    extent = spans.groupBy(F.col("chromosome").alias("_c")).agg(F.min("position").alias("_low"), F.max("_end").alias("_high"))
    r = regions.select(F.col("chromosome").alias("_rc"), F.col("start").alias("_s"), F.col("end").alias("_e")).join(extent, F.col("_rc") == F.col("_c")).where("_e >= _low and _s <= _high and _s <= _e")
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.greatest("_s", "_low") / bin_size), F.floor(F.least("_e", "_high") / bin_size)))).drop("_c", "_low", "_high")
    binned = spans.select("run_name", "read_index", "chromosome", "position", "_end", F.explode(F.sequence(F.floor(F.col("position") / bin_size), F.floor(F.col("_end") / bin_size))).alias("_bin"))
    hit = (F.col("chromosome") == F.col("_rc")) & (F.col("_bin") == F.col("_b")) & ~((F.col("_end") < F.col("_s")) | (F.col("position") > F.col("_e")))
    keys = ["run_name", "read_index"]
    found = binned.join(r, hit, "left_semi").select(*keys).distinct().withColumn(mark, F.lit(True))
    return reads.join(found, keys, "left").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def reads_in_regions(reads: DataFrame, regions: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Reads, each once, that marked_regions marks."""
    return marked_regions(reads, regions, "_in", bin_size).where("_in").drop("_in")


def mask_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads with seq and qual of those in a region overwritten by zero bytes of the same length."""
    out = marked_regions(reads, regions, "_hit")
    zero = lambda c: F.when(F.col("_hit"), F.repeat(F.lit("\0"), F.octet_length(c)).cast("binary")).otherwise(F.col(c).cast("binary"))
    return out.withColumns({"seq": zero("seq"), "qual": zero("qual")}).drop("_hit")


def strip_read_names(reads: DataFrame) -> DataFrame:
    return reads.withColumn("read_name", F.lit(""))


def constant_qualities(reads: DataFrame, value: int = 30) -> DataFrame:
    byte = F.unhex(F.lit(f"{value & 0xFF:02x}"))
    return reads.withColumn("qual", F.unhex(F.repeat(F.hex(byte), F.octet_length("qual"))))


#: Quality bytes that are drawn at once.
_DRAW = 1 << 20


def seeded_qualities(reads: DataFrame, seed: int, run: str = "run_name", index: str = "read_index") -> DataFrame:
    """Every quality byte replaced by one of 0 to 93 drawn with a seed.

    The bytes of a run are one sequence in the order of its reads, and the generator can jump to any place of it, so each
    task draws its own reads' bytes: no run has to be in one task, and the order of tasks doesn't matter. One place is one
    64-bit step of the generator, so the bytes aren't those of another program's generator with the same seed.
    """
    from .index import running_bytes

    placed = running_bytes(reads, [run], index, F.octet_length("qual").cast("long"), "_at")

    def draw(batches):
        for b in batches:
            names = b.schema.names
            made = []
            for raw, at in zip(b.column(names.index("qual")).to_pylist(), b.column(names.index("_at")).to_pylist()):
                if raw is None:
                    made.append(None)
                    continue
                bits = np.random.PCG64(seed)
                bits.advance(at)
                made.append((bits.random_raw(len(raw)) % np.uint64(94)).astype(np.uint8).tobytes() if raw else b"")
            kept = [i for i, c in enumerate(names) if c != "_at"]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()) if names[i] == "qual" else b.column(i) for i in kept], names=[names[i] for i in kept])

    return placed.select(*reads.columns, "_at").mapInArrow(draw, reads.schema)


def bin_quality(q: Column) -> Column:
    """Eight-level quality of a Phred score."""
    # Upper bound and representative of each range.
    levels = [(1, 0), (9, 5), (19, 15), (24, 22), (29, 27), (34, 32), (39, 37)]
    out = F.when(q <= levels[0][0], levels[0][1])
    for bound, value in levels[1:]:
        out = out.when(q <= bound, value)
    return out.otherwise(40)


# -- a policy over a whole dataset ------------------------------------------------------------------------------------------

# Share of people in whom a common metabolite is found. An illustration; give your own table for real use.
PREVALENCE = {
    "CHEBI:15377": 1.0, "CHEBI:17234": 0.98, "CHEBI:15903": 0.95, "CHEBI:16015": 0.92, "CHEBI:15422": 0.90,
    "CHEBI:16236": 0.88, "CHEBI:15846": 0.85, "CHEBI:16027": 0.80, "CHEBI:16810": 0.75, "CHEBI:17754": 0.70,
    "CHEBI:18367": 0.60, "CHEBI:27823": 0.50, "CHEBI:16335": 0.35, "CHEBI:28790": 0.20, "CHEBI:17895": 0.10,
    "CHEBI:15756": 0.05, "CHEBI:28044": 0.02, "CHEBI:16856": 0.01, "CHEBI:29073": 0.005, "CHEBI:30089": 0.001,
}
FEATURES = ["base_v1", "compound_identifications", "compound_quantifications", "compound_provenance", "compound_per_run_provenance", "opt_compound_headers", "opt_anonymized"]


@dataclass
class Policy:
    """What to do; nothing unless asked."""

    redact_saav_spectra: bool = False
    mask_intensity_below_quantile: float | None = None
    mask_rare_metabolites: bool = False
    rare_metabolite_threshold: float = 0.05
    rare_metabolite_table: dict[str, float] | None = None
    coarsen_mz_decimals: int | None = None
    coarsen_chemical_shift_decimals: int | None = None
    strip_metadata_fields: bool = False
    strip_read_names: bool = False
    randomise_qualities: bool = False
    randomise_qualities_constant: int = 30
    randomise_qualities_seed: int | None = None
    mask_regions: list[tuple[str, int, int]] = field(default_factory=list)


#: Counters of a run, in the order of the audit record.
COUNTERS = ("spectra_redacted", "intensities_zeroed", "mz_values_coarsened", "chemical_shift_values_coarsened", "metabolites_masked", "metadata_fields_stripped")
READ_COUNTERS = ("read_names_stripped", "qualities_randomised", "reads_in_masked_region")


def anonymize(data: Dataset, policy: Policy, source: str = "", target: str = "", now: int | None = None) -> tuple[Dataset, dict]:
    """The dataset under a policy, and what was done: counters and policies_applied.

    A spectrum's values are coarsened, then masked below their quantile, then zeroed if rare. Identifications are cut to the
    indices their run has left when spectra go, without mapping them to new ones. Quantifications, the provenance of runs,
    instruments and details of fragmentation are left out; one record of provenance tells the counters, and the dataset
    gains opt_anonymized. Counters are sums over the tables, one pass each.
    """
    tables, done, applied = dict(data.tables), dict.fromkeys(COUNTERS + READ_COUNTERS, 0), []
    spark = next(iter(tables.values())).sparkSession
    size = lambda c: F.sum(F.size(c).cast("long"))
    if "spectra" in tables:
        spectra, ids = tables["spectra"], tables.get("identifications")
        names, old = [c for c in ("mz", "intensity", "chemical_shift") if c in spectra.columns], spectra
        counts = {}
        if policy.redact_saav_spectra and ids is not None:
            keys = ids.where(is_variant()).select("run_name", "spectrum_index").distinct()
            done["spectra_redacted"] = spectra.join(keys, ["run_name", "spectrum_index"], "left_semi").count()
            spectra = spectra.join(keys, ["run_name", "spectrum_index"], "left_anti")
            if done["spectra_redacted"]:
                applied.append("redact_saav_spectra")
        for c, decimals, counter in (("mz", policy.coarsen_mz_decimals, "mz_values_coarsened"), ("chemical_shift", policy.coarsen_chemical_shift_decimals, "chemical_shift_values_coarsened")):
            if decimals is not None and c in names:
                counts[counter] = size(c)
                spectra = spectra.withColumn(c, coarsen(F.col(c), decimals))
        if policy.mask_intensity_below_quantile is not None:
            spectra = spectra.withColumn("_masked", mask_below_quantile(F.col("intensity"), policy.mask_intensity_below_quantile))
            below = F.size(F.filter(F.arrays_zip(F.col("intensity").alias("a"), F.col("_masked").alias("b")), lambda p: F.col("_threshold").isNotNull() & (p["a"] < F.col("_threshold"))))
            spectra = spectra.withColumn("_threshold", quantile(F.col("intensity"), policy.mask_intensity_below_quantile)).withColumn("_below", below.cast("long"))
            spectra = spectra.withColumn("intensity", F.col("_masked"))
            counts["intensities_zeroed"] = F.sum("_below")
        if policy.mask_rare_metabolites and ids is not None:
            table = spark.createDataFrame(list((policy.rare_metabolite_table or PREVALENCE).items()), "chemical_entity string, prevalence double")
            keys = rare_spectra(ids, F.broadcast(table), policy.rare_metabolite_threshold).withColumn("_rare", F.lit(True))
            spectra = spectra.join(keys, ["run_name", "spectrum_index"], "left")
            counts["metabolites_masked"] = F.count_if(F.col("_rare"))
            spectra = spectra.withColumn("intensity", F.when(F.col("_rare"), F.transform("intensity", lambda x: F.lit(0.0))).otherwise(F.col("intensity")))
        if counts:
            row = spectra.agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in counts.items()]).first()
            done |= row.asDict()
        applied += [p for p, c in (("coarsen_mz_decimals", "mz_values_coarsened"), ("coarsen_chemical_shift_decimals", "chemical_shift_values_coarsened"), ("mask_intensity_below_quantile", "intensities_zeroed"), ("mask_rare_metabolites", "metabolites_masked")) if done[c]]
        detail = ("activation_method", "isolation_target_mz", "isolation_lower_offset", "isolation_upper_offset")
        spectra = spectra.select(*[F.lit(None).cast(dict(old.dtypes)[c]).alias(c) if c in detail else c for c in old.columns])
        if policy.redact_saav_spectra:
            spectra = reindexed(spectra, "run_name", "spectrum_index").select(*old.columns)
            if ids is not None:
                tables["identifications"] = kept_identifications(ids, spectra)
        tables["spectra"] = spectra
    title = data.title
    if policy.strip_metadata_fields:
        done["metadata_fields_stripped"], title = 1, ""
        applied.append("strip_metadata_fields")
    if "reads" in tables:
        reads = tables["reads"]
        if policy.strip_read_names or policy.randomise_qualities:
            n = reads.count()
            done["read_names_stripped"], done["qualities_randomised"] = n * policy.strip_read_names, n * policy.randomise_qualities
        if policy.strip_read_names:
            reads = strip_read_names(reads)
            applied.append("strip_read_names")
        if policy.randomise_qualities:
            reads = constant_qualities(reads, policy.randomise_qualities_constant) if policy.randomise_qualities_seed is None else seeded_qualities(reads, policy.randomise_qualities_seed)
            applied.append("randomise_qualities")
        if policy.mask_regions:
            regions = spark.createDataFrame(policy.mask_regions, "chromosome string, start long, end long")
            done["reads_in_masked_region"] = reads_in_regions(reads, regions).count()
            kinds = dict(reads.dtypes)
            reads = mask_regions(reads, regions)
            reads = reads.withColumns({c: F.col(c).cast(kinds[c]) for c in ("seq", "qual")})
            applied.append("mask_regions")
        tables["reads"] = reads
    if "runs" in tables and "instrument" in tables["runs"].columns:
        tables["runs"] = tables["runs"].withColumn("instrument", F.lit(None).cast(tables["runs"].schema["instrument"].dataType))
    tables.pop("quantifications", None)
    tables["provenance"] = audit_record(spark, done, applied, source, target, now)
    return Dataset(tables, title, list(FEATURES)), done | {"policies_applied": applied}


def audit_record(spark, done: dict, applied: list[str], source: str, target: str, now: int | None = None) -> DataFrame:
    """The one record of provenance that an anonymised dataset has."""
    told = {"policies": json.dumps(applied)} | {c: str(done[c]) for c in COUNTERS}
    return spark.createDataFrame([("", 0, int(time.time()) if now is None else now, "lumenforge anonymizer", told, [source], [target])], "run_name string, seq long, timestamp_unix long, software string, parameters map<string, string>, input_refs array<string>, output_refs array<string>")
