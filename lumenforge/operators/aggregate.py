"""Aggregations behind import and export: base peaks, packed runs, pivots, frame statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def base_peak(intensity: Column) -> Column:
    """Largest intensity; 0 of an empty array."""
    return F.coalesce(F.array_max(intensity), F.lit(0.0))


def pack_frames(frames: DataFrame, peaks: DataFrame, key: str, order: str) -> DataFrame:
    """frames with the arrays of their peaks in their order, empty where there are none, their number and base peak."""
    packed = peaks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "mz", "intensity"))).alias("p"))
    out = frames.join(packed, key, "left").withColumn("p", F.coalesce("p", F.array().cast(packed.schema["p"].dataType)))
    return out.select(*frames.columns, F.transform("p", lambda x: x["mz"]).alias("mz"), F.transform("p", lambda x: x["intensity"]).alias("intensity")).withColumns({"length": F.size("mz").cast("long"), "base_peak_intensity": base_peak(F.col("intensity"))})


def abundance_pivot(quants: DataFrame, samples: list[str], order: str) -> DataFrame:
    """A row an entity, a column a sample; of several values the last by order counts; absent ones are null."""
    return quants.groupBy("chemical_entity").pivot("sample_ref", samples).agg(F.max_by("abundance", order))


def best_confidence(ids: DataFrame) -> DataFrame:
    return ids.groupBy("chemical_entity").agg(F.greatest(F.max("confidence_score"), F.lit(0.0)).alias("best_confidence"))


def best_score(*scores: str) -> Column:
    """Greatest score of a row, nulls skipped, 0 at least."""
    return F.greatest(F.lit(0.0), *scores)


def frame_statistics(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("frames"), F.count_if(F.col("ms_level") == 1).alias("ms1"), F.count_if(F.col("ms_level") == 2).alias("ms2"), F.min("retention_time").alias("rt_min"), F.max("retention_time").alias("rt_max"))


def backfill_entities(features: DataFrame, evidence: DataFrame) -> DataFrame:
    """Features whose entity is the id of an evidence row they refer to, seen later in the file, take that row's entity."""
    e = evidence.select(F.col("sme_id"), F.col("chemical_entity").alias("_entity"), F.col("line_no").alias("_line"))
    on = (F.col("chemical_entity") == F.col("sme_id")) & F.array_contains("evidence_refs", F.col("sme_id")) & (F.col("line_no") < F.col("_line"))
    return features.join(e, on, "left").withColumn("chemical_entity", F.coalesce("_entity", "chemical_entity")).drop("sme_id", "_entity", "_line")


def run_is_detailed(spectra: DataFrame) -> DataFrame:
    """run_name, detailed: whether any spectrum of the run has an activation method or an isolation window; only then are
    those columns written for the run."""
    some = lambda c: F.max(F.coalesce(F.col(c), F.lit(0)) != 0)
    return spectra.groupBy("run_name").agg(F.greatest(*[some(c) for c in ("activation_method", "isolation_target_mz", "isolation_lower_offset", "isolation_upper_offset")]).alias("detailed"))


def grid_extent(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """Largest place of an image's pixels on each axis; places count from 1."""
    return pixels.groupBy(image).agg(*[F.max(c).alias(f"max_{c}") for c in "xyz"])


def run_totals(df: DataFrame, run: str = "run_name", length: str = "length") -> DataFrame:
    return df.groupBy(run).agg(F.count("*").alias("rows"), F.sum(length).cast("long").alias("total_length"))


def largest_by(df: DataFrame, run: str, index: str, value: str) -> DataFrame:
    """Index and value of the greatest value of each run; of equal ones the first."""
    return df.groupBy(run).agg(F.max_by(index, F.struct(value, -F.col(index))).alias("top_index"), F.max(value).alias("top"))


def first_run(runs: DataFrame, spectrum_class: str) -> DataFrame:
    """The first run by name of a class; none if there is none."""
    return runs.where(F.col("spectrum_class") == spectrum_class).orderBy("run_name").limit(1)


def sequence_digest(records: DataFrame) -> str:
    """MD5 of name, newline, sequence, newline of all records in order of their names. Names are sorted over all tasks; the
    sequences stream through the driver one by one, since a digest of this kind has no parts."""
    import hashlib

    digest = hashlib.md5()
    for name, seq in records.select("name", "seq").orderBy("name").toLocalIterator():
        digest.update(f"{name}\n".encode() + (bytes(seq) if not isinstance(seq, str) else seq.encode()) + b"\n")
    return digest.hexdigest()


def frames_of_peaks(peaks: DataFrame, frames: DataFrame, levels: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Spectra of a run with ion mobility: the peaks of each frame in their stored order, frames without peaks empty."""
    packed = peaks.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("nth", "mz", "intensity", "inv_ion_mobility"))).alias("p"))
    wanted = frames.where(F.col("ms_level").isin(*levels))
    out = wanted.join(packed, "frame", "left").withColumn("p", F.coalesce("p", F.array().cast(packed.schema["p"].dataType)))
    arrays = {c: F.col("p").getField(c) for c in ("mz", "intensity", "inv_ion_mobility")}
    return out.withColumns(arrays).withColumns({"length": F.size("mz").cast("long"), "base_peak_intensity": base_peak(F.col("intensity"))}).drop("p")
