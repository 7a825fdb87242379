"""Predicates over the spectrum, read and access-unit indexes, as columns that Catalyst pushes into the scan.

Interval conventions differ on purpose: ranges over spectra and access units are closed, a genomic region is half-open on
the start position, masks are closed overlaps of the aligned span. `Query` keeps a row only if its comparisons hold, so NaN
fails them; `UnitFilter` drops a row only if a comparison fails, so NaN passes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import GENOMIC_CLASS, PAIRED, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def closed(c: str, low: float, high: float) -> Column:
    """low <= c <= high; never true of NaN."""
    return F.col(c).between(F.lit(low), F.lit(high)) & ~F.isnan(F.col(c))


@dataclass(frozen=True)
class Query:
    """A conjunction of optional predicates; a later setting replaces an earlier one; none accepts all."""

    rt: tuple[float, float] | None = None
    level: int | None = None
    sign: int | None = None
    precursor: tuple[float, float] | None = None
    base_peak: float | None = None

    def with_retention_time_range(self, low: float, high: float) -> Query:
        return replace(self, rt=(low, high))

    def with_ms_level(self, level: int) -> Query:
        return replace(self, level=level)

    def with_polarity(self, sign: int) -> Query:
        return replace(self, sign=sign)

    def with_precursor_mz_range(self, low: float, high: float) -> Query:
        return replace(self, precursor=(low, high))

    def with_base_peak_intensity_at_least(self, least: float) -> Query:
        return replace(self, base_peak=least)

    def condition(self) -> Column:
        parts = []
        if self.rt is not None:
            parts.append(closed("retention_time", *self.rt))
        if self.level is not None:
            parts.append(F.col("ms_level") == self.level)
        if self.sign is not None:
            parts.append(F.col("polarity") == self.sign)
        if self.precursor is not None:
            parts.append(closed("precursor_mz", *self.precursor))
        if self.base_peak is not None:
            parts.append((F.col("base_peak_intensity") >= F.lit(self.base_peak)) & ~F.isnan("base_peak_intensity"))
        return _all(parts)

    def on(self, spectra: DataFrame) -> DataFrame:
        return spectra.where(self.condition())

    def matching_indices(self, spectra: DataFrame, by: tuple[str, ...] = ("spectrum_index",)) -> DataFrame:
        """Ascending indices of the matching spectra."""
        return self.on(spectra).select(*by).orderBy(*by)


@dataclass(frozen=True)
class UnitFilter:
    """Selective access to a stream of access units. Either end of a range may be open."""

    rt_min: float | None = None
    rt_max: float | None = None
    ms_level: int | None = None
    precursor_mz_min: float | None = None
    precursor_mz_max: float | None = None
    polarity: int | None = None
    dataset_id: int | None = None
    chromosome: str | None = None
    position_min: int | None = None
    position_max: int | None = None
    max_au: int | None = None

    @classmethod
    def parse(cls, raw: str) -> UnitFilter:
        """From the JSON of a client's query; what is malformed or no object accepts all."""
        try:
            found = json.loads(raw)
        except ValueError:
            return cls()
        found = found.get("filters", found) if isinstance(found, dict) else {}
        return cls(**{k: found[k] for k in cls.__dataclass_fields__ if isinstance(found, dict) and found.get(k) is not None})

    def condition(self) -> Column:
        low = lambda c, v: [] if v is None else [~(F.col(c) < F.lit(v)) | F.isnan(c) if isinstance(v, float) else F.col(c) >= v]
        high = lambda c, v: [] if v is None else [F.isnan(c) | ~(F.col(c) > F.lit(v)) if isinstance(v, float) else F.col(c) <= v]
        same = lambda c, v: [] if v is None else [F.col(c) == v]
        real = lambda v: None if v is None else float(v)
        parts = low("retention_time", real(self.rt_min)) + high("retention_time", real(self.rt_max)) + same("ms_level", self.ms_level)
        parts += low("precursor_mz", real(self.precursor_mz_min)) + high("precursor_mz", real(self.precursor_mz_max))
        parts += same("polarity", self.polarity) + same("dataset_id", self.dataset_id) + same("chromosome", self.chromosome)
        if self.position_min is not None or self.position_max is not None:
            parts += same("spectrum_class", GENOMIC_CLASS) + low("position", self.position_min) + high("position", self.position_max)
        return _all(parts)

    def on(self, units: DataFrame) -> DataFrame:
        """Units that pass, in the order of the stream, max_au of them at most."""
        found = units.where(self.condition())
        return found if self.max_au is None else found.orderBy("dataset_id", "au_sequence").limit(self.max_au)


def in_region(chromosome: str, start: int, end: int) -> Column:
    """Reads that start in [start, end) of the chromosome."""
    return (F.col("chromosome") == chromosome) & (F.col("position") >= start) & (F.col("position") < end)


def has_flag(mask: int) -> Column:
    """Any bit of mask is set."""
    return F.col("flags").bitwiseAND(F.lit(mask).cast("long")) != 0


def unmapped() -> Column:
    return has_flag(UNMAPPED)


def with_read_flags(reads: DataFrame) -> DataFrame:
    return reads.withColumns({"is_mapped": ~has_flag(UNMAPPED), "is_paired": has_flag(PAIRED), "is_reverse": has_flag(REVERSE), "is_secondary": has_flag(SECONDARY), "is_supplementary": has_flag(SUPPLEMENTARY)} | ({"read_length": F.length("seq").cast("long")} if "seq" in reads.columns else {}))


def at_index(df: DataFrame, index: str, i: int, size: int) -> DataFrame:
    """The row at i; a negative i counts from the end; IndexError out of range."""
    if not -size <= i < size:
        raise IndexError(i)
    return df.where(F.col(index) == i % size)


def objects_in_range(df: DataFrame, index: str, start: int, stop: int) -> DataFrame:
    return df.where((F.col(index) >= start) & (F.col(index) < stop))


def isolation_window(target="isolation_target_mz", lower="isolation_lower_offset", upper="isolation_upper_offset") -> Column:
    """Bounds and width; null if target and both offsets are 0."""
    t, lo, up = F.col(target), F.col(lower), F.col(upper)
    return F.when((t != 0) | (lo != 0) | (up != 0), F.struct((t - lo).alias("lower_bound"), (t + up).alias("upper_bound"), (lo + up).alias("width")))


def cv_params_for(params: str, field: str, value: str) -> Column:
    return F.filter(params, lambda p: p[field] == value)


def has_cv_param(params: str, field: str, value: str) -> Column:
    return F.exists(params, lambda p: p[field] == value)


def without_cv_param(params: Column, accession: Column) -> Column:
    """The list without its first element of an accession; as it is if there is none."""
    at = F.array_position(F.transform(params, lambda p: p["accession"]), accession)
    return F.when(at > 0, F.filter(params, lambda _, i: i + 1 != at)).otherwise(params)
