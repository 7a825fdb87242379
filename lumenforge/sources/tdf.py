"""Metadata and frames of timsTOF acquisitions, from the SQLite file in their folder."""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import local

#: Kinds of frames in MsMsType: 0 is a survey scan, all others are fragment scans.
SURVEY = 0


def _connect(folder: str):
    here = local(folder)
    if here is None:
        raise ValueError("SQLite files are read from a mounted folder")
    return closing(sqlite3.connect(f"file:{here.rstrip('/')}/analysis.tdf?mode=ro", uri=True))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """frame, retention_time, ms_level and peaks of each frame; a table of metadata, of some rows a second of an acquisition."""
    with _connect(folder) as db:
        rows = [(int(i), float(t), 1 if int(k) == SURVEY else 2, int(n or 0)) for i, t, k, n in db.execute("select Id, Time, MsMsType, NumPeaks from Frames order by Id")]
    return spark.createDataFrame(rows, "frame long, retention_time double, ms_level int, peaks long")


def metadata(spark: SparkSession, folder: str) -> dict:
    """Counts of frames, range of times, and the two tables of properties."""
    from ..operators.aggregate import frame_statistics

    row = frame_statistics(frames(spark, folder)).first().asDict()
    with _connect(folder) as db:
        known = {r[0] for r in db.execute("select name from sqlite_master where type = 'table'")}
        tables = {t: {str(k): str(v) for k, v in db.execute(f"select Key, Value from {t}")} if t in known else {} for t in ("GlobalMetadata", "Properties")}  # noqa: S608  fixed names
    return row | {"global": tables["GlobalMetadata"], "properties": tables["Properties"]}


def spectra(peaks: DataFrame, frames_: DataFrame, run_name: str, ms2: bool = False) -> DataFrame:
    """Spectra of a run from its peaks (frame, nth, mz, intensity, inv_ion_mobility) and frames: peaks in their stored order,
    frames without any as empty spectra, numbered in order of frames. The vendor's binary that holds peaks needs the vendor's
    library; peaks come as a table."""
    from ..operators.aggregate import frames_of_peaks
    from ..operators.index import reindexed

    out = frames_of_peaks(peaks, frames_, (1, 2) if ms2 else (1,)).withColumn("run_name", F.lit(run_name)).withColumn("spectrum_index", F.col("frame"))
    return reindexed(out, "run_name", "spectrum_index")
