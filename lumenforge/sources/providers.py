"""Where a dataset's tables are kept: Parquet folders by default, memory for the session, one SQLite file for small datasets.
More can be registered by the scheme of their URLs."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable
from contextlib import closing
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..dataset import Dataset, open_dataset, write_dataset
from ..schema import TABLES
from .files import local


class Provider:
    """Opens and writes datasets at URLs of a scheme."""

    def open(self, spark: SparkSession, url: str) -> Dataset:
        raise NotImplementedError

    def write(self, data: Dataset, url: str) -> None:
        raise NotImplementedError


class ParquetProvider(Provider):
    def open(self, spark, url):
        return open_dataset(spark, url)

    def write(self, data, url):
        write_dataset(data, url)


class MemoryProvider(Provider):
    """Datasets by name, for the session."""

    kept: dict[str, Dataset] = {}

    def open(self, spark, url):
        if url not in self.kept:
            raise FileNotFoundError(url)
        return self.kept[url]

    def write(self, data, url):
        self.kept[url] = data


class SqliteProvider(Provider):
    """Each table as one of SQLite with the columns' JSON, and a schema beside it. It is a file of one process: rows stream
    through the driver, so it is for small datasets."""

    def open(self, spark, url):
        path = local(urlparse(url)._replace(scheme="").geturl() if url.startswith("sqlite:") else url)
        tables = {}
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
            meta = dict(db.execute("select key, value from meta"))
            for name, schema in db.execute("select name, schema from tables").fetchall():
                rows = db.execute(f'select value from "t_{name}" order by rowid').fetchall()  # noqa: S608  names are the schema's
                text = spark.createDataFrame(rows, "value string")
                tables[name] = text.select(F.from_json("value", schema).alias("r")).select("r.*")
        return Dataset(tables, meta.get("title", ""), json.loads(meta.get("features", "[]")))

    def write(self, data, url):
        path = local(urlparse(url)._replace(scheme="").geturl() if url.startswith("sqlite:") else url)
        with closing(sqlite3.connect(path)) as db, db:
            db.execute("create table meta (key text primary key, value text)")
            db.executemany("insert into meta values (?, ?)", [("title", data.title), ("features", json.dumps(data.features))])
            db.execute("create table tables (name text primary key, schema text)")
            for name, df in data.tables.items():
                if name not in TABLES:
                    raise ValueError(f"unknown table {name!r}")
                db.execute("insert into tables values (?, ?)", (name, df._jdf.schema().toDDL()))
                db.execute(f'create table "t_{name}" (value text)')
                db.executemany(f'insert into "t_{name}" values (?)', ((r[0],) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()))  # noqa: S608


PROVIDERS: dict[str, Provider] = {"": ParquetProvider(), "memory": MemoryProvider(), "sqlite": SqliteProvider()}
#: Schemes of file systems, which hold Parquet folders.
FILES = ("file", "s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "hdfs", "viewfs", "http", "https", "dbfs", "az")


def register(scheme: str, make: Callable[[], Provider]) -> None:
    PROVIDERS[scheme] = make()


def provider_of(url: str, provider: str | None = None) -> Provider:
    """The provider of a URL's scheme, or that of a name; paths and file systems are Parquet; an unknown scheme is an error."""
    scheme = provider if provider is not None else urlparse(url).scheme
    scheme = "" if scheme in FILES or scheme == "parquet" else scheme
    if scheme in ("hdf5", "zarr"):
        raise NotImplementedError(f"{scheme} needs a library that isn't here")
    if scheme not in PROVIDERS:
        raise ValueError(f"no provider of {scheme!r}")
    return PROVIDERS[scheme]


def open_url(spark: SparkSession, url: str, provider: str | None = None) -> Dataset:
    return provider_of(url, provider).open(spark, url)


def write_url(data: Dataset, url: str, provider: str | None = None) -> None:
    provider_of(url, provider).write(data, url)


def legacy_rows(spark: SparkSession, text: str, table: str) -> DataFrame:
    """A table from the JSON list that older files keep in an attribute; lists and maps within rows may be JSON themselves."""
    rows = json.loads(text or "[]")
    for r in rows:
        for k, v in r.items():
            if isinstance(v, str) and v[:1] in "[{" and k in ("evidence_chain", "input_refs", "output_refs", "parameters", "abundances", "evidence_refs"):
                r[k] = json.loads(v)
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows] or [], "value string")
    return lines.select(F.from_json("value", TABLES[table]).alias("r")).select("r.*")
