"""Mixing sources to target weights by iterative proportional fitting: the expected tokens of all (source, language, topic)
cells are raked to marginal targets in turn, with inclusion probabilities held at 1 at most; documents are then sampled by
the calibrated probability of their cell."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import columns_free, drop_table, materialize

DIMENSIONS = ("source", "lang", "topic")
#: Share of all tokens to keep; exponent that flattens a dimension's own shares where no target is given.
RATE, TEMPER = 0.7, 0.7
SWEEPS, SETTLED = 200, 1e-10
#: Up to so many cells are raked on the driver (some 100 bytes each); more are raked as a table.
DRIVER_CELLS = 200_000
NONE = "(none)"


def tokens(text: Column) -> Column:
    """Blank-separated words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """The form a text speaks in, as a stand-in where no topic column is given: table, figures, shouting, note or prose."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: 1 - F.length(F.translate(text, chars, "")) / size
    return (
        F.when(text.isNull() | (F.length(text) == 0), NONE)
        .when(share("|") > 0.03, "table")
        .when(share("0123456789") > 0.1, "figures")
        .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.4, "shouting")
        .when(size < 400, "note")
        .otherwise("prose")
    )


def goals(shares: Mapping[str, float], given: Mapping[str, float] | None, temper: float = TEMPER) -> dict[str, float]:
    """Target shares of one dimension's values: those given, of values that occur, or the tempered shares; they sum to 1."""
    want = {k: (given.get(k, 0.0) if given is not None else v**temper if v > 0 else 0.0) for k, v in shares.items()}
    total = sum(want.values())
    if not total:
        raise ValueError("no target value occurs in the corpus")
    return {k: v / total for k, v in want.items()}


def rake(labels: list[np.ndarray], weight: np.ndarray, targets: list[np.ndarray], rate: float = RATE) -> np.ndarray:
    """Inclusion probabilities of cells: labels has for each dimension the value's index of every cell, weight their tokens,
    targets the shares of values. Marginals are met where probabilities of 1 or less can meet them."""
    p, total = np.full(len(weight), rate), float(weight.sum())
    for _ in range(SWEEPS):
        before = p
        for at, goal in zip(labels, targets):
            have = np.bincount(at, weight * p, len(goal))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.where(have > 0, rate * total * goal / have, 0.0)
            p = np.minimum(1.0, p * factor[at])
        if np.abs(p - before).max(initial=0.0) < SETTLED:
            break
    return p


def _rake_on_driver(cells: DataFrame, given: Mapping, rate: float) -> DataFrame:
    rows = cells.orderBy(*DIMENSIONS).collect()
    weight = np.array([float(r["weight"]) for r in rows])
    labels, targets = [], []
    for d in DIMENSIONS:
        values, at = np.unique(np.array([r[d] for r in rows], object).astype(str), return_inverse=True)
        have = np.bincount(at, weight, len(values))
        goal = goals(dict(zip(values.tolist(), (have / max(1.0, have.sum())).tolist())), given.get(d)) if weight.sum() else {v: 0.0 for v in values.tolist()}
        labels.append(at)
        targets.append(np.array([goal[v] for v in values.tolist()]))
    p = rake(labels, weight, targets, rate)
    found = [(*(r[d] for d in DIMENSIONS), float(x)) for r, x in zip(rows, p)]
    return cells.sparkSession.createDataFrame(found, ", ".join(f"{d} string" for d in DIMENSIONS) + ", p double")


def _rake_as_table(cells: DataFrame, given: Mapping, rate: float) -> DataFrame:
    """The same where cells are too many for the driver: each sweep joins every dimension's factors."""
    total = cells.agg(F.sum("weight")).first()[0] or 0
    want = {}
    for d in DIMENSIONS:
        shares = cells.groupBy(d).agg(F.sum("weight").alias("have"))
        if d in given and given[d] is not None:
            shares = shares.join(cells.sparkSession.createDataFrame(list(given[d].items()), f"{d} string, goal double"), d, "left").fillna(0.0, ["goal"])
        else:
            shares = shares.withColumn("goal", F.when(F.col("have") > 0, F.pow(F.col("have") / F.lit(float(total)), F.lit(TEMPER))).otherwise(0.0))
        sums = shares.agg(F.sum("goal")).first()[0]
        if not sums and total:
            raise ValueError("no target value occurs in the corpus")
        want[d] = materialize(shares.select(d, (F.col("goal") / F.lit(float(sums or 1))).alias("goal")), "targets")
    now = materialize(cells.withColumn("p", F.lit(float(rate))), "cells")
    for _ in range(SWEEPS):
        new = now.withColumn("before", F.col("p"))
        for d in DIMENSIONS:
            have = new.groupBy(d).agg(F.sum(F.col("weight") * F.col("p")).alias("have")).join(want[d], d)
            factor = have.select(d, F.when(F.col("have") > 0, F.lit(float(rate * total)) * F.col("goal") / F.col("have")).otherwise(0.0).alias("factor"))
            new = new.join(factor, d).withColumn("p", F.least(F.lit(1.0), F.col("p") * F.col("factor"))).drop("factor")
        new = materialize(new, "cells")
        moved = new.agg(F.max(F.abs(F.col("p") - F.col("before")))).first()[0] or 0.0
        drop_table(now)
        now = new.drop("before")
        if moved < SETTLED:
            break
    return now.select(*DIMENSIONS, "p")


def features(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with three more columns and their names by the keys cell (struct of source, lang and topic), tokens and key (what
    the draw hashes: doc_id, of a null one the text); underscores are appended on clashes. Without a topic column the topic
    is told from the text; null sources and languages are a value of their own, "(none)"."""
    names = dict(zip(("cell", "tokens", "key"), columns_free(docs, "cell", "tokens", "key")))
    value = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("topic") if "topic" in docs.columns else topic(F.col("text"))}
    cell = F.struct(*[F.coalesce(value[d].cast("string"), F.lit(NONE)).alias(d) for d in DIMENSIONS])
    return docs.withColumns({names["cell"]: cell, names["tokens"]: tokens(F.col("text")), names["key"]: F.coalesce("doc_id", F.xxhash64("text"))}), names


def calibrate(marked: DataFrame, names: dict[str, str], targets: Mapping[str, Mapping[str, float]] | None = None, rate: float = RATE, seed: int = 17, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, dict[str, str]]:
    """marked, as features() gives it, with p (the calibrated probability) and kept; and all added names.

    Targets map a dimension to shares of its values; a dimension without has its own shares, flattened by TEMPER. Texts that
    are null or empty weigh nothing, and a cell without tokens is kept at the rate of its marginals. A row is kept if the
    hash of its key falls below p, so repeated rows share their fate and a run gives the same sample again. An empty table
    gives no rows. Only cell sums leave the executors; the table of cells is broadcast up to `driver_cells` rows.
    """
    targets = targets or {}
    if bad := set(targets) - set(DIMENSIONS):
        raise ValueError(f"unknown dimensions: {sorted(bad)}")
    cell, (p, kept) = names["cell"], columns_free(marked, "p", "kept")
    cells = materialize(marked.groupBy(F.col(cell)).agg(F.sum(names["tokens"]).alias("weight")).select(f"{cell}.*", "weight"), "cells")
    few = cells.limit(driver_cells + 1).count() <= driver_cells
    found = _rake_on_driver(cells, targets, rate) if few else _rake_as_table(cells, targets, rate)
    found = found.select(F.struct(*DIMENSIONS).alias(cell), F.col("p").alias(p))
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(names["key"])), F.lit(1 << 48)) / F.lit(float(1 << 48))
    out = marked.join(F.broadcast(found) if few else found, cell).withColumn(kept, drawn < F.col(p))
    return out, names | {"p": p, "kept": kept}


def report(drawn: DataFrame, names: dict[str, str], targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """dimension, value, wanted, expected, achieved of a calibrated table: the shares of kept tokens that were asked for, that
    the probabilities give, and that the draw gave. They differ where a value would need probabilities over 1. A row for
    each value; the table is summed up by cell first."""
    cell = names["cell"]
    cells = drawn.groupBy(F.col(cell)).agg(F.sum(names["tokens"]).alias("all"), F.sum(F.col(names["tokens"]) * F.col(names["p"])).alias("expected"), F.sum(F.when(F.col(names["kept"]), F.col(names["tokens"])).otherwise(0)).alias("achieved"))
    cells = materialize(cells.select(f"{cell}.*", "all", "expected", "achieved"), "mix-cells")
    out = []
    for d in DIMENSIONS:
        rows = cells.groupBy(F.col(d).alias("value")).agg(*[F.sum(c).cast("double").alias(c) for c in ("all", "expected", "achieved")]).collect()
        sums = {c: sum(r[c] or 0.0 for r in rows) or 1.0 for c in ("all", "expected", "achieved")}
        shares = {r["value"]: (r["all"] or 0.0) / sums["all"] for r in rows}
        want = goals(shares, (targets or {}).get(d)) if any(shares.values()) else shares
        out += [(d, r["value"], want[r["value"]], (r["expected"] or 0.0) / sums["expected"], (r["achieved"] or 0.0) / sums["achieved"]) for r in rows]
    spark = drawn.sparkSession
    drop_table(cells)
    return spark.createDataFrame(out, "dimension string, value string, wanted double, expected double, achieved double")


def mix(docs: DataFrame, targets=None, rate: float = RATE, seed: int = 17) -> DataFrame:
    """The sampled rows of docs, all columns, whatever their names.

    Null and empty texts weigh nothing and are kept at their cell's rate; a null source or language is a value of its own;
    rows alike in doc_id (of a null one in text) share their fate; texts of any length are counted whole; an empty table
    gives no rows.
    """
    marked, names = calibrate(*features(docs), targets, rate, seed)
    return marked.where(names["kept"]).select(*[marked[f"`{c}`"] for c in docs.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    marked, names = features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # Read once: the features are a few bytes a document and serve the sums as well as the draw.
    marked, n = calibrate(materialize(marked.select("doc_id", *names.values()), "features"), names)
    return marked.select("doc_id", f"{n['cell']}.source", f"{n['cell']}.lang", f"{n['cell']}.topic", n["tokens"], F.round(n["p"], 9).alias("p"), n["kept"])
