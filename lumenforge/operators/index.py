"""Offsets, differences, sequence checks and encounter order: running operations within a run.

A run may hold billions of rows, so no window spans one. Rows are dealt to blocks of neighbouring indices; each block is
summed up first, the few sums are run over, and a window within each block does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that a block of neighbouring indices has, where indices are spread evenly.
BLOCK_ROWS = 1 << 20


def blocked(df: DataFrame, keys: list[str], index: str, rows: int | None = None) -> DataFrame:
    """df with _block, which ascends with the index within the keys' values. Blocks hold about `rows` rows if indices are spread
    evenly between their extremes, as dense ones are. One row for each value of the keys is held against the table."""
    rows = rows or BLOCK_ROWS
    ends = df.groupBy(*keys).agg(F.min(index).alias("_low"), F.max(index).alias("_high"), F.count("*").alias("_n"))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_low", ((F.col("_high").cast("double") - F.col("_low") + 1) / F.ceil(F.col("_n") / rows)).alias("_width"))
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    return df.join(ends, on, "left").withColumn("_block", F.floor((F.col(index).cast("double") - F.col("_low")) / F.col("_width"))).drop("_low", "_width", *[f"_k{i}" for i in range(len(keys))])


def _before(df: DataFrame, keys: list[str], sums: dict[str, Column], run: dict[str, Column]) -> DataFrame:
    """df, which has _block, with columns of run: functions over the blocks' sums, for the blocks before a row's own."""
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, "_block").agg(*[c.alias(n) for n, c in sums.items()])
    blocks = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), *[c.over(w).alias(n) for n, c in run.items()])
    on = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(blocks, on, "left").drop("_b", *[f"_k{i}" for i in range(len(keys))])


def _within(keys: list[str], index: str):
    return Window.partitionBy(*keys, "_block").orderBy(index)


def _earlier(keys: list[str], index: str):
    return _within(keys, index).rowsBetween(Window.unboundedPreceding, -1)


def with_offsets(df: DataFrame, run: str, index: str, length: str = "length", name: str = "offset") -> DataFrame:
    """Exclusive prefix sums of lengths in each run, from 0."""
    out = _before(blocked(df, [run], index), [run], {"_sum": F.sum(length)}, {"_base": F.sum("_sum")})
    own = F.coalesce(F.sum(length).over(_earlier([run], index)), F.lit(0))
    return out.withColumn(name, (own + F.coalesce("_base", F.lit(0))).cast("long")).drop("_base", "_block")


def first_differences(df: DataFrame, run: str, index: str, value: str) -> DataFrame:
    """delta: each value less the one before it in its run; the first as it is."""
    out = _before(blocked(df, [run], index), [run], {"_last": F.max_by(F.struct(value), index)}, {"_base": F.last("_last")})
    before = F.coalesce(F.lag(F.struct(value)).over(_within([run], index)), F.col("_base"))
    return out.withColumn("delta", F.when(before.isNull(), F.col(value)).otherwise(F.col(value) - before[value])).drop("_base", "_block")


def sequence_violations(units: DataFrame, dataset: str = "dataset_id", sequence: str = "au_sequence", arrival: str = "arrival") -> DataFrame:
    """Units whose sequence number isn't greater than all before them in their dataset. Of units that arrive at once the one with
    the lower number comes first, so the result doesn't depend on tasks."""
    out = _before(blocked(units, [dataset], arrival), [dataset], {"_sum": F.max(sequence)}, {"_base": F.max("_sum")})
    earlier = Window.partitionBy(dataset, "_block").orderBy(arrival, sequence).rowsBetween(Window.unboundedPreceding, -1)
    most = F.greatest(F.max(sequence).over(earlier), F.col("_base"))
    return out.withColumn("_most", most).where(F.col(sequence) <= F.col("_most")).drop("_most", "_base", "_block")


def carry_forward(df: DataFrame, run: str, index: str, value: Column, name: str) -> DataFrame:
    """The last value that isn't null before each row."""
    held = blocked(df.withColumn("_value", value), [run], index)
    out = _before(held, [run], {"_last": F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(index)))}, {"_base": F.last("_last", ignorenulls=True)})
    own = F.last("_value", ignorenulls=True).over(_earlier([run], index))
    return out.withColumn(name, F.coalesce(own, "_base")).drop("_value", "_base", "_block")


def encounter_order(df: DataFrame, value: str, position: str, run: str | None = None) -> DataFrame:
    """Distinct values numbered from 0 by their first position. Values are grouped before they are ranked; there are few, such
    as the chromosomes of a run, of which 65,535 may be told apart."""
    keys = [value] if run is None else [run, value]
    first = df.groupBy(*keys).agg(F.min(position).alias("first_position"))
    w = Window.orderBy("first_position") if run is None else Window.partitionBy(run).orderBy("first_position")
    return first.withColumn("ordinal", F.row_number().over(w).cast("long") - 1)


def unique_names(df: DataFrame, name: str, index: str, run: str | None = None) -> DataFrame:
    """unique_name: a name seen before, by index, becomes name#index. Each name's first place is found by an aggregation, so
    a name that all rows share gathers nowhere."""
    keys = [name] if run is None else [run, name]
    first = df.groupBy(*keys).agg(F.min(index).alias("_first")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    on = F.col(keys[0]).eqNullSafe(F.col("_k0"))
    if run is not None:
        on = on & F.col(name).eqNullSafe(F.col("_k1"))
    again = F.concat(F.col(name), F.lit("#"), F.col(index).cast("string"))
    return df.join(first, on, "left").withColumn("unique_name", F.when(F.col(index) > F.col("_first"), again).otherwise(F.col(name))).drop("_first", *[f"_k{i}" for i in range(len(keys))])


def reindexed(df: DataFrame, run: str, index: str) -> DataFrame:
    """Rows of each run numbered 0 to n - 1 in their old order."""
    out = _before(blocked(df, [run], index), [run], {"_sum": F.count("*")}, {"_base": F.sum("_sum")})
    number = F.row_number().over(_within([run], index)) - 1 + F.coalesce("_base", F.lit(0))
    return out.withColumn("_number", number.cast("long")).withColumn(index, F.col("_number")).drop("_number", "_base", "_block")


def coordinate_sorted(reads: DataFrame) -> DataFrame:
    """sort_rank of each read by chromosome, in order of first appearance in its run, then position, then index."""
    keys = ["run_name", "chromosome"]
    sizes = reads.groupBy(*keys).agg(F.min("read_index").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("run_name").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("run_name").alias("_r"), F.col("chromosome").alias("_c"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    out = _before(blocked(reads, keys, "position"), keys, {"_sum": F.count("*")}, {"_base": F.sum("_sum")})
    own = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("position", "read_index")) - 1
    out = out.withColumn("_own", own).join(starts, F.col("run_name").eqNullSafe(F.col("_r")) & F.col("chromosome").eqNullSafe(F.col("_c")))
    return out.withColumn("sort_rank", (F.col("_start") + F.coalesce("_base", F.lit(0)) + F.col("_own")).cast("long")).drop("_start", "_base", "_own", "_block", "_r", "_c")


def running_bytes(df: DataFrame, keys: list[str], order: str, size: Column, name: str = "start") -> DataFrame:
    """Where each row's bytes begin if the rows of the keys' values are written one after the other by order."""
    sized = blocked(df.withColumn("_size", size), keys, order)
    out = _before(sized, keys, {"_sum": F.sum("_size")}, {"_base": F.sum("_sum")})
    own = F.coalesce(F.sum("_size").over(_earlier(keys, order)), F.lit(0))
    return out.withColumn(name, (own + F.coalesce("_base", F.lit(0))).cast("long")).drop("_size", "_base", "_block")
