"""The driver's tables read as measurement tables, in one SQL text for Spark and DuckDB alike.

Every column is an expression over one row, and filter columns are stored columns wherever they can be, so a filter on a view
reaches the scan and no view moves a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Microseconds of 2024-01-01, from which retention times count.
BEGUN = 1704067200000000
_MICROS = {"spark": "unix_micros(cast(ts as timestamp))", "duckdb": "epoch_us(ts)"}
#: Views by name, each with the tables it reads.
VIEWS = {
    "spectra": (
        "events",
        """select concat('run_', cast(user_id % 4 as {string})) as run_name, event_id as spectrum_index,
    cast({micros} - {begun} as double) / 1e6 as retention_time,
    case when event_type in ('view', 'click') then 1 else 2 end as ms_level,
    case event_id % 3 when 0 then 1 when 1 then -1 else 0 end as polarity,
    case when event_type in ('view', 'click') then cast(0 as double) else value end as precursor_mz,
    value as base_peak_intensity, event_id, cast(user_id % 4 + 1 as bigint) as dataset_id, event_type from events""",
    ),
    "reads": (
        "lineitem",
        """select concat('g', cast(l_suppkey % 3 as {string})) as run_name,
    ((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey % 32768) * 16777216 + cast(round(l_extendedprice * 100) as bigint) as read_index,
    l_returnflag as chromosome, l_partkey as position,
    cast(l_quantity as bigint) as flags, cast(l_linenumber * 10 as bigint) as length,
    concat(cast(l_linenumber * 5 as {string}), 'S', cast(l_linenumber * 10 as {string}), 'M') as cigar,
    concat('r', cast(l_orderkey as {string})) as read_name, l_orderkey, l_linestatus from lineitem""",
    ),
    "ids": (
        "orders",
        """select o_orderkey as id, concat('run_', case o_orderstatus when 'F' then '0' when 'O' then '1' else '2' end) as run_name,
    cast(o_orderkey % 1000 as bigint) as spectrum_index, o_orderpriority as chemical_entity, o_totalprice / 1e6 as confidence_score from orders""",
    ),
    "peaks": ("lineitem", "select l_orderkey as frame, l_extendedprice as mz, l_quantity as intensity, l_linenumber, l_partkey, l_suppkey from lineitem"),
    "provenance": ("conversations", "select conv_id, turn, role, concat('run_', cast(conv_id as {string})) as run_name from conversations"),
}


def text(name: str, dialect: str) -> str:
    return VIEWS[name][1].format(string="string" if dialect == "spark" else "varchar", micros=_MICROS[dialect], begun=BEGUN)


#: The first step to a read's index, which is beyond a long from about two million orders on; in decimals no step is.
_FIRST_STEP, _IN_DECIMALS = "l_orderkey * 8", "cast(l_orderkey as decimal(20, 0)) * 8"


def _wide(lineitem: DataFrame) -> bool:
    """Whether an index of the reads, or a step to it, is beyond a long."""
    high = f"({_IN_DECIMALS} + l_linenumber) * 32768 + l_partkey % 32768"
    low = "cast(round(l_extendedprice * 100) as bigint)"
    ends = lineitem.selectExpr(f"max({high})", f"max({low})", f"min({high})", f"min({low})").first()
    if None in ends:
        return False
    most, added, least, less = map(int, ends)
    return most * 16777216 + added >= 1 << 63 or least * 16777216 + less < -(1 << 63)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view of a table. Indices of reads are longs where all of the table fit, else decimals of 38 digits."""
    table, _ = VIEWS[name]
    rows, sql = spark.read.parquet(f"{sf_dir}/{table}.parquet"), text(name, "spark")
    if _FIRST_STEP in sql and _wide(rows):
        sql = sql.replace(_FIRST_STEP, _IN_DECIMALS)
    return spark.sql(sql.replace(f"from {table}", "from {t}"), t=rows)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views v_<name> before it."""
    return "with " + ", ".join(f"v_{n} as ({text(n, 'duckdb')})" for n in names) + " " + sql
