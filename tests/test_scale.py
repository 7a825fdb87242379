"""Cases that only larger tables have, on a few rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from lumenforge.views import view

READS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
ROWS = [(k, 500 + i, i, 1 + i % 7, float(4 * i + 1), 10.25 + i, "RAN"[i % 3], "F") for i, k in enumerate([5, 5, 2097151, 2097152, 8999999, 8999999])]


def index(row):
    return ((row[0] * 8 + row[3]) * 32768 + row[1] % 32768) * 16777216 + round(row[5] * 100)


@pytest.fixture
def large(spark, tmp_path):
    spark.createDataFrame(ROWS, READS).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_index_of_reads_beyond_a_long(spark, large):
    reads = view(spark, large, "reads")
    assert sorted(int(r[0]) for r in reads.select("read_index").collect()) == sorted(index(r) for r in ROWS)
    spark.createDataFrame(ROWS[:3], READS).write.parquet(f"{large}/few/lineitem.parquet")
    few = view(spark, f"{large}/few", "reads")
    assert dict(few.dtypes)["read_index"] == "bigint" and sorted(r[0] for r in few.select("read_index").collect()) == sorted(index(r) for r in ROWS[:3])


def test_index_of_reads_of_the_greatest_keys(spark, tmp_path):
    # From 2^45 orders on a step to the index is beyond a long as well.
    far = [(k, *r[1:]) for k, r in zip([2**45, -(2**45), 10**15, 2**63 - 1, -(2**63), 7], ROWS)]
    spark.createDataFrame(far, READS).write.parquet(f"{tmp_path}/lineitem.parquet")
    reads = view(spark, str(tmp_path), "reads")
    assert dict(reads.dtypes)["read_index"] == "decimal(38,0)"
    assert sorted(int(r[0]) for r in reads.select("read_index").collect()) == sorted(index(r) for r in far)
    assert driver.queries()["offsets"](spark, str(tmp_path)).count() == len(far)


@pytest.mark.parametrize("name", "chromosome_names coordinate_sort flag_mask offsets reads_in_mask_regions unique_read_names chromosome_order export_names genomic_region reference_of_reads unit_filter_genomic cigar_span first_differences mate_classes read_flags sealed_round_trip unmapped_reads".split())
def test_queries_of_reads_beyond_a_long(spark, large, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * replace (l_orderkey::hugeint as l_orderkey) from '{large}/lineitem.parquet/*.parquet'")
    wanted = con.sql(driver.oracle_sql()[name])
    plain = lambda rows: sorted(tuple(str(int(v) if isinstance(v, Decimal) else v) for v in r) for r in rows)
    assert plain(driver.queries()[name](spark, large).select(*wanted.columns).collect()) == plain(wanted.fetchall())


def test_codecs_take_strings_in_bounded_parts(spark, monkeypatch):
    from lumenforge.functions import codecs

    monkeypatch.setattr(codecs, "AT_ONCE", 1000)

    def most(rows):  # each string as the bytes it came with
        return [str(sum(len(r) for r in rows)).encode() for _ in rows]

    rows = [(i, None if i % 7 == 0 else bytes(i % 50) if i != 55 else bytes(5000)) for i in range(200)]
    got = {r[0]: (r[1], r[2]) for r in codecs.with_bytes(spark.createDataFrame(rows, "i long, raw binary").coalesce(1), "raw", "to", most).collect()}
    assert len(got) == 200 and all((a is None) == (b is None) for a, b in got.values())
    assert int(got[55][1]) == 5000 and max(int(b) for i, (a, b) in got.items() if b is not None and i != 55) <= 1000


def test_text_round_trip_runs_in_one_worker(spark, tmp_path):
    spark.createDataFrame([(1, "ACGTx\u00e9"), (2, ""), (3, "AC" * 3000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = driver.queries()["codec_round_trip"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, 6), (2, 0), (3, 6000)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_jcamp_keeps_the_side_of_a_rounding(spark, tmp_path):
    # As floats, values near the middle of two steps of 0.0001, beside a greater one that sets the factor.
    near = [0.02355, -0.04275, 0.01295, 0.12585, 0.03125, 0.9]
    spark.createDataFrame([(0, near * 3), (7, [-v for v in near])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = sorted((i, list(y), n) for i, y, n in con.sql(driver.oracle_sql()["jcamp_round_trip"]).fetchall())
    assert sorted((r[0], r[1], r[2]) for r in driver.queries()["jcamp_round_trip"](spark, str(tmp_path)).collect()) == wanted


def jcamp_rows(spark, folder, rows):
    """Rows of jcamp_round_trip and of its SQL on a table of vectors; doubles by their bits."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    plain = lambda rows: sorted(repr((i, None if y is None else list(y), n)) for i, y, n in rows)
    got = driver.queries()["jcamp_round_trip"](spark, folder).select("vec_id", "y", "n").collect()
    return plain(got), plain(con.sql(driver.oracle_sql()["jcamp_round_trip"]).fetchall())


def test_jcamp_takes_every_vector(spark, tmp_path):
    y = [0.25, -0.5, 0.125]
    rows = [(i, [v + i for v in y]) for i in (0, 59, 60, 61, 2**40, -3)] + [(60, y), (60, y[:1]), (None, y), (7, []), (8, None), (None, None)]
    got, wanted = jcamp_rows(spark, str(tmp_path), rows)
    assert len(got) == len(rows) and got == wanted


def test_jcamp_keeps_zeros_signs_and_values_of_no_number(spark, tmp_path):
    # A small negative value rounds to a negative zero in DuckDB; some vectors hold what no whole differences can.
    rows = [(0, [0.5, -0.00003, 0.00003, 0.0]), (1, [-0.0, 0.25]), (2, [None, 1.5, float("nan"), float("-inf"), float("inf")]), (3, [3e38, 1e-45, -1e-30, 0.03125]), (4, [None]), (5, [0.0, 0.0]), (6, [16777217.0, -123456.789, 0.1])]
    got, wanted = jcamp_rows(spark, str(tmp_path), rows)
    assert got == wanted and "-0.0" in wanted[0]


def test_jcamp_without_digits_keeps_every_bit():
    import numpy as np

    from lumenforge.sources import jcamp

    rng = np.random.default_rng(2)
    for n in range(1, 60):
        y = (rng.normal(size=n) * 10.0 ** rng.integers(-20, 20)).astype(np.float32).astype(float)
        if n % 3 == 0:
            y *= 10.0 ** rng.integers(-9, 9, n)  # too far apart for one factor, or for exact differences
        y = y.tolist()
        row = {"modality": "raman", "title": "t", "x": np.arange(n, dtype=float).tolist(), "y": y}
        for form in ("affn", "pac", "sqz", "dif"):
            text = jcamp.encode_jcamp(row, form, None)
            assert jcamp.spectrum_row("s", text)[5] == y
    top = 2.0**53 - 1
    for y in ([top], [-top, top] * 400, rng.uniform(0.5, 1, 700).tolist()):
        for form in ("pac", "sqz", "dif"):
            text = jcamp.encode_jcamp(row | {"x": np.arange(len(y), dtype=float).tolist(), "y": y}, form, None)
            assert "X++" in text and jcamp.spectrum_row("s", text)[5] == y
    assert "X++" in jcamp.encode_jcamp(row | {"y": [0.1] * 59}, "dif", None)


def test_rounding_in_binary(spark):
    import math

    from lumenforge.functions import text as fn

    duckdb = pytest.importorskip("duckdb")
    values = [0.00005, -0.00005, 0.00015, 1.00005, 2.5, 0.49999999999999994e-4, -0.0, -1e-9, 1e300, -1.79e308, 2.0**53 + 2, 0.285, 1.005, 4.35, float("inf"), float("nan")]
    values += [(k + 0.5) / 1e4 for k in range(-300, 300)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i long, v double").select("i", fn.rounded_in_binary(F.col("v"), 4).alias("r")).orderBy("i").select("r").collect()]
    wanted = [r[0] for r in duckdb.execute("select round(v, 4) from (select unnest(?::double[]) as v)", [values]).fetchall()]
    assert [(repr(a), math.copysign(1, a)) for a in got] == [(repr(a), math.copysign(1, a)) for a in wanted]


def test_jcamp_blocks_are_read_once_by_ranges(spark, tmp_path):
    from lumenforge.sources import jcamp

    rows = [("raman", f"{i}", [1.0, 2.0, 3.0][: 1 + i % 3], [float(i), 0.0, -1.0][: 1 + i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "modality string, title string, x array<double>, y array<double>").repartition(3)
    jcamp.write_compound(df, f"{tmp_path}/all")
    for chunk in (150, 999, 1 << 20):
        got = jcamp.read_jcamp(spark, f"{tmp_path}/all", chunk).select("modality", "title", "x", "y").collect()
        assert sorted(map(tuple, got)) == sorted(rows)
    # A file without a title, and labels before the first one.
    one = "##DATA TYPE=RAMAN SPECTRUM\n##XYDATA=(XY..XY)\n1 2\n##END=\n"
    (tmp_path / "one.jdx").write_text(one)
    (tmp_path / "two.jdx").write_text("##JCAMP-DX=5.01\r\n##title= a\r\n" + one + "## TITLE = b ##TITLE=c\r" + one)
    assert [r["title"] for r in jcamp.read_jcamp(spark, f"{tmp_path}/one.jdx").collect()] == [""]
    assert sorted(r["title"] for r in jcamp.read_jcamp(spark, f"{tmp_path}/two.jdx").collect()) == ["a", "b ##TITLE=c"]


def test_asynchronous_moves_no_pairs_of_blocks(spark):
    import numpy as np

    from lumenforge.operators import correlation as cos

    v = np.random.default_rng(5).normal(size=(700, 3))
    table = spark.createDataFrame([(10 * j, k, float(v[j, k])) for j in range(700) for k in range(3)], "j long, k long, value double")
    gap = np.arange(700)[None, :] - np.arange(700)[:, None]
    noda = np.where(gap == 0, 0.0, 1 / (np.pi * np.where(gap == 0, 1, gap)))
    d = v - v.mean(axis=0)
    wanted = d.T @ noda @ d / 699
    for rows in (32, 64, 1024, None):  # trees of several levels, an odd end, a single chunk
        df = cos.asynchronous(table, rows=rows)
        got = np.zeros((3, 3))
        for a, b, x in df.collect():
            got[a, b] = x
        assert np.abs(got - wanted).max() < 1e-12
        assert "explode(sequence" not in df._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        cos.asynchronous(table, rows=48)


def test_units_that_arrive_at_once_come_by_number(spark):
    from lumenforge.operators import index as ix

    rows = [(1, n, n // 5) for n in range(40)]
    for order in (rows, rows[::-1]):
        units = spark.createDataFrame(order, "dataset_id int, au_sequence long, arrival long").coalesce(1)
        assert ix.sequence_violations(units).count() == 0


def test_line_bitmaps_lose_no_similar_lines_and_drop_unlike_ones(spark):
    import random

    from lumenforge.llm import lines

    rng = random.Random(3)
    draw = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    text = ["x", "ab" * 90, "ab" * 40, "=" * 50, "日本語の文です" * 20]
    for n in (12, 90, 200, 1500):
        base = draw(n)
        for cut in range(0, n, max(1, n // 9)):
            text += [base[:cut] + draw(1) + base[cut + 1 :], base[:cut] + draw(n - cut)]
    df = spark.createDataFrame(list(enumerate(text)) * 2, "id long, line string")
    sized = lines._hashes(df).groupBy("id").agg({"size": "max"}).toDF("id", "size").join(lines._bitmaps(df), "id").cache()
    side = lambda x: sized.select(*[F.col(c).alias(c + x) for c in sized.columns])
    met = {(r[0], r[1]) for r in side("a").join(side("b"), F.col("ida") < F.col("idb")).where(lines._may_be_similar()).select("ida", "idb").collect()}
    sets = [{x[i : i + lines.SHINGLE] for i in range(max(1, len(x) - lines.SHINGLE + 1))} for x in text]
    share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(text)) for i in range(j)}
    assert {p for p, v in share.items() if v >= 0.8} <= met and sum(v >= 0.8 for v in share.values()) > 40
    unlike = [p for p, v in share.items() if v < 0.6 and 80 < min(len(sets[p[0]]), len(sets[p[1]])) and max(len(sets[p[0]]), len(sets[p[1]])) < 400]
    assert len(unlike) > 40 and not met & set(unlike)


def test_line_pairs_meet_once_with_their_roots(spark):
    import random

    from lumenforge.llm import lines

    rng = random.Random(9)
    base = rng.choices("abcdefghij ", k=400)
    text = []
    for _ in range(40):
        line = list(base)
        for at in rng.sample(range(400), 2):
            line[at] = rng.choice("xyz")
        text.append("".join(line))
    df = spark.createDataFrame(list(enumerate(text)), "id long, line string")
    signed = lines._signatures(df, lines._minima(df, lines.REACH)).cache()
    apart = signed.select("id", F.explode("bands").alias("band"), (F.col("id") % 7 + 100).alias("root"))
    met = lines._all_pairs(lines.materialize(apart.join(signed, "id").join(lines._bitmaps(df), "id"), "rest"))
    got = [tuple(r) for r in met.select("a", "b", "ra", "rb").collect()]
    assert len(got) == len(set(got)) and all(a < b and ra == a % 7 + 100 and rb == b % 7 + 100 for a, b, ra, rb in got)
    assert "Aggregate [a" not in met._jdf.queryExecution().optimizedPlan().toString()  # once already where they meet
    bands = {r["id"]: r["bands"] for r in signed.collect()}
    sets = [{x[i : i + lines.SHINGLE] for i in range(len(x) - lines.SHINGLE + 1)} for x in text]
    alike = {(i, j) for j in range(40) for i in range(j) if i % 7 != j % 7 and set(bands[i]) & set(bands[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(alike) > 100 and alike <= {p[:2] for p in got}


def test_pivots_of_near_copies_are_in_their_middle(spark):
    import random

    from lumenforge.llm import lines
    from lumenforge.llm.components import connected_components

    rng = random.Random(17)
    base = rng.choices("abcdefghij ", k=400)
    text = []
    for _ in range(200):
        line = list(base)
        for at in rng.sample(range(400), 4):
            line[at] = rng.choice("xyz")
        text.append("".join(line))
    text.append("".join(base))  # similar to all, which are hardly so to each other
    df = spark.createDataFrame(list(enumerate(text)), "id long, line string")
    members = lines._bucketed(lines._signatures(df, lines._minima(df, lines.REACH)).select("id", F.explode("bands").alias("band"))).cache()
    shared = {r.band for r in members.where("id = 200").collect()}
    assert len(shared) == lines.BANDS and {r.pivot for r in members.collect() if r.band in shared} == {200}
    roots = connected_components(lines._links(members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), df))
    assert lines._apart(members, roots).count() < 0.1 * members.count()  # so few are left for all pairs
