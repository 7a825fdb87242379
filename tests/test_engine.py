"""Predicates, transforms, codecs, packets and readers on the literal values of small fixtures."""

import base64
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lumenforge.dataset import Dataset, all_runs, open_dataset, write_dataset
from lumenforge.functions import codecs, protect
from lumenforge.operators import anonymize as anon, correlation as cos, index as ix
from lumenforge.plans import predicates as p
from lumenforge.sources import jcamp, mztab, sequences, spectra as src
from lumenforge.streaming import packets as pk


@pytest.fixture(scope="module")
def index(spark):
    nan = float("nan")
    rows = [(0, 1.0, 1, 1, 0.0, 100.0), (1, 2.0, 2, 1, 500.0, 200.0), (2, 3.0, 2, -1, 510.0, 300.0), (3, 4.0, 1, 1, 0.0, 400.0), (4, nan, 2, 1, nan, nan)]
    return spark.createDataFrame([(*r, 2, 1) for r in rows], "spectrum_index long, retention_time double, ms_level int, polarity int, precursor_mz double, base_peak_intensity double, dataset_id int, au_sequence int")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_query_conjunction_intervals_and_nan(index):
    assert [r[0] for r in p.Query().with_ms_level(2).with_retention_time_range(1.5, 2.5).matching_indices(index).collect()] == [1]
    assert ids(p.Query().with_polarity(-1).on(index)) == [2]
    assert ids(p.Query().on(index)) == [0, 1, 2, 3, 4]
    assert ids(p.Query().with_retention_time_range(2.0, 3.0).on(index)) == [1, 2]
    assert ids(p.Query().with_retention_time_range(3.0, 2.0).on(index)) == []
    assert ids(p.Query().with_precursor_mz_range(0.0, 500.0).on(index)) == [0, 1, 3]
    assert ids(p.Query().with_base_peak_intensity_at_least(300.0).on(index)) == [2, 3]


def test_unit_filter_lets_nan_pass_and_caps(index):
    assert ids(p.UnitFilter(rt_min=2.0, rt_max=3.0).on(index)) == [1, 2, 4]
    assert p.UnitFilter(max_au=2).on(index).count() == 2
    assert p.UnitFilter(max_au=0).on(index).count() == 0
    assert p.UnitFilter.parse("no json") == p.UnitFilter.parse("[1]") == p.UnitFilter()
    assert p.UnitFilter.parse('{"type": "query", "filters": {"ms_level": 2, "rt_min": 1}}') == p.UnitFilter(ms_level=2, rt_min=1)


def test_regions_and_flags(spark):
    rows = [(0, "chr1", 100, 0), (1, "chr1", 15000, 0), (2, "chr2", 100, 4), (3, "chr2", 200, 16), (4, "chrX", 100, 1), (5, "chr1", 25000, 0)]
    df = spark.createDataFrame(rows, "read_index long, chromosome string, position long, flags long")
    assert ids(df.where(p.in_region("chr1", 10000, 20000))) == [1]
    assert ids(df.where(p.in_region("chr1", 100, 15000))) == [0]
    assert ids(df.where(p.in_region("chrY", 0, 10**6))) == []
    assert ids(df.where(p.unmapped())) == [2] and ids(df.where(p.has_flag(0x10))) == [3] and ids(df.where(p.has_flag(1))) == [4]
    units = df.withColumn("spectrum_class", F.when(F.col("read_index") == 5, 0).otherwise(5))
    assert ids(p.UnitFilter(position_min=100, position_max=200).on(units)) == [0, 2, 3, 4]
    assert ids(p.at_index(df, "read_index", -1, 6)) == [5]
    with pytest.raises(IndexError):
        p.at_index(df, "read_index", 6, 6)


def test_filters_reach_the_scan(index, tmp_path, spark):
    index.write.parquet(str(tmp_path / "i"))
    plan = p.Query().with_ms_level(2).matching_indices(spark.read.parquet(str(tmp_path / "i")))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ms_level,2)" in plan and "base_peak_intensity" not in plan


@pytest.mark.parametrize("lengths, want", [([], []), ([5], [0]), ([3, 3, 3], [0, 3, 6]), ([4294967295, 2, 1], [0, 4294967295, 4294967297])])
def test_offsets(spark, lengths, want):
    df = spark.createDataFrame([("r", i, n) for i, n in enumerate(lengths)], "run string, i long, length long")
    assert [r.offset for r in ix.with_offsets(df, "run", "i").orderBy("i").collect()] == want


@pytest.mark.parametrize("cigar, span", [("5S50M2D3I40M", 92), ("150M", 150), ("", 0), ("*", 0), ("10M5", 0), ("10Q", 0), ("3I4S", 0), ("5M10N5=2X", 22)])
def test_reference_span(spark, cigar, span):
    assert spark.createDataFrame([(cigar,)], "c string").select(anon.reference_span(F.col("c"))).first()[0] == span


def test_mask_regions(spark):
    rows = [("g", 0, "chr1", 90, "20M"), ("g", 1, "chr1", 111, "20M"), ("g", 2, "chr1", 100, ""), ("g", 3, "chr2", 100, "5M"), ("g", 4, "chr1", 89, "11M5I"), ("g", 5, "chr1", 80, "10M20D1M")]
    reads = spark.createDataFrame([(*r, "ACGT", b"IIII") for r in rows], "run_name string, read_index long, chromosome string, position long, cigar string, seq string, qual binary")
    regions = spark.createDataFrame([("chr1", 100, 110), ("chr1", 105, 108)], "chromosome string, start long, end long")
    assert sorted(r.read_index for r in anon.reads_in_regions(reads, regions, 16).collect()) == [0, 2, 5]
    out = {r.read_index: bytes(r.seq) for r in anon.mask_regions(reads, regions).collect()}
    assert out[0] == b"\0\0\0\0" and out[1] == b"ACGT" and len(out) == 6


def test_variant_redaction_reindexes(spark):
    s = spark.createDataFrame([("run", i) for i in range(5)], "run_name string, spectrum_index long")
    found = spark.createDataFrame([("run", 1, "CHEBI:12345"), ("run", 3, "p.Ala123Thr SAAV"), ("run", 99, "variant x")], "run_name string, spectrum_index long, chemical_entity string")
    kept = anon.redact_variants(s, found)
    assert ids(kept.select("spectrum_index")) == [0, 1, 2, 3]
    assert anon.kept_identifications(found, kept).count() == 2


def test_rounding_quantile_and_rare(spark):
    df = spark.createDataFrame([([0.125, 0.375, 1.005, -0.125],), ([],)], "v array<double>")
    assert df.select(anon.coarsen(F.col("v"), 2)).first()[0] == np.round([0.125, 0.375, 1.005, -0.125], 2).tolist()
    one = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],)], "v array<double>")
    assert one.select(anon.quantile(F.col("v"), 0.3)).first()[0] == pytest.approx(np.quantile([1, 2, 3, 4], 0.3))
    assert one.select(anon.mask_below_quantile(F.col("v"), 0.5)).first()[0] == [4.0, 0.0, 3.0, 0.0]
    s = spark.createDataFrame([("r", 0, [1.0, 2.0]), ("r", 1, [3.0])], "run_name string, spectrum_index long, intensity array<double>")
    found = spark.createDataFrame([("r", 0, "CHEBI:99999"), ("r", 1, "unlisted")], "run_name string, spectrum_index long, chemical_entity string")
    table = spark.createDataFrame([("CHEBI:99999", 0.001)], "chemical_entity string, prevalence double")
    assert {r[1]: r.intensity for r in anon.mask_rare(s, found, table).select("run_name", "spectrum_index", "intensity").collect()} == {0: [0.0, 0.0], 1: [3.0]}


def test_correlation_against_numpy(spark):
    a = np.random.default_rng(1).random((7, 4))
    df = spark.createDataFrame([(j, k, float(a[j, k])) for j in range(7) for k in range(4)], "j long, k long, value double")
    d = a - a.mean(axis=0)
    n = np.array([[0 if i == j else 1 / (math.pi * (j - i)) for j in range(7)] for i in range(7)])
    want = {"sync": d.T @ d / 6, "async": d.T @ (n @ d) / 6}
    for name, f in (("sync", cos.synchronous), ("async", cos.asynchronous)):
        got = {(r.k1, r.k2): r[name] for r in f(df).collect()}
        assert all(got[i, j] == pytest.approx(want[name][i, j], rel=1e-9, abs=1e-12) for i in range(4) for j in range(4))
    with pytest.raises(ValueError):
        cos.synchronous(df.where("j = 0"))


def test_runs_and_dataset_round_trip(spark, tmp_path):
    a, b = (spark.createDataFrame([(n, m) for n in names], "run_name string, modality string") for names, m in ((["x", "y"], "ms"), (["y", "z"], "nmr")))
    runs = all_runs(a, b)
    assert sorted(map(tuple, runs.collect())) == [("x", "ms"), ("y", "ms"), ("z", "nmr")]
    prov = spark.createDataFrame([("x", ["sample://1"]), ("z", ["sample://2"])], "run_name string, input_refs array<string>")
    write_dataset(Dataset({"runs": runs, "provenance": prov}, "title", ["base", "opt_more"]), str(tmp_path / "d"))
    back = open_dataset(spark, str(tmp_path / "d"))
    assert (back.title, back.required(), back.has("opt_more")) == ("title", ["base"], True)
    assert [r.run_name for r in back.runs_for_sample("sample://2").collect()] == ["z"]
    assert back.runs_for_sample("sample://9").count() == 0 and back.runs_of_modality("ms").count() == 2
    with pytest.raises(ValueError):
        write_dataset(Dataset({"runs": a.union(b)}), str(tmp_path / "e"))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_byte_codecs_lose_nothing(data):
    for name in ("bases", "rans", "rans1"):
        pack, unpack = codecs.BYTES[name]
        assert unpack(pack([data, data[:7]])) == [data, data[:7]]
    assert codecs.delta_rans_decode(codecs.delta_rans_encode(data, 1)) == data
    once = codecs.unpack_qualities(codecs.pack_qualities(data))
    assert len(once) == len(data) and codecs.unpack_qualities(codecs.pack_qualities(once)) == once


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50))
def test_integer_codecs_lose_nothing(values):
    v = np.array(values, np.int64)
    assert (codecs.unzigzag(codecs.unvarints(codecs.varints(codecs.zigzag(v)))) == v).all()
    assert codecs.delta_rans_decode(codecs.delta_rans_encode(v.tobytes(), 8)) == v.tobytes()


def test_fixed_point_deltas():
    v = np.array([100.5, 100.25, -3.0, 1e6])
    assert codecs.delta_decode(*codecs.delta_encode(v)) == pytest.approx(v, rel=1e-12)
    assert codecs.unpack_bases(codecs.pack_bases(b"ACGTNacgtA")) == b"ACGTNacgtA"
    for bad in (b"\0\0\0", codecs.rans_encode(b"hello")[:-1], codecs.pack_bases(b"ACGTN")[:-1]):
        with pytest.raises(Exception):
            codecs.rans_decode(bad) if len(bad) > 100 or len(bad) == 3 else codecs.unpack_bases(bad)


def test_packets_round_trip_and_corruption(spark):
    assert pk.crc32c(b"123456789") == 0xE3069283
    unit = np.array([(0, 0, 2, 1, 10.5, 500.0, 2, 0.0, 9.0, 0)], pk.PREFIX).tobytes()
    assert len(unit) == 38
    stream = pk.pack(pk.STREAM_HEADER, b"s") + pk.pack(pk.DATASET_HEADER, b"d", 1) + pk.pack(pk.ACCESS_UNIT, unit, 1, 1, checksum=True) + pk.pack(pk.ACCESS_UNIT, unit, 1, 1) + pk.pack(pk.END_OF_STREAM, b"") + b"junk"
    got = pk.read_packets(spark.createDataFrame([(stream,)], "content binary"))
    assert [r.type for r in got.orderBy("arrival").collect()] == [1, 2, 3, 3, 255]
    u = pk.parse_units(got).first()
    assert (u.ms_level, u.polarity, u.retention_time, u.base_peak_intensity) == (2, -1, 10.5, 9.0)
    assert ix.sequence_violations(got.where("type = 3")).count() == 1
    broken = bytearray(pk.pack(pk.ACCESS_UNIT, unit, checksum=True))
    broken[30] ^= 1
    for bad in (bytes(broken), stream[:30], b"XX" + stream[2:]):
        with pytest.raises(ValueError):
            list(pk.unpack(bad))


def test_stream_order_is_checked_with_state(spark, tmp_path):
    rows = [(2, 0, 1, 0), (3, 0, 1, 1), (3, 0, 1, 3), (3, 0, 1, 2), (3, 0, 2, 0), (8, 0, 1, 0), (3, 0, 1, 9)]
    df = spark.createDataFrame([(*r, 0, b"") for r in rows], pk.PACKETS).coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = pk.ordered_stream(stream).writeStream.format("memory").queryName("violations").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.table("violations").collect()) == [(1, 2, "order"), (1, 9, "ended"), (2, 0, "header")]


def test_sealing_and_signatures(spark):
    df = spark.createDataFrame([("chr1", 0, b"abc"), ("chr2", 1, b"def")], "chromosome string, read_index long, qual binary")
    data = protect.aad(F.lit(258), F.col("read_index"), F.lit("qual"))
    assert bytes(df.select(data.alias("a")).first().a) == b"\x02\x01\0\0\0\0qual"
    out = protect.seal_regions(df.withColumn("dataset_id", F.lit(258)), {"chr1": b"k" * 32}, ("qual",))
    opened = out.withColumn("open", F.when(F.octet_length("qual.iv") > 0, protect.unseal(F.concat("qual.iv", "qual.ciphertext", "qual.tag"), F.lit(b"k" * 32), data)).otherwise(F.col("qual.ciphertext")))
    got = {r.read_index: (len(r.qual["iv"]), len(r.qual["tag"]), r.qual["length"], bytes(r.open)) for r in opened.collect()}
    assert got == {0: (12, 16, 3, b"abc"), 1: (0, 0, 3, b"def")}
    s = protect.signature(b"x", b"key")
    assert s.startswith("v2:") and protect.verify(b"x", b"key", s) and not protect.verify(b"y", b"key", s) and not protect.verify(b"x", b"key", None)
    with pytest.raises(ValueError):
        protect.verify(b"x", b"key", "v3:abc")


def test_sequence_files(spark, tmp_path):
    sam = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000\n@RG\tID:a\tSM:NA12878\tPL:ILLUMINA\nr1\t99\tchr1\t100\t60\t4M\t=\t200\t104\tACGT\tIIII\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"
    (tmp_path / "a.sam").write_text(sam)
    reads = sequences.read_sam(spark, str(tmp_path / "a.sam")).orderBy("line_no")
    assert [(r.read_name, r.flags, r.position, r.mate_chromosome, r.seq) for r in reads.collect()] == [("r1", 99, 100, "chr1", "ACGT"), ("r2", 4, 0, "*", "")]
    assert [r.value for r in sequences.sam_lines(reads).collect()] == sam.splitlines()[3:]
    tags = {r.record: r.tags for r in sequences.sam_header(spark, str(tmp_path / "a.sam")).collect()}
    assert tags["RG"]["SM"] == "NA12878" and tags["SQ"]["LN"] == "1000"
    (tmp_path / "bad.sam").write_text("r1\t0\tchr1\n")
    with pytest.raises(Exception, match="too few"):
        sequences.read_sam(spark, str(tmp_path / "bad.sam")).collect()
    (tmp_path / "a.fa").write_text(">s1 first\nACGT\nAC\n>s2\n" + "A" * 130 + "\n")
    fa = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r.name, r.length) for r in fa.collect()) == [("s1", 6), ("s2", 130)]
    assert [len(x) for x in sequences.fasta_lines(fa.where("name = 's2'")).first().value.split("\n")] == [3, 60, 60, 10]
    assert bytes(sequences.unaligned(fa).where("read_name = 's1'").first().qual) == b"\xff" * 6
    (tmp_path / "a.fq").write_text("@q1 x\nACGT\n+\nhhhh\n\n@q2\nAC\n+q2\nh@\n")
    fq = sequences.read_fastq(spark, str(tmp_path / "a.fq"))
    assert [(r.read_name, bytes(r.qual)) for r in fq.orderBy("read_index").collect()] == [("q1", b"IIII"), ("q2", b"I!")]
    assert "@q1\nACGT\n+\nIIII" in [r.value for r in sequences.fastq_lines(fq).collect()]


def test_spectrum_files(spark, tmp_path):
    enc = lambda v: base64.b64encode(zlib.compress(np.array(v, "<f8").tobytes())).decode()
    array = lambda v, acc: f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="MS:1000574"/><cvParam accession="{acc}"/><binary>{enc(v)}</binary></binaryDataArray>'
    one = f'<spectrum id="s" defaultArrayLength="3"><cvParam accession="MS:1000511" value="2"/><cvParam accession="MS:1000130"/><scan><cvParam accession="MS:1000016" value="2" unitAccession="UO:0000031"/></scan><cvParam accession="MS:1000744" value="445.3"/><binaryDataArrayList>{array([1, 2, 3], "MS:1000514")}{array([5, 9, 7], "MS:1000515")}</binaryDataArrayList></spectrum>'
    (tmp_path / "a.mzML").write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>{one}</spectrumList></run></mzML>')
    r = src.read_mzml(spark, str(tmp_path / "a.mzML")).first()
    assert (r.retention_time, r.ms_level, r.polarity, r.precursor_mz, r.base_peak_intensity, r.mz) == (120.0, 2, 1, 445.3, 9.0, [1.0, 2.0, 3.0])
    head = "##TITLE=t\n##DATA TYPE=UV/VIS SPECTRUM\n##FIRSTX=0\n##LASTX=4\n##NPOINTS=5\n##YFACTOR=0.5\n##XYDATA=(X++(Y..Y))\n"
    for i, body in enumerate(("0 10 12 14 14 14\n", "0+10+12+14+14+14\n", "0A0A2A4A4A4\n", "0A0KK%%\n", "0A0KKU\n")):
        (tmp_path / f"{i}.jdx").write_text(head + body + "##END=\n")
        j = jcamp.read_jcamp(spark, str(tmp_path / f"{i}.jdx")).first()
        assert (j.modality, j.x, j.y) == ("uv_vis", [0, 1, 2, 3, 4], [5.0, 6.0, 7.0, 7.0, 7.0]), body
    (tmp_path / "a.mztab").write_text("MTD\tms_run[1]-location\tfile:///d/alpha.mzML\nCOM\tx\n\nPSH\tsequence\tspectra_ref\tsearch_engine_score[1]\nPSM\tPEP\tms_run[1]:index=7\t0.9\nPSM\tTID\tms_run[2]:scan=3\tnull\n")
    found = mztab.read_mztab(spark, str(tmp_path / "a.mztab")).identifications
    assert sorted(tuple(r)[1:5] for r in found.collect()) == [("alpha", 7, "PEP", 0.9), ("run_2", 3, "TID", 0.0)]


def test_registered_queries_have_stable_columns(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).columns == ["run_name", "spectrum_index"]


def test_delta_streams_by_hand():
    # 5 and 3 differ by -2 from one to the next: zigzagged 10 and 3, a byte each.
    raw = np.array([5, 3], "<i4").tobytes()
    assert codecs.delta_rans_encode(raw, 4) == b"DRA0\x01\x04\0\0" + codecs.rans_encode(bytes([10, 3]))
    assert codecs.pack_bases(b"ACGTN") == bytes([0]) + (5).to_bytes(4, "big") + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes([0b00_01_10_11, 0]) + (4).to_bytes(4, "big") + b"N"
    assert codecs.pack_qualities(bytes([0, 30, 93])) == bytes([0, 0, 0, 0, 0, 3, 0x05, 0x70])


def test_registered_filters_reach_the_scan_and_move_nothing(spark):
    import __spark_entry__

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    found = __spark_entry__.queries()
    plan = lambda name: found[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    region = plan("genomic_region")
    assert "EqualTo(l_returnflag,R)" in region and "GreaterThanOrEqual(l_partkey,100)" in region and "LessThan(l_partkey,900)" in region
    assert "GreaterThanOrEqual(value,40.0)" in plan("base_peak_threshold") and "GreaterThanOrEqual(event_id,10)" in plan("objects_in_range")
    for name in ("genomic_region", "base_peak_threshold", "retention_time_range", "ms_level", "flag_mask", "read_flags", "unit_filter", "reads_in_mask_regions", "mask_below_quantile"):
        assert "Exchange hashpartitioning(run_name" not in plan(name) and "Window" not in plan(name), name
    assert "shipdate" not in region and "Exchange" not in region
