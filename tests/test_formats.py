"""Readers, writers, streams, protection, policies and command lines: round trips, literal values and malformed input."""

import hashlib
import io
import json
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge import dataset as ds
from lumenforge.dataset import Dataset, open_dataset, write_dataset
from lumenforge.functions import codecs, genomic_codecs as gen, protect, text as fn
from lumenforge.operators import aggregate as agg, anonymize as anon, index as ix
from lumenforge.plans import predicates as p
from lumenforge.sources import isa, jcamp, mztab, providers, sequences as seqs, spectra as xml, tdf
from lumenforge.streaming import packets as pk
from lumenforge.tools.commands import main

KEY = bytes(range(32))


# -- codecs ---------------------------------------------------------------------------------------------------------------


def plain_rans(data, freq):
    """The encoder by its definition, a byte at a time."""
    start, x, out = np.concatenate(([0], np.cumsum(freq))).tolist(), 1 << 23, bytearray()
    for s in reversed(data):
        while x >= int(freq[s]) << 19:
            out.append(x & 255)
            x >>= 8
        x = x // int(freq[s]) * 4096 + x % int(freq[s]) + start[s]
    out.reverse()
    return struct.pack(">I", x) + bytes(out)


def test_frequencies_by_hand():
    counts = np.bincount(np.frombuffer(b"abracadabra", np.uint8), minlength=256)
    f = codecs.frequencies(counts)
    # 5, 2, 2, 1, 1 of 11 parts of 4096, rounded down: 1861, 744, 744, 372, 372; three are lacking, for a, b and r.
    assert (f[97], f[98], f[114], f[99], f[100], f.sum()) == (1862, 745, 745, 372, 372, 4096)
    many = np.ones(256, np.int64)
    many[0] = 10**6
    f = codecs.frequencies(many)
    assert f.sum() == 4096 and f[1:].min() == 1 and f[0] == 4096 - 255


@pytest.mark.parametrize("order", [0, 1])
def test_rans_streams(order):
    rng = np.random.default_rng(3)
    rows = [b"", b"a", b"abracadabra", bytes(5000), rng.integers(0, 256, 3000, np.uint8).tobytes(), *[rng.choice(list(b"ACGTN"), int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 200, 60)]]
    coded = codecs.rans_encode_many(rows, order)
    assert codecs.rans_decode_many(coded) == rows
    assert coded == [codecs.rans_encode(r, order) for r in rows]
    for r, c in zip(rows, coded):
        assert struct.unpack_from(">BI", c) == (order, len(r))
        if r and not order:
            assert c[1033:] == plain_rans(r, codecs.frequencies(np.bincount(np.frombuffer(r, np.uint8), minlength=256)))
    assert codecs.rans_encode(b"")[9:1033] == struct.pack(">I", 16) * 256
    for bad in (b"", b"\x02" + coded[2][1:], coded[2][:-1], coded[2] + b"\0"):
        with pytest.raises(ValueError):
            codecs.rans_decode(bad)


def test_fixed_point_scale_of_fractions():
    for v in (0.3, 100.5, 7.0, 1e-9):
        d, scale = codecs.delta_encode(np.array([v, -v / 2]))
        assert scale == int(((1 << 62) - 1) // v)
    assert codecs.delta_encode(np.array([1.0, np.inf]))[1] == codecs.delta_encode(np.zeros(3))[1] == 1
    x = np.random.default_rng(0).uniform(100, 2000, 500)
    d, scale = codecs.delta_encode(x)
    assert np.abs(codecs.delta_decode(d, scale) - x).max() < 1e-9
    with pytest.raises(ValueError):
        codecs.delta_encode(x.reshape(2, -1))


def test_mates_and_reference_differences():
    own, pos = [0, 0, 1, 65535], [100, 200, 300, 0]
    stream = gen.mates_encode([0, 2, -1, -1], [150, 900, -1, -1], [50, -7, 0, 0], own, pos)
    assert stream[:6] == b"MIv2\x01\0" and struct.unpack_from("<QI", stream, 6) == (4, 1)
    assert [v.tolist() for v in gen.mates_decode(stream, own, pos)] == [[0, 2, -1, -1], [150, 900, -1, -1], [50, -7, 0, 0]]
    assert stream[34:36] == bytes([0, 0 | 1 << 2 | 2 << 4 | 2 << 6])  # classes packed, the first lowest
    ref = b"ACGTACGTACGTacgtNNNN" * 5
    reads, at, cigars = [b"ACGTTCGT", b"GGACGNACGT", b"TTAC"], [1, 5, 4], ["8M", "2S8M", "1I3M"]
    reads[2] = b"TTAC"
    blob = gen.sequences_encode(reads, at, cigars, ref, b"m" * 16, "uri", 2)
    head = gen.sequences_header(blob)
    assert (head["slices"], head["reads"], head["uri"], head["md5"]) == (2, 3, "uri", b"m" * 16)
    assert gen.sequences_decode(blob, at, cigars, ref) == reads
    for bad in ("8Q", "M", "99M"):
        with pytest.raises(ValueError):
            gen.sequences_encode([b"ACGTACGT"], [1], [bad], ref, b"m" * 16, "u")
    assert gen.name_tokens("M7:007:0:12a0") == ["M", "7", ":007:", "0", ":", "12", "a", "0"]


def test_read_names():
    rng = np.random.default_rng(1)
    names = [f"EAS:{i // 40}:{rng.integers(0, 9)}:{rng.integers(0, 99999)}/{1 + i % 2}" for i in range(5000)]
    names[7] = names[6]
    names[100], names[200], names[300] = "plain", "x007:0", "1" * 30
    blob = gen.names_encode(names)
    assert blob[:12] == b"NTK2\x01\0" + struct.pack("<IH", 5000, 2) and len(blob) < sum(map(len, names)) / 2
    assert gen.names_decode(blob) == names and gen.names_decode(blob, 1) == names[4096:]
    assert gen.names_encode([]) == b"NTK2\x01\x01" + bytes(6) and gen.names_decode(gen.names_encode([])) == []
    # By hand: a row by columns (a, 5), the same again (entry 0), then a match of one column and a difference of +2.
    flags, pool = bytes([0b10_00_01_00]), bytes([0b000_000_00])
    raw = lambda b: struct.pack("<IB", len(b), 0) + b
    body = raw(flags) + raw(pool) + raw(b"\x01") + raw(bytes([2, 0b10_000000])) + raw(bytes([5, 4])) + raw(b"\0") + raw(b"\x01a") + raw(b"")
    assert gen.names_encode(["a5", "a5", "a7"]) == b"NTK2\x01\0" + struct.pack("<IHI", 3, 1, 0) + struct.pack("<II", 3, len(body)) + body
    for bad in (blob[:11], b"NTK1" + blob[4:], blob[:5] + b"\x02" + blob[6:], blob[:-3]):
        with pytest.raises((ValueError, struct.error)):
            gen.names_decode(bad)
    with pytest.raises(ValueError):
        gen.names_encode(["é"])


def test_strings_and_wire_codecs():
    assert codecs.strings_decode(codecs.strings_encode(["5M", "", "é" * 200], 1)) == ["5M", "", "é" * 200]
    for c in (codecs.NONE, codecs.RANS_0, codecs.RANS_1, codecs.BASE_PACK):
        assert codecs.wire_decode(codecs.wire_encode(b"ACGTNNA", c), c) == b"ACGTNNA"
    with pytest.raises(NotImplementedError):
        codecs.wire_encode(b"", codecs.FQZCOMP)


# -- spectra --------------------------------------------------------------------------------------------------------------


def test_mzml_is_cut_into_ranges_and_indexed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xml, "CHUNK", 3000)
    rows = [(i, i * 1.5, 1 + i % 2, (1, -1, 0)[i % 3], 500.25 if i % 2 else 0.0, 2 if i % 2 else 0, [100.0 + i, 200.0], [1.0, 2.0 + i]) for i in range(40)]
    df = spark.createDataFrame(rows, "spectrum_index long, retention_time double, ms_level int, polarity int, precursor_mz double, precursor_charge int, mz array<double>, intensity array<double>").repartition(3)
    xml.write_mzml(df, str(tmp_path / "m"), 'a "run"')
    raw = xml.joined(str(tmp_path / "m"))
    (tmp_path / "x.mzML").write_bytes(raw)
    assert raw[int(raw.split(b"<indexListOffset>")[1].split(b"<")[0]) :].startswith(b"<indexList ")
    for line in raw.split(b'<index name="spectrum">')[1].split(b"</index>")[0].strip().split(b"\n"):
        assert raw[int(line.split(b">")[1].split(b"<")[0]) :].startswith(b"<spectrum ")
    got = sorted(tuple(r) for r in xml.read_mzml(spark, str(tmp_path / "x.mzML")).drop("source", "base_peak_intensity").collect())
    assert got == rows
    assert xml._pieces(spark, str(tmp_path / "x.mzML"), "spectrum").count() > 5
    (tmp_path / "none.mzML").write_text("<mzML><run/></mzML>")
    with pytest.raises(ValueError):
        xml.read_mzml(spark, str(tmp_path / "none.mzML"))


def test_chromatograms(spark, tmp_path):
    import base64

    b = lambda *v: base64.b64encode(np.array(v, "<f8").tobytes()).decode()
    cv = lambda a, v="", u="": f'<cvParam accession="{a}" value="{v}" unitAccession="{u}"/>'
    arrays = f'<binaryDataArray>{cv(xml.FLOAT64)}{cv(xml.TIME_ARRAY, u=xml.MINUTE)}<binary>{b(1, 2)}</binary></binaryDataArray><binaryDataArray>{cv(xml.FLOAT64)}{cv(xml.INTENSITY_ARRAY)}<binary>{b(5, 6)}</binary></binaryDataArray>'
    srm = f'<chromatogram id="s" defaultArrayLength="2">{cv(xml.SRM)}<precursor>{cv(xml.ISOLATION_TARGET, 400.5)}</precursor><product>{cv(xml.ISOLATION_TARGET, 200.25)}</product>{arrays}</chromatogram>'
    (tmp_path / "c.mzML").write_text(f'<mzML><run><chromatogramList><chromatogram id="t" defaultArrayLength="2">{cv(xml.TIC)}{arrays}</chromatogram>{srm}</chromatogramList></run></mzML>')
    got = {r["name"]: r for r in xml.read_chromatograms(spark, str(tmp_path / "c.mzML")).collect()}
    assert got["t"]["chromatogram_type"] == 0 and got["t"]["time"] == [60.0, 120.0]
    assert (got["s"]["chromatogram_type"], got["s"]["precursor_mz"], got["s"]["product_mz"]) == (2, 400.5, 200.25)


def test_nmrml_forms():
    x, y = np.arange(3) / 4, np.array([1.0, 2.0, 3.0])
    about, [(a, b)] = xml.parse_nmrml(xml.nmrml_bytes(x, y, "proton", 600.5, 12.0))
    assert about["nucleus_type"] == "1H" and about["spectrometer_frequency_mhz"] == 600.5 and about["sweep_width_ppm"] == 12.0
    assert a.tolist() == x.tolist() and b.tolist() == y.tolist()
    import base64

    wrap = lambda inner, n: f'<nmrML><spectrumList><spectrum1D numberOfDataPoints="{n}">{inner}</spectrum1D></spectrumList></nmrML>'.encode()
    data = lambda *v: f"<spectrumDataArray>{base64.b64encode(np.array(v, '<f8').tobytes()).decode()}</spectrumDataArray>"
    assert [v.tolist() for v in xml.parse_nmrml(wrap(data(5, 6, 7, 8), 4))[1][0]] == [[0, 1, 2, 3], [5, 6, 7, 8]]
    assert [v.tolist() for v in xml.parse_nmrml(wrap(data(5, 6, 7, 8), 0))[1][0]] == [[5, 7], [6, 8]]
    assert [v.tolist() for v in xml.parse_nmrml(wrap(data(5, 6, 7), 0))[1][0]] == [[0, 1, 2], [5, 6, 7]]
    assert [v.tolist() for v in xml.parse_nmrml(wrap(f"<xAxis>{data(1, 2)}</xAxis><yAxis>{data(3, 4)}</yAxis>", 2))[1][0]] == [[1, 2], [3, 4]]
    assert xml.parse_nmrml(b"<nmrML/>")[1] == []


def test_imzml_modes_and_errors(spark, tmp_path):
    rows = [(x, y, 1, [1.0, 2.0, 3.0], [float(x), float(y), 0.5]) for y in (1, 2) for x in (1, 2, 3)]
    df = spark.createDataFrame(rows, "x int, y int, z int, mz array<double>, intensity array<double>")
    for mode in ("continuous", "processed"):
        at = str(tmp_path / mode)
        about = xml.write_imzml(df, at, mode, uuid="00112233-4455-6677-8899-aabbccddeeff")
        got, told = xml.read_imzml(spark, at + ".imzML")
        assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(rows)
        raw = open(at + ".ibd", "rb").read()
        assert told["grid"] == [3, 2, 1] and raw[:16].hex() == told["uuid"] and hashlib.sha1(raw).hexdigest() == about["sha1"]
    with pytest.raises(ValueError):
        xml.write_imzml(df.withColumn("mz", F.when(F.col("x") == 2, F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0))).otherwise(F.col("mz"))), str(tmp_path / "bad"))
    raw = open(tmp_path / "processed.ibd", "rb").read()
    (tmp_path / "cut.ibd").write_bytes(raw[:40])
    with pytest.raises(ValueError, match="outside"):
        xml.read_imzml(spark, str(tmp_path / "processed.imzML"), str(tmp_path / "cut.ibd"))
    (tmp_path / "other.ibd").write_bytes(b"\0" * 16 + raw[16:])
    with pytest.raises(ValueError, match="UUID"):
        xml.read_imzml(spark, str(tmp_path / "processed.imzML"), str(tmp_path / "other.ibd"))


def test_jcamp_forms_and_checks():
    assert jcamp.decode_ordinates(["100 A0J2", "102 A2%J"]) == [10.0, 22.0, 22.0, 23.0][:2] + jcamp.decode_ordinates(["100 A0J2", "102 A2%J"])[2:]
    assert jcamp.decode_ordinates(["0 A5T"]) == [15.0, 15.0]
    assert jcamp.decode_ordinates(["0 A5", "1 J"]) == [15.0, 16.0]  # a difference goes on from the line before
    assert jcamp.decode_ordinates(["0 A0JT", "3 B"]) == [10.0, 11.0, 11.0, 2.0]  # a repeat gives the value again
    assert jcamp.decode_ordinates(["0 +5+6", "1 +6+7 $$ a comment +9"]) == [5.0, 6.0, 7.0]
    for bad in (["0 J"], ["0 T"]):
        with pytest.raises(ValueError):
            jcamp.decode_ordinates(bad)
    assert jcamp.yfactor_of(np.array([12345.678, -2.0])) == 10.0 ** (5 - 7) and jcamp.yfactor_of(np.zeros(2)) == 1.0
    y = np.round(np.sin(np.arange(57)) * 1000, 3)
    y[20:34] = 0.0  # a plateau over line ends
    row = {"modality": "ir", "mode": "absorbance", "title": "t # 1", "x": (400 + 2.0 * np.arange(57)).tolist(), "y": y.tolist(), "resolution_cm_inv": 4.0, "number_of_scans": 16}
    for form in ("affn", "pac", "sqz", "dif"):
        got = jcamp.spectrum_row("s", jcamp.encode_jcamp(row, form))
        assert got[1:4] == ("ir", "t # 1", "absorbance") and np.allclose(got[4], row["x"]) and np.abs(np.array(got[5]) - y).max() < 1e-3
        assert got[9:11] == (4.0, 16)
    with pytest.raises(ValueError):
        jcamp.encode_jcamp(row | {"x": (np.arange(57.0) ** 2).tolist()}, "dif")
    with pytest.raises(ValueError):
        jcamp.spectrum_row("s", "##DATA TYPE=NMR\n##XYDATA=(XY..XY)\n1 2\n##END=\n")
    head, x, _ = jcamp.decode_jcamp("##TITLE=a\n##XFACTOR=0.5\n##FIRSTX=10\n##DELTAX=2\n##NPOINTS=2\n##XYDATA=(X++(Y..Y))\n10 +1+2\n##END=")
    assert x == [5.0, 6.0]


MZTAB = """COM\tx
MTD\tmzTab-version\t2.0.0-M
MTD\tms_run[1]-location\tfile:///d/one.two.mzML
MTD\tassay[1]-sample_ref\tS1
MTD\tstudy_variable[1]-description\tcontrol
SMH\tSML_ID\tdatabase_identifier\tchemical_formula\tchemical_name\tbest_id_confidence_value\tabundance_study_variable[1]\tabundance_study_variable[2]
SML\t1\tCHEBI:1\tC6\tglucose\t0.5\t10\tnull
SML\t2\t\t\twater\tNA\t3\t4
SFH\tSMF_ID\tSME_ID_REFS\tadduct_ion\texp_mass_to_charge\tcharge\tretention_time_in_seconds\tabundance_assay[1]\tabundance_assay[2]
SMF\tf1\te1|e2\t[M+H]1+\t181.07\t1\t60.5\t7\t8
SMF\tf2\tnull\tnull\t50\t1.0\t1\tnull\tnull
SEH\tSME_ID\tdatabase_identifier\tchemical_name\tspectra_ref\trank
SME\te1\tCHEBI:1\tglucose\tms_run[1]:scan=17\t2
SME\te9\t\t\tms_run[3]:index=x\tnull
"""


def test_mztab_sections(spark, tmp_path):
    (tmp_path / "m.mztab").write_text(MZTAB)
    t = mztab.read_mztab(spark, str(tmp_path / "m.mztab"))
    assert t.is_metabolomics and t.provenance("src", 5)["input_refs"] == ["src", "file:///d/one.two.mzML"]
    ids = [tuple(r)[1:] for r in t.identifications.orderBy("line_no").collect()]
    assert ids == [
        ("metabolomics", 0, "CHEBI:1", 0.5, ["name=glucose", "formula=C6"]),
        ("metabolomics", 0, "water", 0.0, []),
        ("one.two", 17, "CHEBI:1", 0.5, ["SME_ID=e1", "name=glucose"]),
        ("run_3", 0, "e9", 1.0, ["SME_ID=e9"]),
    ]
    quants = sorted(tuple(r)[1:] for r in t.quantifications.collect())
    assert quants == [("CHEBI:1", "control", 10.0, ""), ("water", "control", 3.0, ""), ("water", "study_variable_2", 4.0, "")]
    feats = {r["feature_id"]: r for r in t.features.collect()}
    assert feats["smf_f1"]["chemical_entity"] == "CHEBI:1" and feats["smf_f1"]["abundances"] == {"S1": 7.0, "assay_2": 8.0}
    assert feats["smf_f2"]["chemical_entity"] == "f2" and feats["smf_f2"]["charge"] == 0 and feats["smf_f2"]["adduct_ion"] == ""
    old = spark.createDataFrame([("r", 1, "A", 0.1, ["e"])], mztab.IDENTIFICATION)
    both = mztab.linked({"identifications": old}, t)
    assert both["identifications"].count() == 5 and both["features"].count() == 2


def test_mztab_written_and_read(spark, tmp_path):
    ids = spark.createDataFrame([(0, "r1", 5, "P1", 0.25, ["eng"]), (1, "r2", 6, "P2\tx", 1234567.0, [])], "line_no long, " + mztab.IDENTIFICATION)
    quants = spark.createDataFrame([(0, "P1", "s2", 1.5, ""), (1, "P1", "s1", 2.5, ""), (2, "P1", "s2", 0.5, ""), (3, "P9", "", 4.0, "")], "line_no long, " + mztab.QUANTIFICATION)
    feats = spark.createDataFrame([(0, "f1", "r1", "PEP", 60.0, 500.5, 2, "", {"s1": 3.0}, ["ms_run[1]:scan=3"])], "line_no long, " + mztab.FEATURE)
    for version in ("1.0", "2.0.0-M"):
        at = str(tmp_path / version)
        mztab.write_mztab(at, identifications=ids, quantifications=quants, features=feats, version=version, title="T", software=("other",))
        t = mztab.read_mztab(spark, at)
        assert t.version == version and t.metadata["software[2]"].endswith("other]")
        assert sorted((r["chemical_entity"], r["sample_ref"], r["abundance"]) for r in t.quantifications.collect()) == [("P1", "s1", 2.5), ("P1", "s2", 0.5), ("P9", "sample", 4.0)]
        assert t.features.count() == 1
    first = mztab.read_mztab(spark, str(tmp_path / "1.0")).identifications.orderBy("line_no").collect()
    assert [(r["run_name"], r["spectrum_index"], r["chemical_entity"], r["confidence_score"]) for r in first] == [("r1", 5, "P1", 0.25), ("r2", 6, "P2 x", 1234570.0)]
    with pytest.raises(ValueError):
        mztab.mztab_rows(identifications=ids, version="3")


# -- sequences ------------------------------------------------------------------------------------------------------------


def test_fasta_headers_and_index(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one a > b\nACgt\nNN\n>two\n\n>three\nA\n")
    got = {r["name"]: r["seq"] for r in seqs.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"one": "ACgtNN", "two": "", "three": "A"}
    (tmp_path / "none.fa").write_text("\n\n")
    with pytest.raises(ValueError):
        seqs.read_fasta(spark, str(tmp_path / "none.fa"))
    df = spark.createDataFrame([("b", "ACGTACGTAC", 0), ("a", "AC", 1), ("b", "GGG", 2)], "name string, seq string, nth long")
    seqs.write_fasta(df, str(tmp_path / "out"), "nth", 4)
    raw = xml.joined(str(tmp_path / "out"))
    assert raw == b">b\nACGT\nACGT\nAC\n>a\nAC\n>b#2\nGGG\n"
    for line in xml.joined(str(tmp_path / "out-fai")).decode().splitlines():
        name, n, at, bases, width = line.split("\t")
        assert raw[int(at) :][: int(n) + (int(n) - 1) // 4].replace(b"\n", b"").decode() == {"b": "ACGTACGTAC", "a": "AC", "b#2": "GGG"}[name]
    assert agg.sequence_digest(df.where("nth < 2")) == hashlib.md5(b"a\nAC\nb\nACGTACGTAC\n").hexdigest()


def test_fastq_is_cut_at_records(spark, tmp_path):
    rows = [(f"r{i}", "ACGTN"[: 1 + i % 5] * 3, "@+IJ!"[: 1 + i % 5] * 3) for i in range(300)]
    (tmp_path / "a.fq").write_text("".join(f"@{n} x\n{s}\n+\n{q}\n" + ("\n" if n == "r7" else "") for n, s, q in rows))
    got = seqs.read_fastq(spark, str(tmp_path / "a.fq"), chunk=257).orderBy("read_index").collect()
    assert [(r["read_name"], r["seq"], bytes(r["qual"]).decode()) for r in got] == rows and [r["read_index"] for r in got] == list(range(300))
    for bad in ("@r\nAC\n+\nI\n", "@r\nAC\n+\n", "r\nAC\n+\nII\n"):
        (tmp_path / "bad.fq").write_text(bad)
        with pytest.raises(Exception, match="malformed|cut short"):
            seqs.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


READS = [
    ("a", 99, "chr2", 100, 60, "10M", "chr2", 150, 60, "ACGTACGTAC", "IIIIIIIIII"),
    ("b", 0, "chr1", 5, 30, "5M5S", "*", -1, 0, "ACGTNACGTA", "!!!!!!!!!!"),
    ("c", 4, "*", 0, 0, "*", "*", -1, 0, "GG", None),
    ("d", 16, "chr2", 20, 1, "3M2D3M", "chr1", 7, -9, "AAACCC", "ABCDEF"),
]


def test_sam_and_bam(spark, tmp_path):
    df = spark.createDataFrame([("g", i, *r) for i, r in enumerate(READS)], "run_name string, read_index long, read_name string, flags long, chromosome string, position long, mapq int, cigar string, mate_chromosome string, mate_position long, template_length int, seq string, qual string")
    prov = ({"software": "x", "parameters": {"CL": "x -a"}}, {"software": "x"}, {})
    lines = seqs.sam_header_lines(df, "S", "ILL", prov)
    assert lines == ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr2\tLN:2147483647", "@SQ\tSN:chr1\tLN:2147483647", "@RG\tID:rg1\tSM:S\tPL:ILL", "@PG\tID:x\tPN:x\tCL:x -a", "@PG\tID:x.1\tPN:x", "@PG\tID:pg2\tPN:"]
    seqs.write_sam(df, str(tmp_path / "s"), sample_name="S", platform="ILL", provenance=prov)
    raw = xml.joined(str(tmp_path / "s")).decode()
    body = [line.split("\t") for line in raw.splitlines() if not line.startswith("@")]
    assert [b[0] for b in body] == ["d", "a", "b", "c"] and body[1][6:8] == ["=", "150"] and body[3][9:] == ["GG", "*"] and body[2][7] == "0"
    seqs.write_bam(df, str(tmp_path / "b"), sample_name="S", platform="ILL", provenance=prov)
    (tmp_path / "x.bam").write_bytes(xml.joined(str(tmp_path / "b")))
    import gzip

    assert gzip.decompress((tmp_path / "x.bam").read_bytes())[:4] == b"BAM\1"
    reads, header = seqs.read_bam(spark, str(tmp_path / "x.bam"))
    got = [tuple(r)[1:] for r in reads.orderBy("line_no").collect()]
    back = lambda r: (*r[:7], max(0, r[7]), r[8], r[9], r[10] or "")
    assert got == [back(READS[i]) for i in (3, 0, 1, 2)]
    about = seqs.run_of_sam(header)
    assert (about["sample_name"], about["platform"], len(about["provenance"])) == ("S", "ILL", 3)
    assert [r["read_name"] for r in seqs.read_bam(spark, str(tmp_path / "x.bam"), "chr2:25-90")[0].collect()] == ["d"]
    told = seqs.dump_reads(reads, "x", about)
    assert told["read_count"] == 4 and told["sequences_md5"] == hashlib.md5("".join(READS[i][9] for i in (3, 0, 1, 2)).encode()).hexdigest()
    with pytest.raises(NotImplementedError):
        seqs.read_cram("x")


# -- streams --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stream_tables(spark):
    """600 spectra of four points, odd ones of level 2."""
    rows = [("run", i, i / 10.0, 1 + i % 2, 1, 500 + 0.1 * i if i % 2 else 0.0, 2 if i % 2 else 0, 4.0 * i + 4, [100.0 + 4 * i + k for k in range(4)], [4.0 * i + k + 1 for k in range(4)]) for i in range(600)]
    spectra = spark.createDataFrame(rows, "run_name string, spectrum_index long, retention_time double, ms_level int, polarity int, precursor_mz double, precursor_charge int, base_peak_intensity double, mz array<double>, intensity array<double>")
    runs = spark.createDataFrame([("run", "spectral", "MassSpectrum", 1, ["mz", "intensity"], ("m", "x", "", "", "", ""))], "run_name string, modality string, spectrum_class string, acquisition_mode int, channel_names array<string>, instrument struct<manufacturer: string, model: string, serial_number: string, source_type: string, analyzer_type: string, detector_type: string>")
    return {"runs": runs, "spectra": spectra}


def kinds(stream):
    return [x[0] for x in pk.unpack(pk.stream_bytes(stream))]


def test_selective_access_of_600_units(stream_tables):
    count = lambda **f: kinds(pk.dataset_stream(stream_tables, only=p.UnitFilter(**f)))
    got = count(ms_level=2)
    assert got.count(pk.ACCESS_UNIT) == 300 and got[:2] == [1, 2] and got[-2:] == [8, 255]
    assert 45 <= count(precursor_mz_min=510.0, precursor_mz_max=520.0).count(3) <= 55
    assert 0 < count(rt_min=10.0, rt_max=12.0).count(3) < 30
    capped = count(max_au=100)
    assert capped.count(3) == 100 and capped[-1] == 255
    assert count(ms_level=99) == [1, 2, 8, 255] and count(dataset_id=9) == [1, 255]


def test_stream_of_a_dataset_and_back(spark, stream_tables, tmp_path):
    reads = spark.createDataFrame([("g", i, *r[:9], bytearray(r[9].encode()), bytearray((r[10] or "").encode())) for i, r in enumerate(READS)], "run_name string, read_index long, read_name string, flags long, chromosome string, position long, mapq int, cigar string, mate_chromosome string, mate_position long, template_length int, seq binary, qual binary")
    runs = stream_tables["runs"].unionByName(spark.createDataFrame([("g", "genomic", "GenomicRead", 7)], "run_name string, modality string, spectrum_class string, acquisition_mode int"), allowMissingColumns=True)
    stream = pk.dataset_stream({"runs": runs, "spectra": stream_tables["spectra"], "reads": reads}, "T", "I", ("base_v1",), checksum=True, compress=True)
    got = kinds(stream)
    assert got == [1, 2, 2, *[3] * 600, 8, *[3] * 4, 8, 255]
    pk.write_stream(stream, str(tmp_path / "s"))
    tables, head = pk.read_dataset(pk.read_stream(spark, str(tmp_path / "s"), chunk=4096))
    assert (head["title"], head["isa_investigation"], head["features"], head["n_datasets"]) == ("T", "I", ["base_v1"], 2)
    cols = ["spectrum_index", "retention_time", "ms_level", "polarity", "precursor_mz", "precursor_charge", "base_peak_intensity", "mz", "intensity"]
    assert tables["spectra"].select(*cols).orderBy("spectrum_index").collect() == stream_tables["spectra"].select(*cols).orderBy("spectrum_index").collect()
    back = tables["reads"].orderBy("read_index").collect()
    assert [(r["read_name"], r["flags"], r["chromosome"], r["position"], r["cigar"], r["mate_position"], r["template_length"], r["seq"]) for r in back] == [(r[0], r[1], r[2], r[3], r[5], r[7], r[8], r[9]) for r in READS]


def test_stream_order_is_enforced(spark):
    head = (pk.STREAM_HEADER, 0, 0, 0, 0, pk.stream_header("", "", [], 1))
    opened = (pk.DATASET_HEADER, 0, 1, 0, 0, pk.dataset_header(1, "r", 0, "MassSpectrum", [], "{}"))
    unit = lambda seq, d=1: (pk.ACCESS_UNIT, 0, d, seq, 0, np.zeros(1, pk.PREFIX).tobytes())
    table = lambda *rows: spark.createDataFrame([(*r[:5], bytearray(r[5]), i) for i, r in enumerate(rows)], pk.PACKETS + ", arrival long")
    rules = lambda *rows: sorted(r["rule"] for r in pk.violations(table(*rows)).collect())
    assert rules(head, opened, unit(0), unit(1), (0x05, 0, 1, 0, 0, b"")) == []
    assert rules(head, opened, unit(1), unit(1)) == ["sequence doesn't ascend"]
    assert rules(head, unit(0), opened) == ["unit before its dataset"] and rules(head, opened, unit(0, 2)) == ["unit before its dataset"]
    assert rules(opened, head) == ["stream header not first"] and rules(head, head) == ["two stream headers"] and rules(opened) == ["no stream header"]
    with pytest.raises(ValueError):
        pk.read_dataset(table(head, opened, unit(1), unit(0)))
    raw = pk.pack(pk.ACCESS_UNIT, b"abc", 1, 2, checksum=True)
    assert pk.crc32c(b"123456789") == 0xE3069283
    for bad in (raw[:-1], raw[:10], b"XX" + raw[2:], raw[:24] + b"abd" + raw[27:], raw[:4] + struct.pack("<H", 8) + raw[6:]):
        with pytest.raises(ValueError):
            pk.unpack(bad)


def test_server_and_client(stream_tables):
    at, done = [], threading.Event()

    def ready(address):
        at.append(address)
        done.set()

    t = threading.Thread(target=pk.serve, args=(stream_tables,), kwargs={"ready": ready, "clients": 1}, daemon=True)
    t.start()
    assert done.wait(30)
    got = [x[0] for x in pk.fetch(at[0], p.UnitFilter(ms_level=1, max_au=7), 120)]
    assert got == [1, 2, *[3] * 7, 8, 255]


def test_dropped_stream_files(spark, stream_tables, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tis").write_bytes(pk.stream_bytes(pk.dataset_stream(stream_tables, only=p.UnitFilter(max_au=50))))
    got = []
    sink = pk.capped_sink(lambda df: got.extend(df.select("au_sequence").collect()), 10)
    query = pk.subscribe(spark, str(tmp_path / "in"), p.UnitFilter(ms_level=2)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r[0] for r in got] == [2 * i + 1 for i in range(10)]


def test_simulator(spark):
    one = pk.simulate(spark, 80, seed=3, n_peaks=20).orderBy("spectrum_index").collect()
    assert one == pk.simulate(spark.newSession(), 80, seed=3, n_peaks=20).orderBy("spectrum_index").collect()
    last = None
    for r in one:
        assert r["retention_time"] == r["spectrum_index"] / 10 and 15 <= len(r["mz"]) <= 25 and r["mz"] == sorted(r["mz"])
        if r["ms_level"] == 1:
            last = r["mz"][int(np.argmax(r["intensity"]))]
            assert r["precursor_mz"] == 0 and r["precursor_charge"] == 0
        else:
            assert last is None or r["precursor_mz"] == last
            assert r["precursor_charge"] in (2, 3)


# -- protection -----------------------------------------------------------------------------------------------------------


def test_channel_segments_and_headers(spark, stream_tables):
    units = stream_tables["spectra"].where("spectrum_index < 5").withColumns({"dataset_id": F.lit(1), "au_sequence": F.col("spectrum_index")})
    shut = protect.seal_headers(protect.seal_channels(units, KEY, ("intensity",)), KEY)
    row = shut.orderBy("spectrum_index").first()
    assert (len(row["intensity"]["iv"]), len(row["intensity"]["tag"]), len(row["intensity"]["ciphertext"]), row["intensity"]["length"]) == (12, 16, 32, 32)
    assert row["header"]["length"] == 36 and "ms_level" not in shut.columns
    back = protect.open_channels(protect.open_headers(shut, KEY), KEY, ("intensity",)).orderBy("spectrum_index").collect()
    assert [r["intensity"] for r in back] == [r["intensity"] for r in units.orderBy("spectrum_index").collect()] and [r["ms_level"] for r in back] == [1, 2, 1, 2, 1]
    moved = shut.withColumn("au_sequence", F.col("au_sequence") + 1)
    with pytest.raises(Exception):
        protect.open_channels(moved, KEY, ("intensity",)).collect()
    with pytest.raises(ValueError):
        protect.seal_channels(units, b"short", ("intensity",))


def test_encrypted_stream(spark, stream_tables):
    units = stream_tables["spectra"].where("spectrum_index < 6").withColumns({"dataset_id": F.lit(1), "au_sequence": F.col("spectrum_index")})
    shut = protect.seal_channels(units, KEY, ("mz", "intensity"))
    with pytest.raises(ValueError):
        pk.sealed_stream(shut, stream_tables["runs"], ())
    for sealed, more in ((shut, []), (protect.seal_headers(shut, KEY), ["opt_encrypted_au_headers"])):
        sealed = sealed.persist()  # each evaluation draws nonces anew
        stream = pk.sealed_stream(sealed, stream_tables["runs"], ("opt_per_au_encryption",), checksum=True, wrapped=b"w" * 60, kek="aes-256-gcm")
        raw = pk.unpack(pk.stream_bytes(stream))
        assert [x[0] for x in raw] == [1, 4, 2, *[3] * 6, 8, 255]
        assert pk.parse_protection(raw[1][5])["wrapped_dek"] == b"w" * 60 and raw[3][1] & pk.ENCRYPTED
        table = spark.createDataFrame([(*x[:5], bytearray(x[5]), i) for i, x in enumerate(raw)], pk.PACKETS + ", arrival long")
        got, features = pk.read_sealed(table)
        assert features == ["opt_per_au_encryption", *more]
        back = got.select("dataset_id", "au_sequence", "header", F.col("channels")["mz"].alias("mz"), F.col("channels")["intensity"].alias("intensity"))
        opened = protect.open_channels(back, KEY, ("mz", "intensity")).orderBy("au_sequence")
        assert [r["mz"] for r in opened.collect()] == [r["mz"] for r in units.orderBy("au_sequence").collect()]
        if more:
            assert [r["ms_level"] for r in protect.open_headers(back.drop("mz", "intensity"), KEY).orderBy("au_sequence").collect()] == [1, 2, 1, 2, 1, 2]
    with pytest.raises(ValueError):
        pk.read_sealed(table.where(F.col("type") != pk.DATASET_HEADER))


def test_region_keys(spark):
    reads = spark.createDataFrame([(1, i, c, 5, 60, 0, bytearray(b"ACGT"), bytearray(b"IIII")) for i, c in enumerate(("chr1", "chr2", None))], "dataset_id int, read_index long, chromosome string, position long, mapq int, flags long, seq binary, qual binary")
    shut = protect.seal_regions(reads, {"chr1": KEY, protect.HEADERS_KEY: KEY})
    assert "chromosome" not in shut.columns
    assert sorted(len(r["seq"]["iv"]) for r in shut.collect()) == [0, 0, 12]
    back = protect.open_regions(shut, {"chr1": KEY, protect.HEADERS_KEY: KEY}).orderBy("read_index").collect()
    assert [(r["chromosome"], bytes(r["seq"])) for r in back] == [("chr1", b"ACGT"), ("chr2", b"ACGT"), (None, b"ACGT")]
    only = protect.seal_regions(reads, {protect.HEADERS_KEY: KEY})
    assert bytes(only.first()["seq"]) == b"ACGT"
    with pytest.raises(Exception):
        protect.open_regions(protect.seal_regions(reads, {"chr1": KEY}), {"chr2": KEY}).collect()
    with pytest.raises(ValueError):
        protect.open_regions(shut, {"chr1": KEY})


def test_canonical_bytes_and_signatures(spark):
    df = spark.createDataFrame([(1, 1, "é", 0.5), (0, 258, None, -1.0)], "nth int, a int, b string, c double")
    assert b"".join(protect.canonical_rows(df, ["a", "b", "c"], ["nth"])) == struct.pack("<i", 258) + b"\0\0\0\0" + struct.pack("<d", -1.0) + struct.pack("<i", 1) + b"\x02\0\0\0\xc3\xa9" + struct.pack("<d", 0.5)
    assert b"".join(protect.canonical_rows(df, ["a"], ["nth"], {"a": "u1"})) == b"\x02\x01"[:0] + np.array([258], "<i8").astype("<u1").tobytes() + b"\x01"
    reads = spark.createDataFrame([(i, bytearray(b"AC"), 5 + i, i) for i in range(4)], "read_index long, seq binary, position long, flags long").repartition(3)
    signed = protect.sign_run(reads, KEY)
    assert set(signed) == {"seq", "position", "flags"} and protect.verify_run(reads, KEY, signed)
    assert not protect.verify_run(reads.withColumn("flags", F.col("flags") + 1), KEY, signed)
    assert not protect.verify_run(reads, KEY, {k: v for k, v in signed.items() if k != "seq"})
    assert protect.verify(b"x", KEY, protect.signature(b"x", KEY)[3:]) and not protect.verify(b"x", KEY, None)
    with pytest.raises(ValueError):
        protect.verify(b"x", KEY, "v3:abc")
    with pytest.raises(protect.Unsupported):
        protect.signature(b"x", KEY, "ml-dsa-87")
    import hmac

    one = spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(fn.hmac_sha256(F.col("b"), KEY), fn.crc32c(F.col("b"))).first()
    assert one[0] == hmac.new(KEY, b"abc", "sha256").hexdigest() and one[1] == pk.crc32c(b"abc")


def test_envelope_keys_and_catalogue(spark):
    dek, info = protect.wrap_new_key(spark, KEY, "k1")
    assert protect.unwrap_key(spark, info, KEY) == dek and len(dek) == 32
    new = bytes(32)
    turned = protect.rotate_key(spark, info, KEY, new, "k2")
    assert protect.unwrap_key(spark, turned, new) == dek and [h["kek_id"] for h in turned.history] == ["k1"]
    assert protect.KeyInfo.from_json(turned.to_json()) == turned
    with pytest.raises(Exception):
        protect.unwrap_key(spark, turned, KEY)
    with pytest.raises(protect.Unsupported):
        protect.rotate_key(spark, turned, new, b"x" * 1568, "k3", "ml-kem-1024")
    assert protect.is_supported("aes-256-gcm") and not protect.is_supported("shake256") and protect.algorithms("reserved") == ["shake256"]
    for bad in (("aes-256-gcm", b"1", "symmetric"), ("ml-kem-1024", KEY, "symmetric"), ("aes-256-gcm", KEY, "public"), ("hmac-sha256", b"", "symmetric")):
        with pytest.raises(ValueError):
            protect.validate_key(*bad)


# -- policies and running operators -----------------------------------------------------------------------------------------


def test_policy_of_five_spectra(spark):
    rows = [("run_0001", i, i * 2.5, 1, 1, 950.0, np.linspace(100, 200, 10).tolist(), [100.0 * k + 50 for k in range(10)]) for i in range(5)]
    spectra = spark.createDataFrame(rows, "run_name string, spectrum_index long, retention_time double, ms_level int, polarity int, base_peak_intensity double, mz array<double>, intensity array<double>")
    ids = spark.createDataFrame([("run_0001", 1, "p.SAAV", 0.9, []), ("run_0001", 2, "CHEBI:29073", 0.9, []), ("run_0001", 3, "CHEBI:15377", 0.9, []), ("run_0001", 4, "x", 0.1, [])], "run_name string, spectrum_index long, chemical_entity string, confidence_score double, evidence_chain array<string>")
    data = Dataset({"spectra": spectra, "identifications": ids}, "T")
    policy = anon.Policy(redact_saav_spectra=True, mask_intensity_below_quantile=0.5, mask_rare_metabolites=True, coarsen_mz_decimals=0, strip_metadata_fields=True)
    out, done = anon.anonymize(data, policy, "in", "out", 7)
    assert [done[c] for c in anon.COUNTERS] == [1, 20, 40, 0, 1, 1]
    assert done["policies_applied"] == ["redact_saav_spectra", "coarsen_mz_decimals", "mask_intensity_below_quantile", "mask_rare_metabolites", "strip_metadata_fields"]
    got = out.tables["spectra"].orderBy("spectrum_index").collect()
    assert [r["spectrum_index"] for r in got] == [0, 1, 2, 3] and [r["retention_time"] for r in got] == [0.0, 5.0, 7.5, 10.0]
    assert got[0]["intensity"] == [0.0] * 5 + [550.0, 650.0, 750.0, 850.0, 950.0] and got[1]["intensity"] == [0.0] * 10
    assert [r["spectrum_index"] for r in out.tables["identifications"].orderBy("spectrum_index").collect()] == [1, 2, 3]
    audit = out.tables["provenance"].first()
    assert audit["timestamp_unix"] == 7 and audit["parameters"]["mz_values_coarsened"] == "40" and json.loads(audit["parameters"]["policies"]) == done["policies_applied"]
    assert out.title == "" and "opt_anonymized" in out.features
    same, none = anon.anonymize(data, anon.Policy())
    assert none["policies_applied"] == [] and same.tables["spectra"].orderBy("spectrum_index").collect() == spectra.orderBy("spectrum_index").collect()


@pytest.mark.parametrize("few", [10, 0])
def test_regions_few_or_many(spark, few):
    reads = spark.createDataFrame([("g", i, "c", 100 * i, "50M" if i % 2 else "*") for i in range(50)], "run_name string, read_index long, chromosome string, position long, cigar string")
    regions = spark.createDataFrame([("c", 340, 400), ("c", 4900, 1 << 62), ("d", 0, 9)], "chromosome string, start long, end long")
    got = {r["read_index"] for r in anon.marked_regions(reads, regions, "m", 128, few).where("m").collect()}
    want = {i for i in range(50) for s, e in ((340, 400), (4900, 1 << 62)) if not (100 * i + (49 if i % 2 else 0) < s or 100 * i > e)}
    assert got == want


def test_seeded_qualities_do_not_depend_on_tasks(spark):
    reads = spark.createDataFrame([("g", i, bytearray(bytes(i % 7))) for i in range(60)], "run_name string, read_index long, qual binary")
    one = [bytes(r["qual"]) for r in anon.seeded_qualities(reads.repartition(1), 5).orderBy("read_index").collect()]
    assert one == [bytes(r["qual"]) for r in anon.seeded_qualities(reads.repartition(7), 5).orderBy("read_index").collect()]
    assert [len(q) for q in one] == [i % 7 for i in range(60)] and max(map(max, filter(None, one))) <= 93 and len({q for q in one if len(q) == 6}) > 5


@pytest.mark.parametrize("rows", [7, 1000])
def test_running_operators_by_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(ix, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(2)
    data = [("ab"[i % 2] if i % 11 else None, i * 3 + 1, int(rng.integers(0, 9)), int(rng.integers(0, 50)), f"n{rng.integers(0, 30)}") for i in range(200)]
    df = spark.createDataFrame(data, "run string, idx long, length long, v long, name string").repartition(5)
    by = {}
    for r in sorted(data, key=lambda r: r[1]):
        by.setdefault(r[0], []).append(r)
    check = lambda out, column, want: {(r["run"], r["idx"]): r[column] for r in out.collect()} == want
    assert check(ix.with_offsets(df, "run", "idx"), "offset", {(k, r[1]): sum(x[2] for x in v[:i]) for k, v in by.items() for i, r in enumerate(v)})
    assert check(ix.first_differences(df, "run", "idx", "v"), "delta", {(k, r[1]): r[3] - (v[i - 1][3] if i else 0) for k, v in by.items() for i, r in enumerate(v)})
    big = F.when(F.col("v") > 30, F.col("v"))
    assert check(ix.carry_forward(df, "run", "idx", big, "c"), "c", {(k, r[1]): next((x[3] for x in reversed(v[:i]) if x[3] > 30), None) for k, v in by.items() for i, r in enumerate(v)})
    bad = {(r["run"], r["idx"]) for r in ix.sequence_violations(df, "run", "v", "idx").collect()}
    assert bad == {(k, r[1]) for k, v in by.items() for i, r in enumerate(v) if any(x[3] >= r[3] for x in v[:i])}
    assert sorted((str(r["run"]), r["idx"]) for r in ix.reindexed(df, "run", "idx").collect()) == sorted((str(k), i) for k, v in by.items() for i in range(len(v)))
    names = {(r["run"], r["idx"]): r["unique_name"] for r in ix.unique_names(df, "name", "idx", "run").collect()}
    assert names == {(k, r[1]): r[4] + (f"#{r[1]}" if any(x[4] == r[4] for x in v[:i]) else "") for k, v in by.items() for i, r in enumerate(v)}


# -- datasets and places -------------------------------------------------------------------------------------------------------


def test_dataset_writing_cursor_and_appending(spark, stream_tables, tmp_path):
    spectra = stream_tables["spectra"].where("spectrum_index < 20").withColumns({"activation_method": F.lit(1), "isolation_target_mz": F.lit(0.0), "isolation_lower_offset": F.lit(0.0), "isolation_upper_offset": F.lit(0.0)})
    write_dataset(Dataset({"runs": stream_tables["runs"], "spectra": spectra}, "T"), str(tmp_path / "d"), "gzip", ("intensity",))
    data = open_dataset(spark, str(tmp_path / "d"))
    assert data.features == ["opt_ms2_activation_detail"]
    back = data.tables["spectra"].orderBy("spectrum_index").collect()
    assert np.allclose([r["intensity"] for r in back], [r["intensity"] for r in spectra.orderBy("spectrum_index").collect()], rtol=1e-12)
    with pytest.raises(ValueError):
        ds.check_detail(spectra.drop("isolation_target_mz"))
    cursor = ds.Cursor(data.tables["spectra"])
    assert [r["spectrum_index"] for r in cursor] == list(range(20)) and not cursor.has_more()
    assert not cursor.seek(21) and cursor.seek(18) and next(cursor)["spectrum_index"] == 18 and cursor.position == 19
    w = ds.RunWriter(spark, str(tmp_path / "w"), "r")
    w.append(ms_level=1, mz=[1.0])
    w.flush()
    w.append(ms_level=2)
    w.flush()
    w.append(ms_level=3)
    w.close()
    assert sorted((r["spectrum_index"], r["ms_level"]) for r in spark.read.parquet(str(tmp_path / "w" / "spectra")).collect()) == [(0, 1), (1, 2)]


def test_references_and_clashing_runs(spark):
    embedded = spark.createDataFrame([("u", "c", "ACGT")], "uri string, chromosome string, seq string")
    digest = hashlib.md5(b"ACGT").hexdigest()
    assert ds.resolve_reference(embedded, "u", digest, "c") == b"ACGT"
    with pytest.raises(ValueError):
        ds.resolve_reference(embedded, "u", "0", "c")
    outside = spark.createDataFrame([("c", "acgt")], "name string, seq string")
    assert ds.resolve_reference(embedded, "x", digest, "c", outside) == b"acgt"
    with pytest.raises(LookupError):
        ds.resolve_reference(embedded, "x", digest, "z", outside)
    runs = spark.createDataFrame([("a", "spectral"), ("b", "genomic")], "run_name string, modality string")
    assert [t.count() for t in ds.split_runs(runs)] == [1, 1]
    with pytest.raises(ValueError):
        ds.split_runs(runs, runs)


def test_providers(spark, stream_tables, tmp_path):
    ids = spark.createDataFrame([("r", 1, "A", 0.5, ["x"])], "run_name string, spectrum_index long, chemical_entity string, confidence_score double, evidence_chain array<string>")
    data = Dataset({"identifications": ids, "runs": stream_tables["runs"]}, "T", ["base_v1"])
    for url in (f"sqlite://{tmp_path}/x.db", "memory://m", str(tmp_path / "p"), f"file://{tmp_path}/q"):
        providers.write_url(data, url)
        back = providers.open_url(spark, url)
        assert back.title == "T" and back.features == ["base_v1"] and back.tables["identifications"].collect() == ids.collect()
    with pytest.raises(ValueError):
        providers.provider_of("ftp://x")
    with pytest.raises(NotImplementedError):
        providers.provider_of("x", "hdf5")
    old = providers.legacy_rows(spark, '[{"run_name": "r", "spectrum_index": 3, "chemical_entity": "A", "confidence_score": 1.0, "evidence_chain": "[\\"e\\"]"}]', "identifications")
    assert old.first()["evidence_chain"] == ["e"]


def test_tdf_and_isa(spark, tmp_path, stream_tables):
    import sqlite3

    with sqlite3.connect(tmp_path / "analysis.tdf") as db:
        db.execute("create table Frames (Id integer, Time real, MsMsType integer, NumPeaks integer)")
        db.executemany("insert into Frames values (?, ?, ?, ?)", [(1, 0.5, 0, 2), (2, 1.5, 9, 1), (3, 2.5, 0, 0)])
        db.execute("create table GlobalMetadata (Key text, Value text)")
        db.execute("insert into GlobalMetadata values ('Model', 'x')")
    about = tdf.metadata(spark, str(tmp_path))
    assert (about["frames"], about["ms1"], about["ms2"], about["rt_min"], about["rt_max"], about["global"]) == (3, 2, 1, 0.5, 2.5, {"Model": "x"})
    peaks = spark.createDataFrame([(1, 1, 200.0, 5.0, 0.9), (1, 0, 300.0, 4.0, 0.8), (2, 0, 1.0, 1.0, 0.7)], "frame long, nth int, mz double, intensity double, inv_ion_mobility double")
    got = tdf.spectra(peaks, tdf.frames(spark, str(tmp_path)), "r").orderBy("spectrum_index").collect()
    assert [(r["frame"], r["mz"], r["length"], r["base_peak_intensity"], r["spectrum_index"]) for r in got] == [(1, [300.0, 200.0], 2, 5.0, 0), (3, [], 0, 0.0, 1)]
    files = isa.bundle(stream_tables["runs"], 'a "t"\tx', "INV")
    assert set(files) == {"a_run.txt", "s_study.txt", "i_investigation.txt", "investigation.json"}
    assert b'Investigation Title\t"a ""t""\tx"\n' in files["i_investigation.txt"] and json.loads(files["investigation.json"])["identifier"] == "INV"


def test_images_and_arrays(spark):
    cube = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4)
    pixels = xml.cube_pixels(spark, cube)
    xml.check_cube(pixels, 2, 3, 4)
    with pytest.raises(ValueError):
        xml.check_cube(pixels, 3, 2, 4)
    assert xml.tiled(pixels, 2).select("tile_x", "tile_y").distinct().count() == 2
    assert (xml.nd_array(xml.nd_dataset(spark, cube), cube.shape) == cube).all()
    with pytest.raises(IndexError):
        xml.nd_array(xml.nd_dataset(spark, cube), (2, 2, 4))
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>").select(xml.hyperslab(F.col("a"), 1), xml.hyperslab(F.col("a"), 0, 2), fn.axis(F.lit(1.0), F.lit(0.5), F.lit(3)), fn.merged(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))).first()
    assert list(row) == [[2.0, 3.0], [1.0, 2.0], [1.0, 1.5, 2.0], {"a": 2, "b": 3}]


def test_functions_of_text(spark):
    assert fn.canonical_json({"b": [1, None, True], "a": 0.1, "c": 'x"\n\x01é'}) == '{"a":0.10000000000000001,"b":[1,null,true],"c":"x\\"\\n\\u0001é"}'
    df = spark.createDataFrame([("12", "1.0", "[\"a\"]", "x", "carbon 13")], "a string, b string, c string, d string, e string")
    row = df.select(fn.nullish_int(F.col("a")), fn.nullish_int(F.col("b")), fn.string_list(F.col("c")), fn.string_list(F.col("d")), fn.string_map(F.col("d")), fn.yfactor_for(F.lit(12345.678)), fn.base64_zlib(fn.zlib_base64(F.col("a"))).cast("string")).first()
    assert list(row) == [12, None, ["a"], [], {}, 0.01, "12"]
    cv = spark.sql("select array(named_struct('accession', 'A', 'value', '1'), named_struct('accession', 'B', 'value', '2'), named_struct('accession', 'A', 'value', '3')) as c")
    got = cv.select(p.has_cv_param("c", "accession", "B"), F.size(p.cv_params_for("c", "accession", "A")), F.transform(p.without_cv_param(F.col("c"), F.lit("A")), lambda x: x["value"]), F.size(p.without_cv_param(F.col("c"), F.lit("Z")))).first()
    assert list(got) == [True, 2, ["2", "3"], 3]


# -- command lines --------------------------------------------------------------------------------------------------------


def test_commands(spark, tmp_path, capsys):
    at = str(tmp_path)
    (tmp_path / "k").write_text(KEY.hex())
    (tmp_path / "a.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGG\n+\n!!\n")
    run = lambda *a: main([str(x) for x in a], spark)
    assert run("fastq-import", at + "/a.fq", "--run", "g", "--out", at + "/d") == 0
    assert run("fastq-export", at + "/d", "--run", "g", "--out", at + "/q") == 0
    assert xml.joined(at + "/q") == (tmp_path / "a.fq").read_bytes()
    assert run("sign", at + "/d", "--run", "g", "--key", at + "/k", "--out", at + "/sig.json") == 0
    assert run("verify", at + "/d", "--run", "g", "--key", at + "/k", "--signatures", at + "/sig.json") == 0
    assert run("verify", at + "/d", "--run", "g", "--key", at + "/k", "--signatures", at + "/none.json") == 2
    assert run("simulate", "--out", at + "/sim", "--duration", "2", "--peaks", "5") == 0
    assert run("transport-decode", at + "/sim", "--out", at + "/t") == 0
    assert run("per-au-encrypt", at + "/t", "--key", at + "/k", "--out", at + "/enc", "--headers") == 0
    assert run("per-au-decrypt", at + "/enc", "--key", at + "/k", "--out", at + "/dec") == 0
    assert spark.read.parquet(at + "/dec").count() == 20
    capsys.readouterr()
    assert run("dump", at + "/t", "runs") == 0 and '"run_name":"simulated_run"' in capsys.readouterr().out
    with pytest.raises(protect.Unsupported):
        run("pqc")
    assert io.BytesIO
