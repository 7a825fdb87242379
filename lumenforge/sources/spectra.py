"""Readers and writers of spectra in XML: mzML, nmrML and imzML with its binary file.

A large mzML file is read by many tasks: its index, or else a scan for the elements' starts, tells where spectra begin, and
runs of them are parsed by tasks of their own. imzML is parsed once for places, and pixels read their ranges of the binary.
"""

from __future__ import annotations

import base64
import io
import re
import uuid as uuids
import zlib
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import zlib_base64
from .files import local, open_range, put

MZML = "source string, spectrum_index long, retention_time double, ms_level int, polarity int, precursor_mz double, precursor_charge int, base_peak_intensity double, mz array<double>, intensity array<double>"
CHROMATOGRAM = "source string, name string, chromatogram_type int, target_mz double, precursor_mz double, product_mz double, time array<double>, intensity array<double>"
# Accessions of the controlled vocabularies.
MS_LEVEL, POSITIVE, NEGATIVE = "MS:1000511", "MS:1000130", "MS:1000129"
SCAN_START, MINUTE, SELECTED_MZ, CHARGE = "MS:1000016", "UO:0000031", "MS:1000744", "MS:1000041"
FLOAT32, FLOAT64, INT32, INT64 = "MS:1000521", "MS:1000523", "MS:1000519", "MS:1000522"
ZLIB, MZ_ARRAY, INTENSITY_ARRAY, TIME_ARRAY = "MS:1000574", "MS:1000514", "MS:1000515", "MS:1000595"
TIC, XIC, SRM, ISOLATION_TARGET = "MS:1000235", "MS:1000627", "MS:1001473", "MS:1000827"
_DTYPE = {FLOAT32: "<f4", FLOAT64: "<f8", INT32: "<i4", INT64: "<i8"}
#: Bytes of a file that one task parses.
CHUNK = 64 << 20


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _params(element) -> dict[str, tuple[str, str]]:
    return {p.get("accession"): (p.get("value", ""), p.get("unitAccession", "")) for p in element.iter() if _tag(p) == "cvParam"}


def _arrays(element, default_length) -> dict[str | None, np.ndarray]:
    """Arrays of an element by the accession of their kind, as doubles; a length other than the one told is an error."""
    out = {}
    for node in element.iter():
        if _tag(node) != "binaryDataArray":
            continue
        p = _params(node)
        raw = base64.b64decode(next((b.text or "" for b in node if _tag(b) == "binary"), ""))
        values = np.frombuffer(zlib.decompress(raw) if ZLIB in p and raw else raw, next((d for a, d in _DTYPE.items() if a in p), "<f8")).astype(np.float64)
        told = node.get("arrayLength", default_length)
        if told is not None and len(values) != int(told):
            raise ValueError(f"{element.get('id')}: an array of {len(values)} values, not {told}")
        kind = next((a for a in (MZ_ARRAY, INTENSITY_ARRAY, TIME_ARRAY) if a in p), None)
        if kind == TIME_ARRAY and p[TIME_ARRAY][1] == MINUTE:
            values = values * 60
        out[kind] = values
    return out


def _spectrum(element) -> tuple | None:
    """A row of one spectrum; None unless it has m/z and intensity arrays of one length."""
    own, arrays = _params(element), _arrays(element, element.get("defaultArrayLength"))
    mz, intensity = arrays.get(MZ_ARRAY), arrays.get(INTENSITY_ARRAY)
    if mz is None or intensity is None or len(mz) != len(intensity):
        return None
    start, unit = own.get(SCAN_START, ("0", ""))
    sign = 1 if POSITIVE in own else -1 if NEGATIVE in own else 0
    value = lambda a: own.get(a, ("0", ""))[0] or "0"
    return float(start or 0) * (60 if unit == MINUTE else 1), int(own.get(MS_LEVEL, ("1", ""))[0] or 1), sign, float(value(SELECTED_MZ)), int(float(value(CHARGE))), float(intensity.max(initial=0.0)), mz.tolist(), intensity.tolist()


def _chromatogram(element) -> tuple | None:
    own, arrays = _params(element), _arrays(element, element.get("defaultArrayLength"))
    time, intensity = arrays.get(TIME_ARRAY), arrays.get(INTENSITY_ARRAY)
    if time is None or intensity is None or len(time) != len(intensity):
        return None
    kind = 2 if SRM in own else 1 if XIC in own else 0
    target = lambda name: next((float(_params(e).get(ISOLATION_TARGET, ("0", ""))[0] or 0) for e in element.iter() if _tag(e) == name), 0.0)
    precursor = target("precursor")
    return element.get("id", ""), kind, precursor if kind == 1 else 0.0, precursor, target("product"), time.tolist(), intensity.tolist()


def _pieces(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """source, first, start, size: runs of whole elements of a file, CHUNK bytes or so each, and the number of elements before.
    The file is scanned for the elements' starts a few MB at a time; nothing is parsed."""
    mark = re.compile(rb"<(?:\w+:)?%s[\s>]" % tag.encode())

    def scan(batches):
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                starts, at, tail = [], 0, b""
                with open_range(name) as f:
                    while block := f.read(4 << 20):
                        data = tail + block
                        starts += [at - len(tail) + m.start() for m in mark.finditer(data) if m.end() <= len(data)]
                        at += len(block)
                        tail = data[-64:]
                starts = sorted(set(starts))
                if not starts:
                    continue
                cut = [0]
                for i, s in enumerate(starts):
                    if s - starts[cut[-1]] >= CHUNK:
                        cut.append(i)
                ends = [starts[i] for i in cut[1:]] + [size]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut)), pa.array(cut, pa.int64()), pa.array([starts[i] for i in cut], pa.int64()), pa.array([e - starts[i] for i, e in zip(cut, ends)], pa.int64())], ["source", "first", "start", "size"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(scan, "source string, first long, start long, size long").repartition("source", "start")


def _elements(raw: bytes, tag: str):
    """The elements of a kind in a piece of XML that begins with one."""
    end = raw.rfind(f"</{tag}>".encode())
    prefix = re.match(rb"<(\w+:)?", raw)[1] or b""
    if prefix:
        end = raw.rfind(b"</" + prefix + tag.encode() + b">")
    raw = raw[: end + len(prefix) + len(tag) + 3]
    space = b' xmlns:%s="p"' % prefix[:-1] if prefix else b""
    for _, element in ElementTree.iterparse(io.BytesIO(b"<all%s>" % space + raw + b"</all>")):
        if _tag(element) == tag:
            yield element
            element.clear()


def _parse(pieces: DataFrame, tag: str, one, schema: str, types: list, indexed: bool) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches):
        for b in batches:
            for name, first, start, size in zip(*(c.to_pylist() for c in b.columns)):
                with open_range(name) as f:
                    f.seek(start)
                    raw = f.read(size)
                rows = []
                for i, element in enumerate(_elements(raw, tag)):
                    if found := one(element):
                        rows.append((name, first + i, *found) if indexed else (name, *found))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return pieces.mapInArrow(parse, schema)


_NUMBERS = pa.list_(pa.float64())


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of mzML files, numbered from 0 in each file without those that lack an array. Files without any spectrum at all
    are an error."""
    from ..operators.index import reindexed

    types = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), _NUMBERS, _NUMBERS]
    pieces = _pieces(spark, path, "spectrum")
    if pieces.isEmpty():
        raise ValueError(f"{path} has no spectrum")
    found = _parse(pieces, "spectrum", _spectrum, MZML, types, True)
    return reindexed(found, "source", "spectrum_index")


def read_chromatograms(spark: SparkSession, path: str) -> DataFrame:
    """Chromatograms of mzML files; times in seconds; windows of products as m/z alone."""
    types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), _NUMBERS, _NUMBERS]
    return _parse(_pieces(spark, path, "chromatogram"), "chromatogram", _chromatogram, CHROMATOGRAM, types, False)


# -- mzML out -------------------------------------------------------------------------------------------------------------

_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<indexedmzML xmlns="http://psi.hupo.org/ms/mzml">
  <mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0">
    <cvList count="2">
      <cv id="MS" fullName="Proteomics Standards Initiative Mass Spectrometry Ontology" URI="https://raw.githubusercontent.com/HUPO-PSI/psi-ms-CV/master/psi-ms.obo"/>
      <cv id="UO" fullName="Unit Ontology" URI="http://ontologies.berkeleybop.org/uo.obo"/>
    </cvList>
    <fileDescription><fileContent><cvParam cvRef="MS" accession="MS:1000580" name="MSn spectrum" value=""/></fileContent></fileDescription>
    <softwareList count="1"><software id="lumenforge" version="0.1"><cvParam cvRef="MS" accession="MS:1000799" name="custom unreleased software tool" value="lumenforge"/></software></softwareList>
    <instrumentConfigurationList count="1"><instrumentConfiguration id="IC1"><cvParam cvRef="MS" accession="MS:1000031" name="instrument model" value=""/></instrumentConfiguration></instrumentConfigurationList>
    <dataProcessingList count="1"><dataProcessing id="dp"><processingMethod order="0" softwareRef="lumenforge"><cvParam cvRef="MS" accession="MS:1000544" name="Conversion to mzML" value=""/></processingMethod></dataProcessing></dataProcessingList>
"""


def _cv(accession: str, name: str, value: Column | str = "", unit: str = "", cv: str = "MS") -> Column:
    return F.concat(F.lit(f'<cvParam cvRef="{cv}" accession="{accession}" name="{name}" value="'), value if isinstance(value, Column) else F.lit(value), F.lit('"' + unit + "/>"))


def _binary(column: str, accession: str, name: str, compress: bool, unit: str = "") -> Column:
    encoded = F.col(f"_{column}")
    squeezed = _cv(ZLIB, "zlib compression") if compress else _cv("MS:1000576", "no compression")
    return F.concat(F.lit('<binaryDataArray encodedLength="'), F.length(encoded).cast("string"), F.lit('">'), _cv(FLOAT64, "64-bit float"), squeezed, _cv(accession, name, "", unit), F.lit("<binary>"), encoded, F.lit("</binary></binaryDataArray>"))


def mzml_fragments(spectra: DataFrame, compress: bool = False) -> DataFrame:
    """spectrum_index, id and xml of each spectrum of one run; numbers as Java writes them, which reads back to the same ones."""
    from ..functions.protect import packed_doubles

    df = spectra
    for c in ("mz", "intensity"):
        df = packed_doubles(df.withColumn(c, F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>"))), c, f"_r{c}").withColumn(f"_{c}", zlib_base64(F.col(f"_r{c}"), compress))
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    sign = F.when(F.col("polarity") == 1, _cv(POSITIVE, "positive scan")).when(F.col("polarity") == -1, _cv(NEGATIVE, "negative scan")).otherwise("")
    scan = F.concat(F.lit('<scanList count="1">'), _cv("MS:1000795", "no combination"), F.lit("<scan>"), _cv(SCAN_START, "scan start time", text("retention_time"), ' unitCvRef="UO" unitAccession="UO:0000010" unitName="second"'), F.lit("</scan></scanList>"))
    charge = F.when(F.col("precursor_charge") != 0, _cv(CHARGE, "charge state", text("precursor_charge"))).otherwise("")
    precursor = F.when((F.col("ms_level") > 1) & (F.col("precursor_mz") > 0), F.concat(F.lit('<precursorList count="1"><precursor><selectedIonList count="1"><selectedIon>'), _cv(SELECTED_MZ, "selected ion m/z", text("precursor_mz")), charge, F.lit('</selectedIon></selectedIonList><activation><cvParam cvRef="MS" accession="MS:1000133" name="collision-induced dissociation" value=""/></activation></precursor></precursorList>'))).otherwise("")
    name = F.concat(F.lit("scan="), (F.col("spectrum_index") + 1).cast("string"))
    xml = F.concat(F.lit('<spectrum index="'), text("spectrum_index"), F.lit('" id="'), name, F.lit('" defaultArrayLength="'), F.size("mz").cast("string"), F.lit('">'), _cv("MS:1000580", "MSn spectrum"), _cv(MS_LEVEL, "ms level", text("ms_level")), sign, scan, precursor, F.lit('<binaryDataArrayList count="2">'), _binary("mz", MZ_ARRAY, "m/z array", compress), _binary("intensity", INTENSITY_ARRAY, "intensity array", compress), F.lit("</binaryDataArrayList></spectrum>\n"))
    return df.select("spectrum_index", name.alias("id"), xml.alias("xml"))


def write_mzml(spectra: DataFrame, path: str, run_name: str, compress: bool = False) -> None:
    """An indexed mzML file of one run, below a folder as parts that follow each other by name: one with what comes before, one
    for each partition of spectra in order, one with the index. Byte places are running sums; a run isn't gathered anywhere.
    """
    from ..operators.index import running_bytes
    from .files import write_parts

    n = spectra.count()
    head = (_HEAD + f"    <run id={quoteattr(run_name)} defaultInstrumentConfigurationRef=\"IC1\">\n      <spectrumList count=\"{n}\" defaultDataProcessingRef=\"dp\">\n").encode()
    rows = mzml_fragments(spectra, compress).withColumn("_all", F.lit(0))
    write_parts(rows.orderBy("spectrum_index").select(F.col("xml").cast("binary")), f"{path}/1-spectra", "xml")
    placed = running_bytes(rows.withColumn("n", F.octet_length("xml").cast("long")).drop("xml"), ["_all"], "spectrum_index", F.col("n"), "at")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("xml").cast("long")), F.lit(0))).first()[0]
    put(f"{path}/0-head.xml", head)
    close = b"      </spectrumList>\n    </run>\n  </mzML>\n"
    listed = len(head) + total + len(close) + 2
    index = placed.select("spectrum_index", F.concat(F.lit('<offset idRef="'), "id", F.lit('">'), (F.col("at") + len(head)).cast("string"), F.lit("</offset>\n")).alias("x")).orderBy("spectrum_index").select(F.col("x").cast("binary"))
    put(f"{path}/2-close.xml", close + b'  <indexList count="1"><index name="spectrum">\n')
    write_parts(index, f"{path}/3-index", "xml")
    put(f"{path}/4-end.xml", f"</index></indexList>\n<indexListOffset>{listed}</indexListOffset>\n</indexedmzML>\n".encode())


def joined(path: str) -> bytes:
    """The bytes of a file that was written in parts on this machine's file system."""
    import glob
    import os

    here = local(path)
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{here}/**/*", recursive=True)) if os.path.isfile(f))


# -- nmrML ----------------------------------------------------------------------------------------------------------------

NMRML = "source string, spectrum_index long, nucleus_type string, spectrometer_frequency_mhz double, sweep_width_ppm double, dwell_time_seconds double, number_of_scans int, chemical_shift array<double>, intensity array<double>"
# Accessions of an acquisition's parameters.
NMR_FREQUENCY, NMR_NUCLEUS, NMR_SCANS, NMR_DWELL, NMR_SWEEP = "NMR:1000001", "NMR:1000002", "NMR:1000003", "NMR:1000004", "NMR:1400014"
NUCLEI = (("hydrogen", "1H"), ("proton", "1H"), ("carbon", "13C"), ("nitrogen", "15N"), ("phosphorus", "31P"))


def nucleus_of(name: str) -> str:
    return next((v for k, v in NUCLEI if k in name.lower()), name)


def _real(text: str | None) -> float:
    try:
        return float(text or 0)
    except ValueError:
        return 0.0


def parse_nmrml(raw: bytes) -> tuple[dict, list[tuple[np.ndarray, np.ndarray]]]:
    """Parameters of the acquisition, and x and y of each one-dimensional spectrum. Its array holds x and y in turns if it has
    twice as many values as there are points, or is even and no number of points is told; else y alone, against 0, 1, 2 ...
    Arrays below axes are these axes. Raw free induction decays are passed over."""
    about, out = {"nucleus_type": "", "spectrometer_frequency_mhz": 0.0, "sweep_width_ppm": 0.0, "dwell_time_seconds": 0.0, "number_of_scans": 0}, []
    for element in ElementTree.fromstring(raw).iter():
        tag = _tag(element)
        if tag == "acquisitionParameterSet":
            about["number_of_scans"] = int(_real(element.get("numberOfScans"))) or about["number_of_scans"]
            for p in element.iter():
                kind, value = _tag(p), p.get("value", "")
                if kind == "acquisitionNucleus" and p.get("name"):
                    about["nucleus_type"] = nucleus_of(p.get("name"))
                elif kind == "irradiationFrequency" and _real(value) > 0:
                    about["spectrometer_frequency_mhz"] = _real(value) / 1e6
                elif kind == "sweepWidth":
                    about["sweep_width_ppm"] = _real(value)
                elif kind == "cvParam":
                    accession = p.get("accession")
                    if accession == NMR_FREQUENCY:
                        about["spectrometer_frequency_mhz"] = _real(value)
                    elif accession == NMR_NUCLEUS:
                        about["nucleus_type"] = value or about["nucleus_type"]
                    elif accession == NMR_SCANS:
                        about["number_of_scans"] = int(_real(value))
                    elif accession == NMR_DWELL:
                        about["dwell_time_seconds"] = _real(value)
                    elif accession == NMR_SWEEP:
                        about["sweep_width_ppm"] = _real(value)
        elif tag == "spectrum1D":
            x = y = None
            points = int(_real(element.get("numberOfDataPoints")))
            parents = {c: p for p in element.iter() for c in p}
            for a in element.iter():
                if _tag(a) != "spectrumDataArray":
                    continue
                data = base64.b64decode(a.text or "")
                v = np.frombuffer(zlib.decompress(data) if a.get("compressed", "") in ("true", "zlib") and data else data, "<f8")
                above = _tag(parents.get(a, element))
                if above == "xAxis":
                    x = v
                elif above == "yAxis":
                    y = v
                elif len(v) and len(v) % 2 == 0 and not (points > 0 and len(v) == points):
                    x, y = v[0::2], v[1::2]
                else:
                    x, y = np.arange(len(v), dtype=float), v
            if x is not None and y is not None and len(x) == len(y):
                out.append((x, y))
    return about, out


def read_nmrml(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of nmrML files, which are small: one experiment each. A file without a processed spectrum gives no rows."""
    names = [x.split()[0] for x in NMRML.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), _NUMBERS, _NUMBERS]

    def parse(batches):
        for b in batches:
            rows = []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, spectra = parse_nmrml(raw)
                rows += [(name, i, a["nucleus_type"], a["spectrometer_frequency_mhz"], a["sweep_width_ppm"], a["dwell_time_seconds"], a["number_of_scans"], x.tolist(), y.tolist()) for i, (x, y) in enumerate(spectra)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, NMRML)


def nmrml_bytes(x, y, nucleus: str = "", frequency_mhz: float = 0.0, sweep_width_ppm: float = 0.0, fid=None) -> bytes:
    """A file of one spectrum, with x and y in turns, and of its free induction decay if there is one."""
    x, y = np.asarray(x, "<f8"), np.asarray(y, "<f8")
    if x.shape != y.shape:
        raise ValueError("x and y of different lengths")
    packed = base64.b64encode(np.stack([x, y], axis=1).tobytes()).decode()
    decay = "" if fid is None else f'      <fidData compressed="false" byteFormat="Complex128" encodedLength="0">{base64.b64encode(np.asarray(fid, "<c16").tobytes()).decode()}</fidData>\n'
    sweep = f'        <sweepWidth value="{sweep_width_ppm!r}" unitName="ppm"/>\n' if sweep_width_ppm else ""
    hertz = f'        <irradiationFrequency value="{frequency_mhz * 1e6!r}" unitName="hertz"/>\n' if frequency_mhz else ""
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<nmrML xmlns="http://nmrml.org/schema" version="1.1.0">\n'
        '  <cvList><cv id="nmrCV" fullName="nmrML Controlled Vocabulary" version="1.1.0" URI="http://nmrml.org/cv/v1.1.0/nmrCV.owl"/></cvList>\n'
        '  <acquisition><acquisition1D>\n      <acquisitionParameterSet numberOfScans="1" numberOfSteadyStateScans="0"><DirectDimensionParameterSet>\n'
        f"        <acquisitionNucleus name={quoteattr(nucleus)}/>\n{hertz}{sweep}      </DirectDimensionParameterSet></acquisitionParameterSet>\n{decay}  </acquisition1D></acquisition>\n"
        f'  <spectrumList><spectrum1D id="s1" numberOfDataPoints="{len(x)}"><spectrumDataArray compressed="false" byteFormat="Complex128" encodedLength="{len(packed)}">{packed}</spectrumDataArray></spectrum1D></spectrumList>\n</nmrML>\n'
    ).encode()


def nmrml_files(spectra: DataFrame) -> DataFrame:
    """source and content: a file for each row with chemical_shift, intensity, nucleus_type and spectrometer_frequency_mhz."""

    def make(batches):
        for b in batches:
            rows = b.to_pylist()
            made = [nmrml_bytes(r["chemical_shift"], r["intensity"], r["nucleus_type"] or "", r["spectrometer_frequency_mhz"] or 0.0) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["source"] for r in rows], pa.string()), pa.array(made, pa.binary())], ["source", "content"])

    return spectra.select("source", "chemical_shift", "intensity", "nucleus_type", "spectrometer_frequency_mhz").mapInArrow(make, "source string, content binary")


# -- imzML ----------------------------------------------------------------------------------------------------------------

# Accessions of images.
CONTINUOUS, PROCESSED, IBD_UUID, IBD_SHA1 = "IMS:1000030", "IMS:1000031", "IMS:1000080", "IMS:1000091"
COUNT_X, COUNT_Y, SIZE_X, SIZE_Y, POSITION = "IMS:1000042", "IMS:1000043", "IMS:1000046", "IMS:1000047", ("IMS:1000050", "IMS:1000051", "IMS:1000052")
OFFSET, LENGTH, ENCODED = "IMS:1000102", "IMS:1000103", "IMS:1000104"
#: Older accessions of the grid's extent.
OLD_COUNT = {"IMS:1000003": 0, "IMS:1000004": 1, "IMS:1000005": 2}


def _plain_uuid(text: str) -> str:
    return re.sub(r"[^0-9a-f]", "", text.lower())


def parse_imzml(stream) -> tuple[dict, list[tuple]]:
    """What the file says of the image, and of each pixel its place, and offset, length and type of both its arrays."""
    about, pixels = {"mode": "", "uuid": "", "grid": [0, 0, 1], "pixel_size": [0.0, 0.0], "scan_pattern": ""}, []
    settings = False
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        tag = _tag(element)
        if event == "start":
            settings = settings or tag == "scanSettings"
            continue
        if tag == "cvParam":
            a, v = element.get("accession", ""), element.get("value", "")
            if a in (CONTINUOUS, PROCESSED):
                about["mode"] = "continuous" if a == CONTINUOUS else "processed"
            elif a == IBD_UUID and v:
                about["uuid"] = _plain_uuid(v)
            elif a == COUNT_X and v and settings:
                about["grid"][0] = int(v)
            elif a == COUNT_X and v and not about["uuid"] and len(_plain_uuid(v)) == 32:
                about["uuid"] = _plain_uuid(v)  # older files
            elif a == COUNT_Y and v:
                about["grid"][1] = int(v)
            elif a in OLD_COUNT and v:
                about["grid"][OLD_COUNT[a]] = int(v)
            elif a in (SIZE_X, SIZE_Y) and v:
                about["pixel_size"][a == SIZE_Y] = float(v)
            elif a in ("IMS:1000040", "IMS:1000048") and v:
                about["scan_pattern"] = about["scan_pattern"] or v
        elif tag == "scanSettings":
            settings = False
        elif tag == "spectrum":
            place, arrays = [0, 0, 1], {}
            for e in element.iter():
                if _tag(e) == "scan":
                    p = _params(e)
                    place = [int(p[a][0]) if p.get(a, ("",))[0] else d for a, d in zip(POSITION, place)]
                elif _tag(e) == "binaryDataArray":
                    p = _params(e)
                    arrays[MZ_ARRAY if MZ_ARRAY in p else INTENSITY_ARRAY] = (int(p.get(OFFSET, ("-1",))[0]), int(p.get(LENGTH, ("0",))[0]), 4 if FLOAT32 in p else 8)
            none = (-1, 0, 8)
            pixels.append((*place, *arrays.get(MZ_ARRAY, none), *arrays.get(INTENSITY_ARRAY, none)))
            element.clear()
    if not about["mode"] or not about["uuid"] or not pixels:
        raise ValueError("an imzML file without mode, UUID or spectra")
    return about, pixels


PIXEL = "pixel long, x int, y int, z int, mz array<double>, intensity array<double>"


def read_imzml(spark: SparkSession, imzml: str, ibd: str | None = None) -> tuple[DataFrame, dict]:
    """Pixels of an image, and what the file says of it. The XML is read once, by the driver as a stream, for places; tasks then
    read their pixels' ranges of the binary. A UUID other than the binary's own, or ranges beyond its end, are an error."""
    ibd = ibd or re.sub(r"\.[^./]*$", "", imzml) + ".ibd"
    with open_range(imzml) as f:
        about, pixels = parse_imzml(f)
    with open_range(ibd) as f:
        if f.read(16).hex() != about["uuid"]:
            raise ValueError("the binary has another UUID")
        f.seek(0, 2)
        size = f.tell()
    for p in pixels:
        if any(o < 0 or n < 0 or o + n * w > size for o, n, w in (p[3:6], p[6:9])):
            raise ValueError(f"pixel {p[:3]}: a range outside the binary")
    fields = "pixel long, x int, y int, z int, mo long, mn long, mw long, io long, inn long, iw long"
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(pixels)], fields).repartitionByRange(max(1, min(200, len(pixels) // 256)), "io")

    def load(batches):
        with open_range(ibd) as f:
            axis = (None, None)

            def take(o, n, w):
                f.seek(o)
                return np.frombuffer(f.read(n * w), f"<f{w}").astype(float)

            for b in batches:
                rows = []
                for i, x, y, z, mo, mn, mw, io_, inn, iw in zip(*(c.to_pylist() for c in b.columns)):
                    if axis[0] != (mo, mn, mw):
                        axis = ((mo, mn, mw), take(mo, mn, mw))
                    rows.append((i, x, y, z, axis[1], take(io_, inn, iw)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int32(), pa.int32(), _NUMBERS, _NUMBERS])], [x.split()[0] for x in PIXEL.split(", ")])

    return places.sortWithinPartitions("io").mapInArrow(load, PIXEL), about


def write_imzml(pixels: DataFrame, path: str, mode: str = "continuous", grid: tuple[int, int, int] = (0, 0, 0), pixel_size: tuple[float, float] = (0.0, 0.0), scan_pattern: str = "flyback", uuid: str | None = None) -> dict:
    """path.imzML and path.ibd of pixels (x, y, z, mz, intensity), in order of z, y and x. Continuous: all pixels share one
    m/z axis, else it is an error; extents that are 0 are the greatest places. The binary streams through the driver once, for
    its digest has no parts; so does the XML."""
    import hashlib
    import os

    if mode not in ("continuous", "processed"):
        raise ValueError(f"no mode {mode!r}")
    uuid = _plain_uuid(uuid) if uuid else uuids.uuid4().hex
    if len(uuid) != 32:
        raise ValueError("a UUID of 32 hex digits is needed")
    if pixels.isEmpty():
        raise ValueError("one pixel at least is needed")
    if mode == "continuous" and pixels.select(F.xxhash64("mz").alias("h"), F.size("mz").alias("n")).distinct().limit(2).count() > 1:
        raise ValueError("the pixels of a continuous image share one m/z axis")
    if not pixels.where(F.size("mz") != F.size("intensity")).isEmpty():
        raise ValueError("m/z and intensity of different lengths")
    top = pixels.agg(F.max("x"), F.max("y"), F.max("z")).first()
    grid = tuple(g or int(t or 1) for g, t in zip(grid, top))
    digest, at, axis, spectra, n = hashlib.sha1(), 16, None, io.StringIO(), 0
    here = local(path)
    if here is None:
        raise ValueError("imzML is written to a mounted folder")
    os.makedirs(os.path.dirname(here) or ".", exist_ok=True)
    with open(here + ".ibd", "wb") as out:
        def add(raw: bytes) -> int:
            nonlocal at
            out.write(raw)
            digest.update(raw)
            at += len(raw)
            return at - len(raw)

        out.write(bytes.fromhex(uuid))
        digest.update(bytes.fromhex(uuid))
        for r in pixels.select("x", "y", "z", "mz", "intensity").orderBy("z", "y", "x").toLocalIterator():
            mz, intensity = np.asarray(r["mz"], "<f8"), np.asarray(r["intensity"], "<f8")
            if mode == "processed" or axis is None:
                axis = add(mz.tobytes())
            places = ((MZ_ARRAY, "m/z array", axis), (INTENSITY_ARRAY, "intensity array", add(intensity.tobytes())))
            arrays = "".join(f'<binaryDataArray encodedLength="0"><cvParam cvRef="MS" accession="{a}" name="{name}" value=""/><cvParam cvRef="MS" accession="{FLOAT64}" name="64-bit float" value=""/><cvParam cvRef="IMS" accession="{OFFSET}" name="external offset" value="{o}"/><cvParam cvRef="IMS" accession="{LENGTH}" name="external array length" value="{len(mz)}"/><cvParam cvRef="IMS" accession="{ENCODED}" name="external encoded length" value="{8 * len(mz)}"/><binary/></binaryDataArray>' for a, name, o in places)
            where = "".join(f'<cvParam cvRef="IMS" accession="{a}" name="position {c}" value="{r[c]}"/>' for a, c in zip(POSITION, "xyz"))
            spectra.write(f'      <spectrum id="px={n}" index="{n}" defaultArrayLength="{len(mz)}"><scanList count="1"><scan>{where}</scan></scanList><binaryDataArrayList count="2">{arrays}</binaryDataArrayList></spectrum>\n')
            n += 1
    kind = (CONTINUOUS, "continuous") if mode == "continuous" else (PROCESSED, "processed")
    cv = lambda a, name, v: f'<cvParam cvRef="IMS" accession="{a}" name="{name}" value="{v}"/>'
    with open(here + ".imzML", "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0">\n  <fileDescription><fileContent>')
        out.write(cv(kind[0], kind[1], "") + cv(IBD_UUID, "universally unique identifier", uuid) + cv(IBD_SHA1, "ibd SHA-1", digest.hexdigest()) + "</fileContent></fileDescription>\n")
        out.write('  <scanSettingsList count="1"><scanSettings id="s1">' + cv(COUNT_X, "max count of pixels x", grid[0]) + cv(COUNT_Y, "max count of pixels y", grid[1]) + cv("IMS:1000005", "max count of pixels z", grid[2]) + cv(SIZE_X, "pixel size x", pixel_size[0]) + cv(SIZE_Y, "pixel size y", pixel_size[1]) + cv("IMS:1000040", "scan pattern", scan_pattern) + "</scanSettings></scanSettingsList>\n")
        out.write(f'  <run id="imzml"><spectrumList count="{n}">\n{spectra.getvalue()}  </spectrumList></run>\n</mzML>\n')
    return {"uuid": uuid, "sha1": digest.hexdigest(), "mode": mode, "pixels": n, "grid": list(grid)}


# -- images ---------------------------------------------------------------------------------------------------------------


def cube_pixels(spark: SparkSession, cube: np.ndarray, image: str = "image") -> DataFrame:
    """Pixels (image_id, x, y, z, intensity; places from 0) of an image cube of height, width and spectral points."""
    if cube.ndim != 3:
        raise ValueError("a cube has three dimensions")
    h, w, _ = cube.shape
    return spark.createDataFrame([(image, x, y, 0, cube[y, x].astype(float).tolist()) for y in range(h) for x in range(w)], "image_id string, x int, y int, z int, intensity array<double>")


def tiled(pixels: DataFrame, tile: int = 32) -> DataFrame:
    """pixels with the tile they lie in, to be written by tile."""
    return pixels.withColumns({"tile_y": F.floor(F.col("y") / tile).cast("int"), "tile_x": F.floor(F.col("x") / tile).cast("int")})


def check_cube(pixels: DataFrame, height: int, width: int, points: int) -> None:
    """ValueError unless there is one pixel of so many points at each place."""
    row = pixels.agg(F.count("*"), F.countDistinct("x", "y"), F.min(F.size("intensity")), F.max(F.size("intensity")), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if tuple(row) != (height * width, height * width, points, points, 0, width - 1, 0, height - 1):
        raise ValueError(f"no cube of {height} x {width} x {points}: {tuple(row)}")


def nd_dataset(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """Coordinates and values of an array of any rank, as rows (index array<long>, value)."""
    flat = np.ascontiguousarray(values)
    places = np.indices(flat.shape).reshape(flat.ndim, -1).T
    return spark.createDataFrame([(p.tolist(), float(v)) for p, v in zip(places, flat.ravel())], "index array<long>, value double")


def nd_array(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The array again; places that lack a row are 0, and a place outside the shape is an error."""
    out = np.zeros(shape)
    for r in rows.toLocalIterator():
        if any(not 0 <= i < n for i, n in zip(r["index"], shape)) or len(r["index"]) != len(shape):
            raise IndexError(r["index"])
        out[tuple(r["index"])] = r["value"]
    return out


def hyperslab(channel: Column, offset: Column | int, count: Column | int = -1) -> Column:
    """count values of an array from offset on; -1 for all that are left."""
    o = offset if isinstance(offset, Column) else F.lit(offset)
    n = count if isinstance(count, Column) else F.lit(count)
    return F.slice(channel, o + 1, F.when(n < 0, F.greatest(F.size(channel) - o, F.lit(0))).otherwise(n))

