"""JCAMP-DX files of vibrational and UV/visible spectra: all ASCII forms read, AFFN, PAC, SQZ and DIF written. Many spectra
go into compound files, whose blocks tasks read by byte ranges."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import open_range, write_parts

# Pseudo-digits of squeezed numbers, differences and repeats.
SQUEEZED = {c: str(i) for i, c in enumerate("@ABCDEFGHI")} | {c: f"-{i + 1}" for i, c in enumerate("abcdefghi")}
DIFFERENCE = {c: str(i) for i, c in enumerate("%JKLMNOPQR")} | {c: f"-{i + 1}" for i, c in enumerate("jklmnopqr")}
REPEAT = {c: i + 1 for i, c in enumerate("STUVWXYZs")}
#: Ordinates of a written line; how near a check value has to be.
PER_LINE, NEAR = 10, 1e-9
#: Bytes of a file that one task reads; characters of a document of linked blocks; rows handed on at once.
CHUNK, LINKED, AT_ONCE = 8 << 20, 1 << 20, 256
_TOKEN = re.compile(r"([@A-Ia-i])([\d.]*)|([%J-Rj-r])([\d.]*)|([S-Zs])(\d*)|([+-]?(?:\d+\.?\d*|\.\d+)(?:[Ee][+-]?\d+)?)")
_TITLE, _LINK = re.compile(rb"##[ \t]*TITLE[ \t]*=", re.I), re.compile(r"^##[ \t]*DATA TYPE[ \t]*=[ \t]*LINK[ \t]*(?:\$\$|$)", re.I | re.M)
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[Ee][+-]?\d+)?|\?|(?<!\w)[+-]?(?:nan|inf)(?!\w)")
# Lines of whole differences as they are written here, and what makes plain numbers of them.
_PLAIN = re.compile(r"(?:[+-]?[\d.]+ [@A-Ia-i]\d{0,16}(?: [%J-Rj-r]\d{0,16})*\n)+")
_ANCHOR = re.compile(r"^\S+ ", re.M)
_MINUS = [(c, d) for c, d in (SQUEEZED | DIFFERENCE).items() if d[0] == "-"]
_PLUS = str.maketrans({c: d for c, d in (SQUEEZED | DIFFERENCE).items() if d[0] != "-"})

RECORD = "source string, modality string, title string, mode string, x array<double>, y array<double>, excitation_wavelength_nm double, laser_power_mw double, integration_time_sec double, resolution_cm_inv double, number_of_scans int, path_length_cm double, solvent string"


def decode_line(line: str, last: float | None) -> list[float]:
    """Ordinates of one line, whose first number is its X. A difference starts from the line's value before it, else from the
    last one of the line before; a repeat gives the value before it again; a first value that equals the last one of the
    line before is its check and is left out."""
    out, now = [], None
    for m in list(_TOKEN.finditer(line))[1:]:
        if m[3]:
            base = last if now is None else now
            if base is None:
                raise ValueError("a difference without a value before it")
            now = base + float(DIFFERENCE[m[3]] + m[4])
            out.append(now)
        elif m[5]:
            if now is None:
                raise ValueError("a repeat without a value before it")
            out += [now] * (int(f"{REPEAT[m[5]]}{m[6]}") - 1)
        else:
            now = float(SQUEEZED[m[1]] + m[2]) if m[1] else float(m[7])
            out.append(now)
    return out[1:] if out and last is not None and abs(out[0] - last) < NEAR else out


def _decode_plain(lines: list[str]) -> list[float] | None:
    """What decode_line gives of lines of whole differences, all at once; None for any others, and beyond 53 binary digits."""
    text = "\n".join(lines) + "\n"
    if not _PLAIN.fullmatch(text):
        return None
    text = _ANCHOR.sub("", text)
    for c, d in _MINUS:
        text = text.replace(c, d)
    numbers = np.fromstring(text.translate(_PLUS), np.int64, sep=" ")
    counts = np.array([line.count(" ") for line in lines])
    first = np.cumsum(counts) - counts
    if counts.max() > 90:  # beyond, sums of 17 digits may leave a long; over lines they may, as only their differences count
        return None
    sums = np.cumsum(numbers)
    values = sums - np.repeat(sums[first] - numbers[first], counts)
    if np.abs(values).max() > 1 << 53:
        return None
    kept = np.ones(len(values), bool)
    kept[first[1:]] = values[first[1:]] != values[first[1:] - 1]
    return values[kept].astype(float).tolist()


def decode_ordinates(lines) -> list[float]:
    lines = list(lines)
    if lines and (plain := _decode_plain(lines)) is not None:
        return plain
    out: list[float] = []
    for line in lines:
        line = line.split("$$", 1)[0].strip()
        if line:
            out += decode_line(line, out[-1] if out else None)
    return out


def labelled(text: str) -> tuple[dict[str, str], list[str]]:
    """Labelled records by name, and the lines of the data block."""
    head, body, inside = {}, [], False
    for line in text.splitlines():
        if line.startswith("##"):
            label, _, value = line[2:].partition("=")
            label = label.strip().upper()
            inside = label in ("XYDATA", "XYPOINTS", "PEAK TABLE")
            head[label] = value.split("$$", 1)[0].strip()
            if label == "END":
                break
        elif inside:
            body.append(line)
    return head, body


def _pairs(body: list[str]) -> list[float | None]:
    """Numbers of a block of pairs; a question mark is a value that isn't known."""
    found = _NUMBER.findall("\n".join(x.split("$$", 1)[0] for x in body))
    return [None if v == "?" else float(v) for v in found]


def decode_jcamp(text: str) -> tuple[dict[str, str], list[float], list[float]]:
    """Labelled records, x and y of an (X++(Y..Y)) block in any of the ASCII forms, or of (XY..XY) pairs."""
    head, body = labelled(text)
    number = lambda k, d: float(head.get(k) or d)
    xf, yf = number("XFACTOR", 1), number("YFACTOR", 1)
    if "XYDATA" not in head:
        flat = _pairs(body)
        if len(flat) % 2:
            raise ValueError("a pair is cut short")
        x, y = [v * xf for v in flat[::2]], [None if v is None else v * yf for v in flat[1::2]]
    elif "XY..XY" in head["XYDATA"].replace(" ", "").upper():
        flat = _pairs(body)
        x, y = [v * xf for v in flat[::2]], [None if v is None else v * yf for v in flat[1::2]]
    else:
        raw = decode_ordinates(body)
        n, first = int(number("NPOINTS", len(raw))), number("FIRSTX", 0)
        if len(raw) != n:
            raise ValueError(f"{len(raw)} of {n} points")
        step = number("DELTAX", 0) if head.get("DELTAX") else (number("LASTX", first) - first) / max(1, n - 1)
        x, y = [(first + i * step) * xf for i in range(n)], [v * yf for v in raw]
    if len(x) != len(y) or not x and number("NPOINTS", 1) != 0:
        raise ValueError("no data, or x and y of different lengths")
    return head, x, y


def spectrum_row(source: str, text: str) -> tuple:
    """A row of RECORD; a type of data that isn't known is an error."""
    head, x, y = decode_jcamp(text)
    kind, number = head.get("DATA TYPE", "").upper(), lambda k: float(head.get(k) or 0)
    if kind == "RAMAN SPECTRUM":
        about = ("raman", None, number("$EXCITATION WAVELENGTH NM"), number("$LASER POWER MW"), number("$INTEGRATION TIME SEC"), None, None, None, None)
    elif kind in ("INFRARED ABSORBANCE", "INFRARED TRANSMITTANCE", "INFRARED SPECTRUM"):
        absorbs = kind.endswith("ABSORBANCE") or kind.endswith("SPECTRUM") and "ABSORB" in head.get("YUNITS", "").upper()
        about = ("ir", "absorbance" if absorbs else "transmittance", None, None, None, number("RESOLUTION"), int(number("$NUMBER OF SCANS")), None, None)
    elif kind in ("UV/VIS SPECTRUM", "UV-VIS SPECTRUM", "UV/VISIBLE SPECTRUM"):
        about = ("uv_vis", None, None, None, None, None, None, number("$PATH LENGTH CM"), head.get("$SOLVENT", ""))
    else:
        raise ValueError(f"{source}: data of type {kind!r}")
    modality, mode, *rest = about
    return (source, modality, head.get("TITLE", ""), mode, x, y, *rest)


def _blocks(f, start: int, size: int):
    """Texts of the blocks that begin within `size` bytes of a file from start on: each at its title, the first one of a file
    at the file's beginning."""
    before = min(start, 1)
    f.seek(start - before)
    end, raw = before + size, f.read(before + size + 64)
    while True:
        starts = [a for m in _TITLE.finditer(raw) if (a := m.start()) >= before and (not a or raw[a - 1] in b"\r\n")]
        own = [s for s in starts if s < end]
        if start and not own or len(own) < len(starts):
            break
        more = f.read(len(raw) or 1)
        if not more:
            break
        raw += more
    ends = [*starts[1:], len(raw)]
    if not start:
        own = [0, *own[1:]] if own or not starts else []
    for a, b in zip(own, ends):
        yield raw[a:b].decode("utf-8", "replace")


def read_jcamp(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """A row of RECORD for each spectrum: one of a plain file, one of each block of a compound file. Files are cut into ranges,
    and a task takes the blocks that begin in its range."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk).cast("long"))

    def parse(batches):
        for b in batches:
            for name, start in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                with open_range(name) as f:
                    for text in _blocks(f, start, chunk):
                        if text.strip() and not ("LINK" in text.upper() and _LINK.search(text)):
                            rows.append(spectrum_row(name, text))
                        if len(rows) == AT_ONCE:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    ranges = files.select("path", F.explode(cut).alias("start"))
    return ranges.repartition(max(1, ranges.count())).mapInArrow(parse, RECORD)


_KIND = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
_NAMES = [f.split()[0] for f in RECORD.split(", ")]
_TYPES = [_KIND[f.split()[1]] for f in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


# -- writing --------------------------------------------------------------------------------------------------------------


def yfactor_of(y: np.ndarray, digits: int = 7) -> float:
    """The power of ten that makes the greatest magnitude a number of so many digits; 1 for none or zeros."""
    most = float(np.abs(y).max(initial=0.0))
    return 1.0 if most == 0.0 else 10.0 ** (math.ceil(math.log10(most)) - digits)


_SQUEEZE = {d: c for c, d in SQUEEZED.items()}
_DIFFER = {d: c for c, d in DIFFERENCE.items()}


def binary_factor_of(y: np.ndarray) -> float | None:
    """The greatest power of two of which all ordinates are whole numbers, so that none changes; 1 for none or zeros. None
    if numbers would have more than 53 binary digits, or where one isn't finite or is a negative zero, which none of them can be."""
    if not np.isfinite(y).all() or (np.signbit(y) & (y == 0)).any():
        return None
    parts, powers = np.frexp(y[y != 0])
    if not len(parts):
        return 1.0
    whole = np.abs(np.ldexp(parts, 53)).astype(np.int64)
    least = int((powers - 53 + np.log2(whole & -whole).astype(int)).min())
    return 2.0**least if powers.max() - least <= 53 and least >= -1022 else None


def _led(value: int, lead: dict[str, str]) -> str:
    """A number whose first digit is its pseudo-digit, which holds the sign."""
    text, cut = str(value), 2 if value < 0 else 1
    return lead[text[:cut]] + text[cut:]


def encode_ordinates(y: np.ndarray, first: float, step: float, factor: float, mode: str) -> str:
    """Lines of PER_LINE ordinates in the form pac, sqz or dif, each after the first led by the last value of the line before
    as a check. Whole numbers are rounded half away from zero."""
    if mode not in ("pac", "sqz", "dif"):
        raise ValueError(f"no form {mode!r}")
    scaled = np.asarray(y, float) / factor
    half = np.where(np.abs(scaled) < 1 << 52, 0.5, 0.0)  # none beyond, where all are whole and a sum would be rounded
    whole = np.trunc(scaled + np.where(scaled >= 0, half, -half)).astype(np.int64).tolist()
    out = []
    if mode == "dif":  # the differences of all lines at once, a line each
        steps = [b - a for a, b in zip(whole, whole[1:])]
        text = "\n".join(" " + " ".join(map(str, steps[max(0, i - 1) : i + PER_LINE - 1])) for i in range(0, len(whole), PER_LINE))
        for d, c in _DIFFER.items():
            text = text.replace(" " + d, " " + c)
        steps = text.split("\n")
    for i in range(0, len(whole), PER_LINE):
        part, anchor = whole[i : i + PER_LINE], format(first + i * step, ".10g")
        check = [whole[i - 1]] if i else []
        if mode == "pac":
            out.append(anchor + " " + "".join(f"{v:+d}" for v in check + part))
        elif mode == "sqz":
            out.append(" ".join([anchor, *(_led(v, _SQUEEZE) for v in check + part)]))
        else:
            out.append(f"{anchor} {_led((check or part)[0], _SQUEEZE)}{steps[i // PER_LINE]}".rstrip())
    return "".join(line + "\n" for line in out)


def encode_jcamp(row: dict, encoding: str = "affn", digits: int | None = 7) -> str:
    """The file of a row of RECORD. Compressed forms need evenly spaced x and keep so many digits of the greatest ordinate, of
    which 15 at most are exact. Without a number of digits each ordinate is kept as it is: by binary_factor_of, and in pairs
    where it has no factor."""
    if digits is not None and not 1 <= digits <= 15:
        raise ValueError(f"{digits} digits")
    x, y = np.asarray(row["x"], float), np.asarray(row["y"], float)
    if x.shape != y.shape:
        raise ValueError("x and y of different lengths")
    factor, g = 1.0, lambda v: format(float(v or 0), ".10g")
    exact = binary_factor_of(y) if digits is None else None
    if digits is None and (encoding == "affn" or exact is None):
        block = "##XYDATA=(XY..XY)\n" + "".join(f"{float(a)!r} {'?' if b is None else repr(float(b))}\n" for a, b in zip(x, row["y"]))
    elif encoding == "affn":
        block = "##XYDATA=(XY..XY)\n" + "".join(f"{g(a)} {g(b)}\n" for a, b in zip(x, y))
    else:
        step = (x[-1] - x[0]) / (len(x) - 1) if len(x) > 1 else 0.0
        if len(x) > 2 and np.abs(np.diff(x) - step).max() > 1e-9 * max(1.0, abs(step)):
            raise ValueError("compressed forms need evenly spaced x")
        factor = yfactor_of(y, digits) if exact is None else exact
        block = "##XYDATA=(X++(Y..Y))\n" + encode_ordinates(y, float(x[0]) if len(x) else 0.0, step, factor, encoding)
    modality = row["modality"]
    kind, xunits, yunits = {"raman": ("RAMAN SPECTRUM", "1/CM", "ARBITRARY UNITS"), "uv_vis": ("UV/VIS SPECTRUM", "NANOMETERS", "ABSORBANCE"), "ir": (f"INFRARED {(row.get('mode') or 'transmittance').upper()}", "1/CM", (row.get("mode") or "transmittance").upper())}[modality]
    more = {"raman": [("$EXCITATION WAVELENGTH NM", g(row.get("excitation_wavelength_nm"))), ("$LASER POWER MW", g(row.get("laser_power_mw"))), ("$INTEGRATION TIME SEC", g(row.get("integration_time_sec")))], "ir": [("RESOLUTION", g(row.get("resolution_cm_inv"))), ("$NUMBER OF SCANS", str(row.get("number_of_scans") or 0))], "uv_vis": [("$PATH LENGTH CM", g(row.get("path_length_cm"))), ("$SOLVENT", row.get("solvent") or "")]}[modality]
    head = [("TITLE", row.get("title") or ""), ("JCAMP-DX", "5.01"), ("DATA TYPE", kind), ("ORIGIN", "lumenforge"), ("OWNER", ""), ("XUNITS", xunits), ("YUNITS", yunits), ("FIRSTX", g(x[0] if len(x) else 0)), ("LASTX", g(x[-1] if len(x) else 0)), ("NPOINTS", str(len(x))), ("XFACTOR", "1"), ("YFACTOR", g(factor) if exact is None else repr(factor)), *more]
    return "".join(f"##{k}={v}\n" for k, v in head) + block + "##END=\n"


def write_jcamp(spectra: DataFrame, encoding: str = "affn", digits: int | None = 7) -> DataFrame:
    """source and content: the file of each row of RECORD, made where the row is."""

    def make(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["source"] for r in rows], pa.string()), pa.array([encode_jcamp(r, encoding, digits) for r in rows], pa.string())], ["source", "content"])

    return spectra.mapInArrow(make, "source string, content string")


def write_compound(spectra: DataFrame, path: str, encoding: str = "affn", digits: int | None = 7) -> None:
    """Rows of RECORD as compound files below a folder, one for each partition: documents of LINKED characters or so, which
    follow each other and link a block for each row."""

    def link(blocks):
        head = [("TITLE", "linked spectra"), ("JCAMP-DX", "5.01"), ("DATA TYPE", "LINK"), ("BLOCKS", str(len(blocks))), ("ORIGIN", "lumenforge"), ("OWNER", "")]
        text = "".join(f"##{k}={v}\n" for k, v in head) + "".join(blocks) + "##END=\n"
        return pa.RecordBatch.from_arrays([pa.array([text.encode()], pa.binary())], ["content"])

    def make(batches):
        blocks, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                for r in b.slice(at, AT_ONCE).to_pylist():
                    blocks.append(encode_jcamp(r, encoding, digits))
                    size += len(blocks[-1])
                    if size >= LINKED:
                        yield link(blocks)
                        blocks, size = [], 0
        if blocks:
            yield link(blocks)

    write_parts(spectra.mapInArrow(make, "content binary"), path, "jdx")
