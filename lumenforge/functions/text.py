"""Text functions of importers and exporters, as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

#: Fixed values that read as no number.
NULLISH = ("", "null", "na", "n/a", "nan")


def run_name_of(location: Column, default: str) -> Column:
    """Base name of a location without its last extension; the default if nothing is left."""
    base = F.regexp_extract(location, r"([^/]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit("")), F.lit(default))


def tsv_cell(text: Column) -> Column:
    return F.translate(text, "\t\r\n", "   ")


def nullish_double(text: Column) -> Column:
    """A number, or null if the text is blank, says null or is no number."""
    return F.when(F.lower(F.trim(text)).isin(*NULLISH), F.lit(None)).otherwise(text.try_cast("double"))


def fold(sequence: Column, width: int = 60) -> Column:
    """The sequence in lines of `width`, each ended by a newline."""
    return F.regexp_replace(sequence, "(?s)(.{1,%d})" % width, "$1\n")


def reference_uri(name: Column) -> Column:
    """File name without .gz, then without the extension of a sequence file."""
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.gz$", ""), r"(?i)\.(fasta|fa|fna|ffn|faa|frn|fas)$", "")


def nucleus(text: Column) -> Column:
    """Isotope of a nucleus's name, as written if unknown."""
    t = F.lower(text)
    return F.when(t.contains("1h") | t.contains("hydrogen") | t.contains("proton"), "1H").when(t.contains("13c") | t.contains("carbon"), "13C").when(t.contains("15n") | t.contains("nitrogen"), "15N").when(t.contains("31p") | t.contains("phosph"), "31P").when(t.contains("19f") | t.contains("fluor"), "19F").otherwise(text)


def confidence_of_rank(rank: Column) -> Column:
    return F.lit(1.0) / rank


def rank_of_confidence(score: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(F.lit(1.0) / score).cast("int"))


def nullish_int(text: Column) -> Column:
    """A whole number, or null; 1.0 is none."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long"))


# What XML puts in place of its own characters.
_XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def xml_text(text: Column) -> Column:
    for plain, escaped in _XML:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def isa_cell(text: Column) -> Column:
    """A cell of a study table: quoted, inner quotes doubled, if it holds a tab, a quote or a line end."""
    return F.when(text.rlike("[\t\"\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def format_g(column: Column, digits: int = 6) -> Column:
    """Numbers as C's %g writes them, with so many digits. An Arrow function, since Java's %g is another thing."""
    @F.pandas_udf("string")
    def g(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else format(x, f".{digits}g"))

    return g(column.cast("double"))


def yfactor_for(greatest: Column) -> Column:
    """Power of ten that makes the greatest magnitude a number of seven digits; 1 for 0 or no number."""
    ok = (greatest > 0) & ~F.isnan(greatest) & (greatest < float("inf"))
    return F.when(ok, F.pow(F.lit(10.0), F.ceil(F.log10(greatest)) - 7)).otherwise(1.0)


def half_away(value: Column) -> Column:
    """The nearest whole number, halves away from 0."""
    return (F.signum(value) * F.floor(F.abs(value) + 0.5)).cast("long")


def rounded_in_binary(value: Column, places: int) -> Column:
    """A double rounded as DuckDB does it: times a power of ten, to the nearest whole number with halves away from 0, and back.
    A zero keeps its sign, and a number that is too great for the product stays as it is. Spark's own goes by decimals."""
    power = 10.0**places
    times = F.abs(value * power)
    near = F.rint(times)
    back = F.signum(value) * F.when(times - near == 0.5, near + 1).otherwise(near) / power
    return F.when(F.isnan(back) | (F.abs(back) == float("inf")), value).otherwise(back)


def interleaved(values: Column) -> Column:
    """x and y of an array that holds them in turns."""
    return F.struct(F.filter(values, lambda _, i: i % 2 == 0).alias("x"), F.filter(values, lambda _, i: i % 2 == 1).alias("y"))


def axis(first: Column, step: Column, n: Column) -> Column:
    """n values from the first on, in steps."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: first + i * step)).otherwise(F.array().cast("array<double>"))


def merged(*maps: Column) -> Column:
    """One map of several; of equal keys the last counts."""
    entries = F.concat(*[F.map_entries(m) for m in maps])
    numbered = F.map_from_arrays(F.array_distinct(F.transform(entries, lambda e: e["key"])), F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
    return numbered


def string_list(json: Column) -> Column:
    """Texts of a JSON list; none of anything else."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def string_map(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def iso_time(unix_seconds: Column) -> Column:
    """Seconds since 1970 as an ISO 8601 time in UTC."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(unix_seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def json_escape(text: str) -> str:
    """A JSON string: control characters, quotes and backslashes escaped, all else as it is."""
    import json

    return json.dumps(text, ensure_ascii=False)


def canonical_json(value) -> str:
    """JSON without blanks, keys sorted, numbers as %.17g."""
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return format(value, ".17g")
    if isinstance(value, str):
        return json_escape(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json_escape(k)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"
    raise TypeError(f"no JSON of {type(value).__name__}")


def with_canonical_json(df, name: str = "json"):
    """df's rows as one column of canonical JSON, made where the rows are."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([canonical_json(r) for r in b.to_pylist()], pa.string())], [name])

    return df.mapInArrow(run, f"{name} string")


def zlib_base64(column: Column, compress: bool = True) -> Column:
    """Bytes as base64, of their zlib form if asked."""
    import base64
    import zlib

    @F.pandas_udf("string")
    def made(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else base64.b64encode(zlib.compress(bytes(x)) if compress else bytes(x)).decode())

    return made(column.cast("binary"))


def base64_zlib(column: Column, compressed: bool = True) -> Column:
    """The bytes again."""
    import base64
    import zlib

    @F.pandas_udf("binary")
    def made(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else zlib.decompress(base64.b64decode(x)) if compressed and x else base64.b64decode(x))

    return made(column)


def hmac_sha256(column: Column, key: bytes) -> Column:
    """Lower-case hex HMAC-SHA256 of bytes, in Spark's own functions: two digests over padded keys."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), column.cast("binary")), 256))), 256)


def crc32c(column: Column) -> Column:
    """Castagnoli checksum of bytes."""
    @F.pandas_udf("long")
    def made(values: pd.Series) -> pd.Series:
        from ..streaming.packets import crc32c_many

        return pd.Series(crc32c_many([b"" if x is None else bytes(x) for x in values]).astype("int64"))

    return made(column.cast("binary"))
