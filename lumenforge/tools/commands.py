"""Thin commands over the library's functions. Each takes folders and files that Spark reads."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from ..dataset import Dataset, open_dataset, write_dataset
from ..functions import protect
from ..functions.text import canonical_json, with_canonical_json
from ..sources import sequences
from ..sources.files import open_range, put
from ..streaming import packets


def _key(path: str) -> bytes:
    with open_range(path) as f:
        raw = f.read()
    return bytes.fromhex(raw.strip().decode()) if len(raw.strip()) == 64 else raw


def sign(spark, a) -> int:
    """Signs a genomic run's columns; the signatures go to a JSON file."""
    reads = open_dataset(spark, a.dataset).tables["reads"].where(F.col("run_name") == a.run)
    put(a.out, canonical_json(protect.sign_run(reads, _key(a.key))).encode())
    return 0


def verify(spark, a) -> int:
    """0 if all signatures fit, 1 if not, 2 if there are none."""
    import json

    try:
        with open_range(a.signatures) as f:
            signed = json.loads(f.read())
    except FileNotFoundError:
        print("not signed")
        return 2
    reads = open_dataset(spark, a.dataset).tables["reads"].where(F.col("run_name") == a.run)
    ok = protect.verify_run(reads, _key(a.key), signed)
    print("valid" if ok else "invalid")
    return 0 if ok else 1


def encrypt(spark, a) -> int:
    """Seals the channels of a dataset's spectra row by row, with their filter keys if asked."""
    data = open_dataset(spark, a.dataset)
    units = packets._numbered(data.tables["spectra"], packets.numbered_runs(data.tables["runs"]), "spectrum_index")
    sealed = protect.seal_channels(units, _key(a.key), ("mz", "intensity"))
    if a.headers:
        sealed = protect.seal_headers(sealed, _key(a.key))
    sealed.write.mode("errorifexists").parquet(a.out)
    return 0


def decrypt(spark, a) -> int:
    sealed = spark.read.parquet(a.sealed)
    if "header" in sealed.columns:
        sealed = protect.open_headers(sealed, _key(a.key))
    protect.open_channels(sealed, _key(a.key), ("mz", "intensity")).write.mode("errorifexists").parquet(a.out)
    return 0


def import_fasta(spark, a) -> int:
    records = sequences.read_fasta(spark, a.input)
    if a.unaligned:
        from ..operators.index import reindexed

        reads = sequences.unaligned(records).withColumn("run_name", F.lit(a.run)).withColumn("read_index", F.monotonically_increasing_id())
        write_dataset(Dataset({"reads": reindexed(reads, "run_name", "read_index")}), a.out)
    else:
        write_dataset(Dataset({"reference_seqs": records.select(F.lit(a.run).alias("uri"), F.col("name").alias("chromosome"), "seq", "length")}), a.out)
    return 0


def import_fastq(spark, a) -> int:
    reads = sequences.read_fastq(spark, a.input).drop("source")
    none = {"run_name": F.lit(a.run), "chromosome": F.lit("*"), "flags": F.lit(4).cast("long"), "position": F.lit(0).cast("long"), "mapq": F.lit(255), "cigar": F.lit("*"), "mate_chromosome": F.lit("*"), "mate_position": F.lit(-1).cast("long"), "template_length": F.lit(0), "length": F.length("seq").cast("long")}
    write_dataset(Dataset({"reads": reads.withColumns(none)}), a.out)
    return 0


def export_fasta(spark, a) -> int:
    reads = open_dataset(spark, a.dataset).tables["reads"].where(F.col("run_name") == a.run)
    sequences.write_fasta(reads.select(F.col("read_name").alias("name"), "seq", "read_index"), a.out, "read_index")
    return 0


def export_fastq(spark, a) -> int:
    reads = open_dataset(spark, a.dataset).tables["reads"].where(F.col("run_name") == a.run)
    sequences.write_fastq(reads, a.out, a.offset)
    return 0


def transport_encode(spark, a) -> int:
    data = open_dataset(spark, a.dataset)
    packets.write_stream(packets.dataset_stream(data.tables, data.title, features=tuple(data.features), checksum=a.checksum, compress=a.compress), a.out)
    return 0


def transport_decode(spark, a) -> int:
    tables, head = packets.read_dataset(packets.read_stream(spark, a.input))
    tables["spectra"] = tables["spectra"].drop("channels")
    write_dataset(Dataset({k: v for k, v in tables.items() if k == "runs" or not v.isEmpty()}, head["title"], head["features"]), a.out)
    return 0


def transport_serve(spark, a) -> int:
    data = open_dataset(spark, a.dataset)
    packets.serve(data.tables, a.clients, a.host, a.port, ready=lambda at: print(f"{at[0]}:{at[1]}", flush=True), title=data.title, features=tuple(data.features))
    return 0


def simulate(spark, a) -> int:
    spectra = packets.simulate(spark, max(1, int(a.scan_rate * a.duration)), a.seed, a.scan_rate, a.ms1_fraction, (a.mz_min, a.mz_max), a.peaks)
    runs = spark.createDataFrame([("simulated_run", "spectral", "MassSpectrum", 1, ["mz", "intensity"])], "run_name string, modality string, spectrum_class string, acquisition_mode int, channel_names array<string>")
    packets.write_stream(packets.dataset_stream({"runs": runs, "spectra": spectra}, "Simulated acquisition", "ISA-SIMULATOR", ("base_v1",)), a.out)
    return 0


def dump(spark, a) -> int:
    """A table's rows as canonical JSON, a line each, in order of all columns."""
    df = open_dataset(spark, a.dataset).tables[a.table]
    for r in with_canonical_json(df).orderBy("json").toLocalIterator():
        sys.stdout.write(r[0] + "\n")
    return 0


#: Commands by name, each with its function and arguments.
COMMANDS = {
    "sign": (sign, "dataset --run --key --out"),
    "verify": (verify, "dataset --run --key --signatures"),
    "per-au-encrypt": (encrypt, "dataset --key --out --headers?"),
    "per-au-decrypt": (decrypt, "sealed --key --out"),
    "fasta-import": (import_fasta, "input --run --out --unaligned?"),
    "fastq-import": (import_fastq, "input --run --out"),
    "fasta-export": (export_fasta, "dataset --run --out"),
    "fastq-export": (export_fastq, "dataset --run --out --offset=33"),
    "transport-encode": (transport_encode, "dataset --out --checksum? --compress?"),
    "transport-decode": (transport_decode, "input --out"),
    "transport-serve": (transport_serve, "dataset --clients=1 --host=127.0.0.1 --port=0"),
    "simulate": (simulate, "--out --scan_rate=10.0 --duration=10.0 --seed=42 --ms1_fraction=0.3 --mz_min=100.0 --mz_max=2000.0 --peaks=200"),
    "dump": (dump, "dataset table"),
    "pqc": (lambda *_: protect.post_quantum(), ""),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenforge.tools")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in COMMANDS.items():
        one = commands.add_parser(name, help=(f.__doc__ or "").strip().split("\n")[0])
        for x in arguments.split():
            if x.endswith("?"):
                one.add_argument(x[:-1], action="store_true")
            elif "=" in x:
                flag, default = x.split("=")
                one.add_argument(flag, type=float if "." in default and default.replace(".", "").isdigit() and default.count(".") == 1 else int if default.isdigit() else str, default=float(default) if default.replace(".", "").isdigit() and default.count(".") == 1 else int(default) if default.isdigit() else default)
            else:
                one.add_argument(x, **({"required": True} if x.startswith("--") else {}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    code = COMMANDS[a.command][0](spark or SparkSession.builder.getOrCreate(), a)
    if argv is None:
        sys.exit(code)
    return code
