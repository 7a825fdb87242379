"""Registered queries of readers, writers, streams, protection and the policies: rows are written in a format first and read
from it again, so what SQL says of the tables holds only if nothing is lost on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .dataset import Dataset, all_runs, resolve_references, split_runs, with_chromosome_names
from .functions import protect, text as fn
from .functions.genomic_codecs import mate_class, position_bucket
from .operators import aggregate as agg, anonymize as anon, correlation as cos, index as ix
from .plans import predicates as p
from .queries import QUERIES, R, READ, REGIONS, S, SPECTRUM, _LONG, _matrix, query
from .sources import jcamp, mztab, sequences as seqs, spectra as xml
from .streaming import packets as pk

__all__ = ["QUERIES"]


def scratch(df: DataFrame, name: str) -> str:
    """A fresh place below the session's shared folder, or below the warehouse where there is none."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- spectra in files -----------------------------------------------------------------------------------------------------

_VECTORS = "select vec_id, embedding from embeddings where vec_id < 60"


def _vectors(table) -> DataFrame:
    values = F.col("embedding").cast("array<double>")
    return table("embeddings").where("vec_id < 60").select(F.col("vec_id").alias("spectrum_index"), F.transform(values, lambda x, i: i + 100.0).alias("mz"), F.transform(values, lambda x: F.abs(x)).alias("intensity"), (F.col("vec_id") / 2.0).alias("retention_time"), (F.col("vec_id") % 2 + 1).cast("int").alias("ms_level"), F.lit(1).alias("polarity"), F.when(F.col("vec_id") % 2 == 1, 500.0 + F.col("vec_id")).otherwise(0.0).alias("precursor_mz"), F.when(F.col("vec_id") % 2 == 1, 2).otherwise(0).alias("precursor_charge"))


_VECTOR_ROWS = "vec_id as spectrum_index, vec_id / 2.0 as retention_time, cast(vec_id % 2 + 1 as integer) as ms_level, 1 as polarity, case when vec_id % 2 = 1 then 500.0 + vec_id else 0.0 end as precursor_mz, cast(case when vec_id % 2 = 1 then 2 else 0 end as integer) as precursor_charge, list_transform(embedding, lambda x: abs(cast(x as double))) as intensity, cast(len(embedding) as bigint) as n"


@query(f"select {_VECTOR_ROWS} from embeddings where vec_id < 60")
def mzml_round_trip(table):
    """Spectra written as an indexed mzML file, in parts, and read by ranges."""
    df = _vectors(table)
    at = scratch(df, "mzml")
    xml.write_mzml(df, at, "run<1>", compress=True)
    whole = scratch(df, "mzml-whole") + ".mzML"
    xml.put(whole, xml.joined(at))
    return xml.read_mzml(df.sparkSession, whole).select("spectrum_index", "retention_time", "ms_level", "polarity", "precursor_mz", "precursor_charge", "intensity", F.size("mz").cast("long").alias("n"))


@query("select vec_id as spectrum_index, '13C' as nucleus_type, 600.5 as spectrometer_frequency_mhz, list_transform(embedding, lambda x: cast(x as double)) as intensity from embeddings where vec_id < 60")
def nmrml_round_trip(table):
    df = table("embeddings").where("vec_id < 60").select(F.format_string("%05d", "vec_id").alias("source"), F.transform("embedding", lambda x, i: i / 8.0).alias("chemical_shift"), F.col("embedding").cast("array<double>").alias("intensity"), F.lit("13C").alias("nucleus_type"), F.lit(600.5).alias("spectrometer_frequency_mhz"))
    at = scratch(df, "nmrml")
    for r in xml.nmrml_files(df).toLocalIterator():
        xml.put(f"{at}/{r['source']}.nmrML", bytes(r["content"]))
    found = xml.read_nmrml(df.sparkSession, at)
    return found.select(F.regexp_extract("source", r"(\d+)\.nmrML$", 1).cast("long").alias("spectrum_index"), "nucleus_type", "spectrometer_frequency_mhz", "intensity")


@query("select cast(vec_id % 10 + 1 as integer) as x, cast(vec_id // 10 + 1 as integer) as y, 1 as z, list_transform(embedding, lambda x: cast(x as double)) as intensity from embeddings where vec_id < 60")
def imzml_round_trip(table):
    """Pixels of a continuous image written with their binary, and read by ranges of it."""
    df = table("embeddings").where("vec_id < 60").select((F.col("vec_id") % 10 + 1).cast("int").alias("x"), (F.floor(F.col("vec_id") / 10) + 1).cast("int").alias("y"), F.lit(1).alias("z"), F.transform("embedding", lambda x, i: i + 100.0).alias("mz"), F.col("embedding").cast("array<double>").alias("intensity"))
    at = scratch(df, "imzml")
    about = xml.write_imzml(df, at)
    pixels, told = xml.read_imzml(df.sparkSession, xml.local(at) + ".imzML")
    assert told["grid"] == about["grid"] and told["uuid"] == about["uuid"]
    return pixels.select("x", "y", "z", "intensity")


@query("select vec_id, list_transform(embedding, lambda x: round(cast(x as double), 4)) as y, cast(len(embedding) as bigint) as n from embeddings")
def jcamp_round_trip(table):
    """Spectra in the difference form in compound files, decoded again; the title is a vector's number. Ordinates are kept as they
    are, since fewer digits move a value near the middle of two steps of the SQL's rounding to the wrong side. Without an array
    there is no spectrum to write."""
    vectors = table("embeddings")
    df = vectors.where("embedding is not null").select(F.lit("raman").alias("modality"), F.col("vec_id").cast("string").alias("title"), F.transform("embedding", lambda x, i: 100.0 + 2 * i).alias("x"), F.col("embedding").cast("array<double>").alias("y"))
    at = scratch(df, "jcamp")
    jcamp.write_compound(df, at, "dif", None)
    found = jcamp.read_jcamp(df.sparkSession, at).select(F.expr("cast(nullif(title, '') as bigint)").alias("vec_id"), F.transform("y", lambda v: fn.rounded_in_binary(v, 4)).alias("y"), F.size("x").cast("long").alias("n"))
    return found.unionByName(vectors.where("embedding is null").select("vec_id", F.lit(None).cast("array<double>").alias("y"), F.lit(None).cast("long").alias("n")))


_IDS = "select concat('run_', cast(o_orderkey % 3 as varchar)) as run_name, cast(o_orderkey % 1000 as bigint) as spectrum_index, concat('P', cast(o_custkey as varchar)) as chemical_entity, cast(o_custkey % 97 as double) as confidence_score from orders where o_orderkey < 3000"


@query(_IDS)
def mztab_identifications(table):
    """Identifications as a proteomics table and back."""
    ids = table("orders").where("o_orderkey < 3000").select(F.concat(F.lit("run_"), (F.col("o_orderkey") % 3).cast("string")).alias("run_name"), (F.col("o_orderkey") % 1000).alias("spectrum_index"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("chemical_entity"), (F.col("o_custkey") % 97).cast("double").alias("confidence_score"), F.array().cast("array<string>").alias("evidence_chain"), F.col("o_orderkey").alias("line_no"))
    at = scratch(ids, "mztab")
    mztab.write_mztab(at, identifications=ids)
    return mztab.read_mztab(ids.sparkSession, at).identifications.select("run_name", "spectrum_index", "chemical_entity", "confidence_score")


@query("select concat('E', cast(l_partkey % 50 as varchar)) as chemical_entity, l_returnflag as sample_ref, arg_max(cast(l_linenumber * 10 + l_suppkey % 7 as double), l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey) as abundance from lineitem where l_orderkey < 400 group by 1, 2")
def mztab_quantifications(table):
    """Quantities as a metabolomics table and back; of several the last written counts."""
    q = table("lineitem").where("l_orderkey < 400").select(F.concat(F.lit("E"), (F.col("l_partkey") % 50).cast("string")).alias("chemical_entity"), F.col("l_returnflag").alias("sample_ref"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 7).cast("double").alias("abundance"), F.lit("").alias("normalization_method"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("line_no"))
    at = scratch(q, "mztab")
    mztab.write_mztab(at, quantifications=q, version="2.0.0-M")
    return mztab.read_mztab(q.sparkSession, at).quantifications.select("chemical_entity", "sample_ref", "abundance")


# -- sequences in files ---------------------------------------------------------------------------------------------------

_SEQ = "translate(md5(concat('s', cast({0} as {1}))), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_FEW = "l_orderkey < 300"


def _reads(view) -> DataFrame:
    seq = F.expr(_SEQ.format("read_index", "string"))
    return view.where(_FEW).withColumns({"read_index": F.col("read_index").cast("long"), "seq": seq, "qual": F.concat(F.substring("seq", 1, 31), F.lit("I")), "mapq": (F.col("position") % 60).cast("int"), "mate_chromosome": F.when(F.col("flags") % 2 == 0, F.col("chromosome")).otherwise("*"), "mate_position": F.when(F.col("flags") % 2 == 0, F.col("position") + 100).otherwise(-1).cast("long"), "template_length": (F.col("position") % 500 - 250).cast("int")}).withColumn("cigar", F.lit("10S22M"))


_READ_SQL = "read_name, flags, chromosome, position, cast(position % 60 as integer) as mapq, " + _SEQ.format("read_index", "varchar") + " as seq, cast(case when flags % 2 = 0 then position + 100 else 0 end as bigint) as mate_position, cast(position % 500 - 250 as integer) as template_length, case when flags % 2 = 0 then chromosome else '*' end as mate_chromosome"
_ALIGNED = ["read_name", "flags", "chromosome", "position", "mapq", "seq", "mate_position", "template_length", "mate_chromosome"]


@query(f"select {_READ_SQL} from v_reads where {_FEW} and run_name = 'g1'", "reads")
def sam_round_trip(reads, _):
    own = _reads(reads).where("run_name = 'g1'")
    at = scratch(own, "sam")
    seqs.write_sam(own, at, sample_name="NA1")
    whole = scratch(own, "sam-whole") + ".sam"
    xml.put(whole, xml.joined(at))
    return seqs.read_sam(own.sparkSession, whole).select(*_ALIGNED)


@query(f"select {_READ_SQL} from v_reads where {_FEW} and run_name = 'g1'", "reads")
def bam_round_trip(reads, _):
    """The same as BAM: blocks packed by tasks and inflated by tasks."""
    own = _reads(reads).where("run_name = 'g1'")
    at = scratch(own, "bam")
    seqs.write_bam(own, at)
    whole = scratch(own, "bam-whole") + ".bam"
    xml.put(whole, xml.joined(at))
    found, _ = seqs.read_bam(own.sparkSession, whole)
    return found.select(*_ALIGNED)


@query("select concat('s', cast(o_orderkey as varchar)) as name, " + _SEQ.format("o_orderkey", "varchar") + " as seq, cast(32 as bigint) as length from orders")
def fasta_round_trip(table):
    df = table("orders").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("name"), F.expr(_SEQ.format("o_orderkey", "string")).alias("seq"), F.col("o_orderkey").alias("nth"))
    at = scratch(df, "fasta")
    seqs.write_fasta(df, at, "nth", 10)
    return seqs.read_fasta(df.sparkSession, at)


@query("select name, length, sum(head + length + lines) over (order by nth) - lines - length as \"offset\", cast(10 as bigint) as line_bases, cast(11 as bigint) as line_bytes from (select o_orderkey as nth, concat('s', cast(o_orderkey as varchar)) as name, cast(32 as bigint) as length, 4 as lines, length(concat('s', cast(o_orderkey as varchar))) + 2 as head from orders)")
def fasta_index(table):
    df = table("orders").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("name"), F.expr(_SEQ.format("o_orderkey", "string")).alias("seq"), F.col("o_orderkey").alias("nth"))
    return seqs.fasta_index(df, "nth", 10)


@query("select concat('s', cast(o_orderkey as varchar)) as read_name, " + _SEQ.format("o_orderkey", "varchar") + " as seq, cast(row_number() over (order by o_orderkey) - 1 as bigint) as read_index, 'IIIIIIIIIIIIIIII!!!!!!!!!!!!!!!!' as qual from orders")
def fastq_round_trip(table):
    """Reads with qualities of either offset; the reader tells 64 by the bytes."""
    qual = F.unhex(F.concat(F.repeat(F.lit("49"), 16), F.repeat(F.lit("ff"), 16)))
    df = table("orders").select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("read_name"), F.expr(_SEQ.format("o_orderkey", "string")).alias("seq"), qual.alias("qual"), F.col("o_orderkey").alias("read_index"))
    at = scratch(df, "fastq")
    seqs.write_fastq(df, at, 64)
    whole = scratch(df, "fastq-whole") + ".fq"
    xml.put(whole, xml.joined(at))
    found = seqs.read_fastq(df.sparkSession, whole, chunk=100_000)
    return found.select("read_name", "seq", "read_index", F.col("qual").cast("string").alias("qual"))


@query(f"select {R}, case when name_row > 1 then concat(read_name, '#', cast(read_index as varchar)) else read_name end as name from (select *, row_number() over (partition by run_name, read_name order by read_index) as name_row from v_reads)", "reads")
def export_names(reads, _):
    return ix.unique_names(reads, "read_name", "read_index", "run_name").select(*READ, F.col("unique_name").alias("name"))


# -- streams --------------------------------------------------------------------------------------------------------------


def _runs(spectra: DataFrame) -> DataFrame:
    return spectra.select("run_name").distinct().withColumns({"modality": F.lit("spectral"), "spectrum_class": F.lit("MassSpectrum"), "acquisition_mode": F.lit(1), "channel_names": F.array(F.lit("mz"), F.lit("intensity"))})


def _with_arrays(spectra: DataFrame) -> DataFrame:
    return spectra.withColumns({"mz": F.array(F.lit(100.0), F.col("base_peak_intensity") + 100), "intensity": F.array(F.lit(0.0), F.col("base_peak_intensity")), "precursor_charge": F.lit(0)})


@query(f"select {S}, retention_time, ms_level, polarity, precursor_mz, [0.0, base_peak_intensity] as intensity, [100.0, base_peak_intensity + 100] as mz from v_spectra where event_id < 2000", "spectra")
def transport_round_trip(spectra, _):
    """A dataset as a stream of packets in part files, with checksums and packed channels, read by ranges to tables again."""
    own = _with_arrays(spectra.where("event_id < 2000"))
    at = scratch(own, "stream")
    pk.write_stream(pk.dataset_stream({"runs": _runs(own), "spectra": own}, "t", checksum=True, compress=True), at)
    tables, head = pk.read_dataset(pk.read_stream(own.sparkSession, at, chunk=1 << 16))
    assert head["n_datasets"] == tables["runs"].count()
    return tables["spectra"].select(*SPECTRUM, "retention_time", "ms_level", "polarity", "precursor_mz", "intensity", "mz")


@query(f"select {R}, read_name, chromosome, position, cast(flags as bigint) as flags, {_SEQ.format('read_index', 'varchar')} as seq, '10S22M' as cigar from v_reads where {_FEW}", "reads")
def transport_reads(reads, _):
    """Reads as access units with entropy-coded qualities and packed bases."""
    own = _reads(reads)
    ids = own.select("run_name").distinct()
    units = own.join(ids.withColumn("dataset_id", F.substring("run_name", 2, 1).cast("long") + 1), "run_name").withColumn("au_sequence", F.col("read_index") % (1 << 31))
    packets = pk.write_read_units(units, seq_codec=6, qual_codec=4)
    found = pk.parse_units(pk.read_packets(packets, "packet"), arrays=True)
    back = units.select("run_name", "read_index", "dataset_id", "au_sequence")
    return found.join(back, ["dataset_id", "au_sequence"]).select(*READ, "read_name", "chromosome", "position", "flags", F.col("seq").cast("string").alias("seq"), "cigar")


@query("select kind, cast(count(*) as bigint) as n from (select 3 as kind from (select * from v_spectra where event_id < 2000 and ms_level = 2 and run_name = 'run_1' order by spectrum_index limit 50) union all select 1 union all select 2 union all select 8 union all select 255) group by 1", "spectra")
def selective_access(spectra, _):
    """What a server sends for one dataset, one level and a cap: the skeleton of the stream, and the units that pass."""
    own = _with_arrays(spectra.where("event_id < 2000"))
    stream = pk.dataset_stream({"runs": _runs(own), "spectra": own}, only=p.UnitFilter(ms_level=2, dataset_id=2, max_au=50))
    return pk.read_packets(pk.ordered(stream), "packet").groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"))


@query("select dataset_id, au_sequence from (select cast(dataset_id as integer) as dataset_id, event_id as au_sequence, lag(event_id) over (partition by dataset_id order by event_id * 7919 % 1000003) as before from v_spectra where event_id < 3000) where au_sequence <= before", "spectra")
def stream_violations(spectra, _):
    """Units of a shuffled stream that come after a larger number."""
    own = spectra.where("event_id < 3000")
    units = own.select(F.lit(pk.ACCESS_UNIT).alias("type"), F.col("dataset_id").cast("int").alias("dataset_id"), F.col("event_id").alias("au_sequence"), (F.col("event_id") * 7919 % 1000003).alias("arrival"))
    heads = own.select(F.lit(pk.DATASET_HEADER).alias("type"), F.col("dataset_id").cast("int").alias("dataset_id"), F.lit(0).cast("long").alias("au_sequence"), F.lit(-1).cast("long").alias("arrival")).distinct()
    first = own.sparkSession.createDataFrame([(pk.STREAM_HEADER, 0, 0, -2)], "type int, dataset_id int, au_sequence long, arrival long")
    return pk.violations(units.unionByName(heads).unionByName(first)).select("dataset_id", "au_sequence")


# -- protection -----------------------------------------------------------------------------------------------------------

_KEY = bytes.fromhex("00112233445566778899aabbccddeeff" * 2)


@query(f"select {S}, retention_time, ms_level, precursor_mz, [0.0, base_peak_intensity] as intensity from v_spectra where event_id < 2000", "spectra")
def sealed_channels(spectra, _):
    """Channels and filter keys sealed row by row, and opened again."""
    own = _with_arrays(spectra.where("event_id < 2000")).withColumn("au_sequence", F.col("spectrum_index")).drop("base_peak_intensity", "polarity")
    shut = protect.seal_headers(protect.seal_channels(own, _KEY, ("mz", "intensity")), _KEY)
    back = protect.open_channels(protect.open_headers(shut, _KEY), _KEY, ("mz", "intensity"))
    return back.select(*SPECTRUM, "retention_time", "ms_level", "precursor_mz", "intensity")


@query(f"select {R}, chromosome = 'R' as was_sealed, {_SEQ.format('read_index', 'varchar')} as seq from v_reads where {_FEW}", "reads")
def sealed_regions(reads, _):
    """Reads of one chromosome sealed under its key, all others clear."""
    own = _reads(reads).withColumn("dataset_id", F.lit(1))
    shut = protect.seal_regions(own, {"R": _KEY})
    told = shut.withColumn("was_sealed", F.octet_length("seq.iv") == 12)
    return protect.open_regions(told, {"R": _KEY}).select(*READ, "was_sealed", F.col("seq").cast("string").alias("seq"))


@query("select algorithm, key_size from (values ('aes-256-gcm', 32), ('ml-kem-1024', 1568), ('ml-dsa-87', 2592), ('sha-256', 0)) t(algorithm, key_size)")
def active_ciphers(table):
    return protect.catalogue(table("region").sparkSession).where("status = 'active' and key_size is not null").select("algorithm", "key_size")


# -- policies -------------------------------------------------------------------------------------------------------------


def _policy_data(spectra: DataFrame, ids: DataFrame) -> Dataset:
    own = _with_arrays(spectra.where("event_id < 4000"))
    marked = ids.withColumn("chemical_entity", F.when(F.col("chemical_entity").contains("URGENT"), "p.Ala1Thr saav").otherwise(F.col("chemical_entity"))).drop("id")
    return Dataset({"spectra": own, "identifications": marked}, "secret")


_GONE = "exists (select 1 from v_ids i where i.run_name = s.run_name and i.spectrum_index = s.spectrum_index and chemical_entity like '%URGENT%')"
_RARE = "exists (select 1 from v_ids i where i.run_name = s.run_name and i.spectrum_index = s.spectrum_index and chemical_entity = '2-HIGH')"


@query(f"select cast(count(*) filter (where gone) as bigint) as spectra_redacted, cast(2 * count(*) filter (where not gone) as bigint) as mz_values_coarsened, cast(count(*) filter (where not gone and base_peak_intensity > 0) as bigint) as intensities_zeroed, cast(count(*) filter (where not gone and rare) as bigint) as metabolites_masked, cast(1 as bigint) as metadata_fields_stripped from (select *, {_GONE} as gone, {_RARE} as rare from v_spectra s where event_id < 4000)", "spectra", "ids")
def policy_counters(spectra, ids, _):
    """The counters of a run of the anonymiser over all its policies of spectra."""
    policy = anon.Policy(redact_saav_spectra=True, coarsen_mz_decimals=1, mask_intensity_below_quantile=0.5, mask_rare_metabolites=True, rare_metabolite_table={"2-HIGH": 0.01, "5-LOW": 0.9}, strip_metadata_fields=True)
    _, done = anon.anonymize(_policy_data(spectra, ids), policy)
    names = ("spectra_redacted", "mz_values_coarsened", "intensities_zeroed", "metabolites_masked", "metadata_fields_stripped")
    return spectra.sparkSession.createDataFrame([tuple(int(done[c]) for c in names)], ", ".join(f"{c} long" for c in names))


@query(f"select run_name, cast(row_number() over (partition by run_name order by spectrum_index) - 1 as bigint) as spectrum_index, event_id, case when {_RARE} then [0.0, 0.0] else [0.0, base_peak_intensity] end as intensity, [100.0, round_even((base_peak_intensity + 100) * 10.0, 0) / 10.0] as mz from v_spectra s where event_id < 4000 and not {_GONE}", "spectra", "ids")
def policy_spectra(spectra, ids, _):
    """The spectra that are left, numbered anew, with what was rounded and zeroed."""
    policy = anon.Policy(redact_saav_spectra=True, coarsen_mz_decimals=1, mask_rare_metabolites=True, rare_metabolite_table={"2-HIGH": 0.01, "5-LOW": 0.9})
    out, _ = anon.anonymize(_policy_data(spectra, ids), policy)
    return out.tables["spectra"].select(*SPECTRUM, "event_id", "intensity", "mz")


@query(f"select {R}, case when hit then repeat('0', 64) else hex(encode(seq)) end as seq, read_name from (select *, '' as read_name, {_SEQ.format('read_index', 'varchar')} as seq, exists (select 1 from (values ('R', 500, 510), ('R', 509, 600), ('A', 0, 4), ('N', 1999, 9000000000000000000)) m(c, s, e) where m.c = r.chromosome and not (r.position + 21 < m.s or r.position > m.e)) as hit from (select * exclude (read_name) from v_reads) r where {_FEW})", "reads")
def policy_reads(reads, _):
    """Reads under a policy: names gone, and bytes of those in regions zeroed."""
    out, _ = anon.anonymize(Dataset({"reads": _reads(reads)}), anon.Policy(strip_read_names=True, mask_regions=REGIONS))
    return out.tables["reads"].select(*READ, F.hex(F.col("seq").cast("binary")).alias("seq"), "read_name")


@query(f"select {R}, 32 as n from v_reads where {_FEW}", "reads")
def seeded_qualities(reads, _):
    """Quality bytes drawn by a seed: as many as before, all of 0 to 93."""
    own = _reads(reads).withColumn("qual", F.col("qual").cast("binary"))
    drawn = anon.seeded_qualities(own, 7)
    return drawn.select(*READ, F.octet_length("qual").alias("n"))


@query("select vec_id, list_transform(embedding, lambda x: case when cast(x as double) < 0 then 0.0::double else cast(x as double) end) as masked from embeddings where vec_id % 3 = 0 union all select vec_id, list_transform(embedding, lambda x: 0.0::double) from embeddings where vec_id % 3 = 1")
def masked_rare(table):
    """Values of spectra zeroed by a rare identification; unlisted and common entities leave them."""
    df = table("embeddings").where("vec_id % 3 < 2").select(F.lit("r").alias("run_name"), F.col("vec_id").alias("spectrum_index"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when((x < 0) & (F.col("vec_id") % 3 == 0), 0.0).otherwise(x)).alias("intensity"))
    ids = df.select("run_name", "spectrum_index", F.when(F.col("spectrum_index") % 3 == 1, "rare").otherwise("unlisted").alias("chemical_entity"))
    table_ = df.sparkSession.createDataFrame([("rare", 0.01), ("common", 0.5)], "chemical_entity string, prevalence double")
    return anon.mask_rare(df, ids, table_).select(F.col("spectrum_index").alias("vec_id"), F.col("intensity").alias("masked"))


# -- lookups, aggregates, functions -----------------------------------------------------------------------------------------


@query(f"select {R}, case chromosome when 'A' then 'chr1' when 'N' then 'chr2' else '*' end as name from v_reads", "reads")
def chromosome_names(reads, _):
    ids = reads.withColumn("chromosome_id", F.expr("case chromosome when 'A' then 0 when 'N' then 1 else 7 end")).drop("chromosome")
    names = reads.sparkSession.createDataFrame([(0, "chr1"), (1, "chr2")], "id int, name string")
    return with_chromosome_names(ids, names, to="name").select(*READ, "name")


@query(f"select {R}, case when run_name = 'g1' and chromosome = 'A' then 'ACGT' end as reference_seq from v_reads", "reads")
def reference_of_reads(reads, _):
    spark = reads.sparkSession
    runs = spark.createDataFrame([("g1", "u1"), ("g2", "u2")], "run_name string, reference_uri string")
    refs = spark.createDataFrame([("u1", "A", "ACGT"), ("u9", "N", "TT")], "uri string, chromosome string, seq string")
    return resolve_references(reads, runs, refs).select(*READ, "reference_seq")


@query("select run_name, cast(count(*) as bigint) as rows, cast(sum(length) as bigint) as total_length from v_reads group by 1", "reads")
def run_totals(reads, _):
    return agg.run_totals(reads)


@query("select concat('im', cast(vec_id % 3 as varchar)) as image_id, max(vec_id % 17) as max_x, max(vec_id % 11) as max_y, max(1) as max_z from embeddings group by 1")
def grid_extent(table):
    return agg.grid_extent(table("embeddings").select(F.concat(F.lit("im"), (F.col("vec_id") % 3).cast("string")).alias("image_id"), (F.col("vec_id") % 17).alias("x"), (F.col("vec_id") % 11).alias("y"), F.lit(1).alias("z")))


@query("select run_name, max(case when event_type = 'purchase' then 1 else 0 end) = 1 as detailed from v_spectra group by 1", "spectra")
def detailed_runs(spectra, _):
    return agg.run_is_detailed(spectra.select("run_name", F.when(F.col("event_type") == "purchase", 3).otherwise(0).alias("activation_method"), *[F.lit(0.0).alias(c) for c in ("isolation_target_mz", "isolation_lower_offset", "isolation_upper_offset")]))


@query("select min(run_name) as run_name from v_spectra where run_name > 'run_0'", "spectra")
def first_qualifying_run(spectra, _):
    runs = spectra.select("run_name", F.when(F.col("run_name") > "run_0", "MassSpectrum").otherwise("NMRSpectrum").alias("spectrum_class")).distinct()
    return agg.first_run(runs, "MassSpectrum").select("run_name")


@query("select o_orderkey as frame, cast(count(l_orderkey) as bigint) as length, coalesce(list(l_discount order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) filter (where l_orderkey is not null), []) as inv_ion_mobility from orders left join lineitem on l_orderkey = o_orderkey where o_orderkey % 2 = 0 group by 1")
def mobility_frames(table):
    frames = table("orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") % 2 + 1).alias("ms_level"))
    peaks = table("lineitem").select(F.col("l_orderkey").alias("frame"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("nth"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"), F.col("l_discount").alias("inv_ion_mobility"))
    return agg.frames_of_peaks(peaks, frames, (1,)).select("frame", "length", "inv_ion_mobility")


@query(f"select {S} from v_spectra where spectrum_index = (select max(spectrum_index) from v_spectra)", "spectra")
def point_lookup(spectra, _):
    n = spectra.count()
    dense = ix.reindexed(spectra.withColumn("at", F.col("spectrum_index")).withColumn("_g", F.lit(0)), "_g", "at")
    return p.at_index(dense, "at", -1, n).select(*SPECTRUM)


@query("select distinct run_name from v_reads", "spectra", "reads")
def genomic_runs(spectra, reads, _):
    both = split_runs(spectra.select("run_name", F.lit("spectral").alias("modality")).distinct(), reads.select("run_name", F.lit("genomic").alias("modality")).distinct())
    return all_runs(both[1].select("run_name"))


@query(f"select {R}, case when flags % 5 = 0 then 2 when flags % 2 = 0 then 0 else 1 end as kind, least(15, position % 40 * 16 // 40) as bucket from v_reads", "reads")
def mate_classes(reads, _):
    mate = F.when(F.col("flags") % 5 == 0, -1).when(F.col("flags") % 2 == 0, 3).otherwise(4)
    return reads.select(*READ, mate_class(mate, F.lit(3)).alias("kind"), position_bucket(F.col("position") % 40, F.lit(40)).cast("long").alias("bucket"))


@query(f"with t as ({_LONG.replace('from embeddings)', 'from embeddings where vec_id < 40)')}), d as (select j, k, value - avg(value) over (partition by k) as v from t), s as (select a.k as k1, b.k as k2, sum(a.v * b.v) / 39 as sync from d a join d b on a.j = b.j group by 1, 2), h as (select a.j, b.k, sum(case when a.j = b.j then 0 else b.v / (pi() * (b.j - a.j)) end) as t from (select distinct j from d) a, d b group by 1, 2), y as (select a.k as k1, h.k as k2, sum(a.v * t) / 39 as async from d a join h on a.j = h.j group by 1, 2) select k1, k2, round(abs(sync) / (abs(sync) + abs(async)), 6) as disrelation from s join y using (k1, k2)")
def disrelation(table):
    cells = _matrix(table).where("j < 40")
    both = cos.synchronous(cells).join(cos.asynchronous(cells), ["k1", "k2"])
    return cos.disrelation(both).select("k1", "k2", F.round("disrelation", 6).alias("disrelation"))


@query("select a as j1, b as j2, case when a = b then 0 else round(1 / (pi() * (b - a)), 12) end as value from range(30) x(a), range(30) y(b)")
def hilbert_noda(table):
    return cos.hilbert_noda_matrix(table("region").sparkSession, 30).withColumn("value", F.round("value", 12))


@query("select vec_id, cast(floor(4611686018427387904.0 / m) as bigint) as scale, list_transform(q, lambda x, i: x - (case when i = 1 then 0 else q[i - 1] end)) as deltas from (select vec_id, m, list_transform(embedding, lambda x: cast(round_even(cast(x as double) * 100 * floor(4611686018427387904.0 / m), 0) as bigint)) as q from (select vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(cast(x as double) * 100))) as m from embeddings) where m >= 1)")
def fixed_point_deltas(table):
    """Encoded differences and scale of each vector, number by number."""
    from .functions.codecs import numpress_columns

    df = table("embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 100).alias("v")).where(F.array_max(F.transform("v", lambda x: F.abs(x))) >= 1)
    return numpress_columns(df, ("v",)).select("vec_id", F.col("v_scale").alias("scale"), F.col("v_deltas").alias("deltas"))


@query("select p_partkey, concat('0000', '{0}') as x from part where false".replace("{0}", "") + " union all select p_partkey, hex(from_hex(lpad(printf('%x', n), 8, '0'))) as x from (select p_partkey, length(p_brand) as n from part)")
def packed_lengths(table):
    """Length field of packed bases, as it is in the bytes."""
    from .functions.codecs import BYTES, with_bytes

    df = with_bytes(table("part").select("p_partkey", F.col("p_brand").cast("binary").alias("b")), "b", "packed", BYTES["bases"][0])
    return df.select("p_partkey", F.hex(F.substring("packed", 2, 4)).alias("x"))


@query("select o_orderkey, printf('%g', o_totalprice) as g, printf('%.10g', o_totalprice / 7) as g10, case when o_totalprice / 1000 - floor(o_totalprice / 1000) >= 0.5 then floor(o_totalprice / 1000) + 1 else floor(o_totalprice / 1000) end::bigint as whole from orders")
def number_formats(table):
    v = F.col("o_totalprice")
    return table("orders").select("o_orderkey", fn.format_g(v).alias("g"), fn.format_g(v / 7, 10).alias("g10"), fn.half_away(v / 1000).alias("whole"))


@query("select c_custkey, concat('{\"a\":', cast(c_custkey as varchar), ',\"b\":\"', c_name, '\"}') as json from customer")
def canonical_rows(table):
    df = table("customer").select(F.col("c_name").alias("b"), F.col("c_custkey").alias("a"))
    out = fn.with_canonical_json(df)
    return out.select(F.regexp_extract("json", r'"a":(\d+)', 1).cast("long").alias("c_custkey"), "json")


@query("select doc_id, case when regexp_matches(text, '[\t\"\r\n]') then concat('\"', replace(text, '\"', '\"\"'), '\"') else text end as cell, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as xml from documents")
def escaped_cells(table):
    return table("documents").select("doc_id", fn.isa_cell(F.col("text")).alias("cell"), fn.xml_text(F.col("text")).alias("xml"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events")
def iso_times(table):
    return table("events").select("event_id", fn.iso_time(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("at"))


@query("select vec_id, list_transform(range(0, 32), lambda i: cast(embedding[2 * i + 1] as double)) as x, list_transform(range(0, 32), lambda i: cast(embedding[2 * i + 2] as double)) as y, list_transform(embedding[5:14], lambda x: cast(x as double)) as slab from embeddings")
def array_functions(table):
    v = F.col("embedding").cast("array<double>")
    both = fn.interleaved(v)
    return table("embeddings").select("vec_id", both["x"].alias("x"), both["y"].alias("y"), xml.hyperslab(v, 4, 10).alias("slab"))
