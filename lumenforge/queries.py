"""A registered query for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .dataset import all_runs, runs_with_input
from .functions import text as fn
from .operators import aggregate as agg, anonymize as anon, correlation as cos, index as ix
from .plans import predicates as p
from .views import view, with_views

QUERIES, ORACLE_SQL = {}, {}
SPECTRUM = ("run_name", "spectrum_index")
READ = ("run_name", "read_index")


def query(sql: str | None = None, *views: str):
    """Registers a function of the views and a reader of tables, by its name, with SQL over v_<view>."""

    def add(f):
        def run(spark, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, v) for v in views], lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


S, R = ", ".join(SPECTRUM), ", ".join(READ)
#: Closed regions that are masked, the last one open-ended.
REGIONS = [("R", 500, 510), ("R", 509, 600), ("A", 0, 4), ("N", 1999, 9 * 10**18)]


@query(f"select {S} from v_spectra where ms_level = 2 and retention_time between 1000.0 and 9000000.0 and precursor_mz between 5.0 and 80.0 and base_peak_intensity >= 10", "spectra")
def spectrum_query(spectra, _):
    q = p.Query().with_ms_level(2).with_retention_time_range(1000.0, 9e6).with_precursor_mz_range(5.0, 80.0).with_base_peak_intensity_at_least(10.0)
    return q.matching_indices(spectra, SPECTRUM)


@query(f"select {S} from v_spectra where retention_time between 0.0 and 500000.0", "spectra")
def retention_time_range(spectra, _):
    return p.Query().with_retention_time_range(0.0, 5e5).on(spectra).select(*SPECTRUM)


@query(f"select {S} from v_spectra where ms_level = 1", "spectra")
def ms_level(spectra, _):
    return p.Query().with_ms_level(1).on(spectra).select(*SPECTRUM)


@query(f"select {S} from v_spectra where polarity = -1", "spectra")
def polarity(spectra, _):
    return p.Query().with_polarity(1).with_polarity(-1).on(spectra).select(*SPECTRUM)


@query(f"select {S} from v_spectra where precursor_mz between 0.0 and 12.5", "spectra")
def precursor_range_with_sentinel(spectra, _):
    return p.Query().with_precursor_mz_range(0.0, 12.5).on(spectra).select(*SPECTRUM)


@query(f"select {S} from v_spectra where base_peak_intensity >= 40", "spectra")
def base_peak_threshold(spectra, _):
    return p.Query().with_base_peak_intensity_at_least(40.0).on(spectra).select(*SPECTRUM)


@query(f"select {R} from v_reads where chromosome = 'R' and position >= 100 and position < 900", "reads")
def genomic_region(reads, _):
    return reads.where(p.in_region("R", 100, 900)).select(*READ)


@query(f"select {R} from v_reads where (flags & 4) <> 0", "reads")
def unmapped_reads(reads, _):
    return reads.where(p.unmapped()).select(*READ)


@query(f"select {R} from v_reads where (flags & 17) <> 0", "reads")
def flag_mask(reads, _):
    return reads.where(p.has_flag(0x11)).select(*READ)


@query(f"select {R}, (flags & 4) = 0 as is_mapped, (flags & 1) <> 0 as is_paired, (flags & 16) <> 0 as is_reverse, (flags & 256) <> 0 as is_secondary, (flags & 2048) <> 0 as is_supplementary from v_reads", "reads")
def read_flags(reads, _):
    return p.with_read_flags(reads).select(*READ, "is_mapped", "is_paired", "is_reverse", "is_secondary", "is_supplementary")


@query("select dataset_id, event_id from v_spectra where ms_level = 2 and not (retention_time < 1000.0) and not (precursor_mz > 60.0) and dataset_id = 2", "spectra")
def unit_filter(spectra, _):
    raw = '{"type": "query", "filters": {"rt_min": 1000.0, "ms_level": 2, "precursor_mz_max": 60.0, "dataset_id": 2}}'
    return p.UnitFilter.parse(raw).on(spectra).select("dataset_id", "event_id")


@query("select dataset_id, au_sequence from (select *, spectrum_index as au_sequence from v_spectra) where ms_level = 2 order by 1, 2 limit 100", "spectra")
def unit_filter_capped(spectra, _):
    return p.UnitFilter(ms_level=2, max_au=100).on(spectra.withColumn("au_sequence", F.col("spectrum_index"))).select("dataset_id", "au_sequence")


@query(f"select {R} from v_reads where chromosome = 'N' and position between 500 and 700", "reads")
def unit_filter_genomic(reads, _):
    units = reads.withColumn("spectrum_class", F.lit(5))
    return p.UnitFilter(chromosome="N", position_min=500, position_max=700).on(units).select(*READ)


@query("select distinct run_name from v_provenance where role = 'system'", "provenance")
def runs_for_sample(prov, _):
    records = prov.groupBy("run_name", "turn").agg(F.collect_list("role").alias("input_refs"))
    return runs_with_input(prov.select("run_name").distinct(), records, "system")


@query(f"select {S} from v_spectra where spectrum_index >= 10 and spectrum_index < 25", "spectra")
def objects_in_range(spectra, _):
    return p.objects_in_range(spectra, "spectrum_index", 10, 25).select(*SPECTRUM)


@query(f"select {S}, case when precursor_mz <> 0 then precursor_mz - 0.5 end as lower_bound, case when precursor_mz <> 0 then precursor_mz + 0.75 end as upper_bound, case when precursor_mz <> 0 then cast(1.25 as double) end as width from v_spectra", "spectra")
def isolation_window(spectra, _):
    off = lambda v: F.when(F.col("precursor_mz") != 0, F.lit(v)).otherwise(0.0)
    s = spectra.withColumns({"isolation_target_mz": F.col("precursor_mz"), "isolation_lower_offset": off(0.5), "isolation_upper_offset": off(0.75)})
    return s.withColumn("w", p.isolation_window()).select(*SPECTRUM, "w.lower_bound", "w.upper_bound", "w.width")


@query(f"select {R}, cast(coalesce(sum(length) over (partition by run_name order by read_index rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from v_reads", "reads")
def offsets(reads, _):
    return ix.with_offsets(reads, "run_name", "read_index").select(*READ, "offset")


@query(f"select {R}, position - coalesce(lag(position) over (partition by run_name order by read_index), 0) as delta from v_reads", "reads")
def first_differences(reads, _):
    return ix.first_differences(reads, "run_name", "read_index", "position").select(*READ, "delta")


@query("select dataset_id, event_id from (select *, max(event_id) over (partition by dataset_id order by arrival rows between unbounded preceding and 1 preceding) as most from (select *, event_id * 7919 % 1000003 as arrival from v_spectra)) where event_id <= most", "spectra")
def sequence_violations(spectra, _):
    return ix.sequence_violations(spectra.withColumn("arrival", F.col("event_id") * 7919 % 1000003), sequence="event_id").select("dataset_id", "event_id")


@query(f"select {S}, last_value(case when ms_level = 1 then base_peak_intensity end ignore nulls) over (partition by run_name order by spectrum_index rows between unbounded preceding and 1 preceding) as last_ms1_peak from v_spectra", "spectra")
def last_ms1_peak(spectra, _):
    return ix.carry_forward(spectra, "run_name", "spectrum_index", F.when(F.col("ms_level") == 1, F.col("base_peak_intensity")), "last_ms1_peak").select(*SPECTRUM, "last_ms1_peak")


@query("select run_name, chromosome, first_position, row_number() over (partition by run_name order by first_position) - 1 as ordinal from (select run_name, chromosome, min(read_index) as first_position from v_reads group by 1, 2)", "reads")
def chromosome_order(reads, _):
    return ix.encounter_order(reads, "chromosome", "read_index", "run_name")


@query(f"select {R}, case when row_number() over (partition by run_name, read_name order by read_index) > 1 then concat(read_name, '#', cast(read_index as varchar)) else read_name end as unique_name from v_reads", "reads")
def unique_read_names(reads, _):
    return ix.unique_names(reads, "read_name", "read_index", "run_name").select(*READ, "unique_name")


@query(
    "select run_name, row_number() over (partition by run_name order by spectrum_index) - 1 as spectrum_index, event_id from v_spectra s where not exists (select 1 from v_ids i where i.run_name = s.run_name and i.spectrum_index = s.spectrum_index and chemical_entity like '%URGENT%')",
    "spectra",
    "ids",
)
def redact_variants(spectra, ids, _):
    marked = ids.withColumn("chemical_entity", F.when(F.col("chemical_entity").contains("URGENT"), "p.Ala1Thr saav").otherwise(F.col("chemical_entity")))
    return anon.redact_variants(spectra, marked).select(*SPECTRUM, "event_id")


@query("select i.id from v_ids i join (select run_name, count(*) as n from v_spectra where ms_level = 2 group by 1) k on i.run_name = k.run_name and i.spectrum_index < k.n", "spectra", "ids")
def kept_identifications(spectra, ids, _):
    return anon.kept_identifications(ids, spectra.where("ms_level = 2")).select("id")


@query("select distinct run_name, spectrum_index from v_ids where chemical_entity in ('1-URGENT', '2-HIGH')", "ids")
def rare_spectra(ids, _):
    table = ids.sparkSession.createDataFrame([("1-URGENT", 0.01), ("2-HIGH", 0.02), ("5-LOW", 0.5)], "chemical_entity string, prevalence double")
    return anon.rare_spectra(ids, table)


@query("select vec_id, list_transform(embedding, lambda x: round_even(cast(x as double) * 100.0, 0) / 100.0) as coarse from embeddings")
def coarsen(table):
    return table("embeddings").select("vec_id", anon.coarsen(F.col("embedding").cast("array<double>"), 2).alias("coarse"))


@query("select e.vec_id, list_transform(embedding, lambda x: case when cast(x as double) < q.thr then 0.0::double else cast(x as double) end) as masked from embeddings e join (select vec_id, quantile_cont(cast(v as double), 0.5) as thr from (select vec_id, unnest(embedding) as v from embeddings) group by 1) q on e.vec_id = q.vec_id")
def mask_below_quantile(table):
    return table("embeddings").select("vec_id", anon.mask_below_quantile(F.col("embedding").cast("array<double>"), 0.5).alias("masked"))


@query(f"select {R}, case when regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') then cast(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: cast(x as bigint))) as bigint) else 0 end as span from v_reads", "reads")
def cigar_span(reads, _):
    return reads.select(*READ, anon.reference_span(F.col("cigar")).alias("span"))


@query(
    f"select {R} from v_reads r where exists (select 1 from (values ('R', 500, 510), ('R', 509, 600), ('A', 0, 4), ('N', 1999, 9000000000000000000)) m(c, s, e) where m.c = r.chromosome and not (r.position + r.length - 1 < m.s or r.position > m.e))",
    "reads",
)
def reads_in_mask_regions(reads, _):
    regions = reads.sparkSession.createDataFrame(REGIONS, "chromosome string, start long, end long")
    return anon.reads_in_regions(reads, regions).select(*READ)


@query("select vec_id, cast(len(embedding) as bigint) as n, coalesce(list_max(embedding), 0) as base_peak from embeddings")
def base_peaks(table):
    return table("embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), agg.base_peak(F.col("embedding").cast("array<double>")).cast("float").alias("base_peak"))


@query("select o_orderkey as frame, cast(count(l_orderkey) as bigint) as length, coalesce(max(l_quantity), 0) as base_peak_intensity, coalesce(list(l_extendedprice order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) filter (where l_orderkey is not null), []) as mz, coalesce(list(l_quantity order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) filter (where l_orderkey is not null), []) as intensity from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def frames_with_peaks(table):
    frames = table("orders").select(F.col("o_orderkey").alias("frame"))
    peaks = table("lineitem").select(F.col("l_orderkey").alias("frame"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("nth"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").cast("double").alias("intensity"))
    return agg.pack_frames(frames, peaks, "frame", "nth").select("frame", "length", "base_peak_intensity", "mz", "intensity")


_LAST = "arg_max(l_extendedprice, (l_orderkey % 1000) * 100000000000 + l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey) filter (where l_returnflag = '{0}') as \"{0}\""


@query("select p_brand as chemical_entity, " + ", ".join(_LAST.format(x) for x in "ANR") + " from lineitem join part on p_partkey = l_partkey group by 1")
def abundance_pivot(table):
    """Values are written in an order of their own, so the last one of an entity isn't the largest."""
    order = (F.col("l_orderkey") % 1000) * 100000000000 + F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_suppkey")
    q = table("lineitem").join(F.broadcast(table("part").select("p_partkey", "p_brand")), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("chemical_entity"), F.col("l_returnflag").alias("sample_ref"), F.col("l_extendedprice").alias("abundance"), order.alias("written"))
    return agg.abundance_pivot(q, ["A", "N", "R"], "written")


@query("select chemical_entity, greatest(max(confidence_score), 0) as best_confidence from v_ids group by 1", "ids")
def best_confidence(ids, _):
    return agg.best_confidence(ids)


@query("select count(*) as frames, count(*) filter (where ms_level = 1) as ms1, count(*) filter (where ms_level = 2) as ms2, min(retention_time) as rt_min, max(retention_time) as rt_max from v_spectra", "spectra")
def frame_statistics(spectra, _):
    return agg.frame_statistics(spectra)


@query(f"select {R}, row_number() over (partition by run_name order by f, position, read_index) - 1 as sort_rank from (select *, min(read_index) over (partition by run_name, chromosome) as f from v_reads)", "reads")
def coordinate_sort(reads, _):
    return ix.coordinate_sorted(reads).select(*READ, "sort_rank")


@query("select distinct run_name from v_spectra union select distinct run_name from v_reads where run_name not in (select run_name from v_spectra)", "spectra", "reads")
def all_runs_union(spectra, reads, _):
    return all_runs(spectra.select("run_name").distinct(), reads.select("run_name").distinct())


@query("select run_name, arg_max(spectrum_index, (base_peak_intensity, -spectrum_index)) as top_index, max(base_peak_intensity) as top from v_spectra group by 1", "spectra")
def largest_peak(spectra, _):
    return agg.largest_by(spectra, "run_name", "spectrum_index", "base_peak_intensity")


_LONG = "select vec_id as j, cast(k as bigint) as k, cast(e as double) as value from (select vec_id, unnest(embedding) as e, unnest(range(0, 64)) as k from embeddings)"


def _matrix(table):
    return table("embeddings").select(F.col("vec_id").alias("j"), F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "value")).withColumn("k", F.col("k").cast("long"))


@query(f"with t as ({_LONG}), d as (select j, k, value - avg(value) over (partition by k) as v from t) select a.k as k1, b.k as k2, round(sum(a.v * b.v) / ((select count(*) from embeddings) - 1), 7) as sync from d a join d b on a.j = b.j group by 1, 2")
def correlation_sync(table):
    return cos.synchronous(_matrix(table)).withColumn("sync", F.round("sync", 7))


@query(f"with t as ({_LONG}), d as (select j, k, value - avg(value) over (partition by k) as v from t), h as (select a.j, b.k, sum(case when a.j = b.j then 0 else b.v / (pi() * (b.j - a.j)) end) as t from (select distinct j from d) a, d b group by 1, 2) select a.k as k1, h.k as k2, round(sum(a.v * t) / ((select count(*) from embeddings) - 1), 7) + 0.0 as async from d a join h on a.j = h.j group by 1, 2")
def correlation_async(table):
    return cos.asynchronous(_matrix(table)).withColumn("async", F.round("async", 7) + 0.0)


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when q <= 1 then 0 when q <= 9 then 5 when q <= 19 then 15 when q <= 24 then 22 when q <= 29 then 27 when q <= 34 then 32 when q <= 39 then 37 else 40 end as bin from (select *, cast(l_quantity as integer) as q from lineitem)")
def quality_bins(table):
    return table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", anon.bin_quality(F.col("l_quantity").cast("int")).alias("bin"))


@query("select page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', ''), ''), 'run_1') as run_name from pages")
def run_name_of_location(table):
    return table("pages").select("page_id", fn.run_name_of(F.col("url"), "run_1").alias("run_name"))


@query("select doc_id, regexp_replace(translate(text, '\t\r\n', '   '), ' $', '') as line, md5(text) as digest, base64(encode(text)) as b64 from documents")
def text_cells(table):
    return table("documents").select("doc_id", F.regexp_replace(fn.tsv_cell(F.col("text")), " $", "").alias("line"), F.md5(F.col("text").cast("binary")).alias("digest"), F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "").alias("b64"))


@query("select o_orderkey, cast(case when trim(lower(s)) in ('', 'null', 'na', 'n/a', 'nan') then null else try_cast(s as double) end as double) as value from (select o_orderkey, case o_orderkey % 4 when 0 then 'N/A' when 1 then cast(o_orderkey as varchar) when 2 then 'x' else '' end as s from orders)")
def nullish_numbers(table):
    k = F.col("o_orderkey")
    s = F.when(k % 4 == 0, "N/A").when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, "x").otherwise("")
    return table("orders").select("o_orderkey", fn.nullish_double(s).alias("value"))


@query("select doc_id, cast(length(text) as bigint) as n from documents")
def codec_round_trip(table):
    """Texts packed as bases and decoded again, and entropy-coded: the codecs lose nothing."""
    from .functions.codecs import BYTES, with_bytes

    df = table("documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)  # coding takes far longer than the move
    (pack, unpack), (code, decode) = BYTES["bases"], BYTES["rans"]
    df = with_bytes(df, "raw", "whole", pack, code, decode, unpack)
    return df.where("raw = whole").select("doc_id", F.length(F.col("whole").cast("string")).cast("long").alias("n"))


@query(f"select dataset_id, spectrum_index as au_sequence, ms_level, polarity, retention_time, precursor_mz, base_peak_intensity from v_spectra where ms_level = 2 and not (retention_time > 9000000.0)", "spectra")
def packet_round_trip(spectra, _):
    """Access units written as packets, read from the wire again, and filtered on their keys."""
    from .streaming.packets import parse_units, read_packets, write_units

    packets = write_units(spectra.withColumn("au_sequence", F.col("spectrum_index")))
    units = parse_units(read_packets(packets, "packet"))
    return p.UnitFilter(ms_level=2, rt_max=9e6).on(units).select("dataset_id", "au_sequence", "ms_level", "polarity", "retention_time", "precursor_mz", "base_peak_intensity")


@query(f"select {R}, length as n from v_reads", "reads")
def sealed_round_trip(reads, _):
    """Row-wise AES-GCM with the row's place as authenticated data, sealed and opened again."""
    from .functions.protect import aad, seal, unseal

    key, place = F.unhex(F.lit("00112233445566778899aabbccddeeff" * 2)), aad(F.lit(1), F.col("read_index"), F.lit("length"))
    sealed = reads.withColumn("sealed", seal(F.col("length").cast("string").cast("binary"), key, place))
    return sealed.select(*READ, unseal(F.col("sealed"), key, place).cast("string").cast("long").alias("n"))
