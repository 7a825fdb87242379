"""mzTab tables, proteomics (1.0) and metabolomics (2.0.0-M): every section read to identifications, quantifications and
features, and written from them."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import NULLISH, format_g, nullish_int, tsv_cell

IDENTIFICATION = "run_name string, spectrum_index long, chemical_entity string, confidence_score double, evidence_chain array<string>"
QUANTIFICATION = "chemical_entity string, sample_ref string, abundance double, normalization_method string"
FEATURE = "feature_id string, run_name string, chemical_entity string, retention_time_seconds double, exp_mass_to_charge double, charge int, adduct_ion string, abundances map<string, double>, evidence_refs array<string>"


def mztab_lines(spark: SparkSession, path: str) -> DataFrame:
    """prefix, fields and line_no of a file's lines, blanks and comments left out. The file is one row of the scan, since its
    header lines give the columns of those that follow."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where("line <> '' and line not like 'COM%'")
    return lines.select("line_no", F.split("line", "\t").alias("fields")).withColumn("prefix", F.col("fields")[0])


@dataclass
class MzTab:
    """What a file holds; metadata is a dictionary of its MTD lines."""

    metadata: dict[str, str]
    identifications: DataFrame
    quantifications: DataFrame
    features: DataFrame

    @property
    def version(self) -> str:
        return self.metadata.get("mzTab-version", "")

    @property
    def is_metabolomics(self) -> bool:
        return self.version.endswith("-M")

    def provenance(self, source: str, now: int | None = None) -> dict | None:
        """The record of the import; none if the file names neither software, search engine nor run."""
        named = lambda p: [v for k, v in self.metadata.items() if k.startswith(p) and k.split("]")[-1] in ("", "-location")]
        software, engines = named("software["), named("psm_search_engine_score[") + named("search_engine[")
        places = {int(k.split("[")[1].split("]")[0]): v for k, v in self.metadata.items() if k.startswith("ms_run[") and k.endswith("-location")}
        if not (software or engines or places):
            return None
        told = {"mztab_version": self.version, "mztab_description": self.metadata.get("description", ""), "mztab_software": ";".join(software), "mztab_search_engines": ";".join(engines), "mztab_ms_run_locations": ";".join(f"{i}:{v}" for i, v in sorted(places.items()))}
        return {"timestamp_unix": int(time.time()) if now is None else now, "software": "lumenforge mztab importer", "parameters": told, "input_refs": [source, *places.values()], "output_refs": []}


class _Section:
    """Rows of a section by their column names; absent cells and columns read as ''."""

    def __init__(self, lines: DataFrame, header: str, rows: str):
        found = lines.where(F.col("prefix") == header).orderBy("line_no").select("fields").first()
        self.names = list(found[0]) if found else None
        self.rows = lines.where(F.col("prefix") == rows)

    def cell(self, name: str) -> Column:
        return F.coalesce(F.get("fields", F.lit(self.names.index(name))), F.lit("")) if name in self.names else F.lit("")

    def real(self, name: str) -> Column:
        return _real(self.cell(name))

    def numbered(self, pattern: str) -> list[tuple[int, Column]]:
        """(number, cell) of columns name[number]."""
        return [(int(c[len(pattern) + 1 : -1]), F.get("fields", F.lit(i))) for i, c in enumerate(self.names) if c.startswith(pattern + "[") and c.endswith("]") and c[len(pattern) + 1 : -1].isdigit()]


def _real(cell: Column) -> Column:
    return F.when(F.lower(cell).isin(*NULLISH), F.lit(None)).otherwise(cell.try_cast("double"))


def _first(*cells: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cells])


def _lookup(known: dict[int, str], number: Column, default: str) -> Column:
    """The text of a number, else the default with the number after it."""
    other = F.concat(F.lit(default), number.cast("string"))
    if not known:
        return other
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, number), other)


def _reference(metadata: dict[str, str], cell: Column, default: str) -> tuple[Column, Column]:
    """Run and index of a reference such as ms_run[2]:scan=7. A run is the base name of its location, without the last
    extension, else run_N; another text gives the default and 0."""
    runs = {}
    for n, place in _numbers(metadata, "ms_run", "-location").items():
        base = place.rsplit("/", 1)[-1]
        runs[n] = (base.rsplit(".", 1)[0] if "." in base else base) or f"run_{n}"
    at = F.regexp_extract(cell, r"^ms_run\[(\d+)\]:(.+)$", 1)
    number = nullish_int(F.regexp_extract(cell, r"^ms_run\[\d+\]:[^=]*=(.*)$", 1))
    return F.when(at == "", default).otherwise(_lookup(runs, at.try_cast("int"), "run_")), F.coalesce(number, F.lit(0).cast("long"))


def _numbers(metadata: dict[str, str], name: str, end: str) -> dict[int, str]:
    out = {}
    for k, v in metadata.items():
        if k.startswith(name + "[") and k.endswith("]" + end) and k[len(name) + 1 : -len(end) - 1].isdigit():
            out[int(k[len(name) + 1 : -len(end) - 1])] = v
    return out


def _amounts(cells: list[tuple[int, Column]], known: dict[int, str], default: str) -> Column:
    """Sample and value of the numbered cells that hold numbers, as an array of structs in their order."""
    each = [F.struct(_lookup(known, F.lit(n), default).alias("sample"), _real(c).alias("value")) for n, c in cells]
    return F.filter(F.array(*each), lambda e: e["value"].isNotNull()) if each else F.array().cast("array<struct<sample:string,value:double>>")


def _named_evidence(name: Column, formula: Column, entity: Column) -> list[Column]:
    tell = lambda label, c: F.when((c != "") & (c != entity), F.concat(F.lit(label), c))
    return [tell("name=", name), tell("formula=", formula)]


def read_mztab(spark: SparkSession, path: str) -> MzTab:
    """All sections of a file. Rows keep the file's order in the column line_no of each table."""
    lines = mztab_lines(spark, path)
    told = lines.where("prefix = 'MTD' and size(fields) >= 3").orderBy("line_no").select(F.col("fields")[1], F.array_join(F.slice("fields", 3, F.size("fields")), "\t")).collect()
    meta = {r[0]: r[1] for r in told}
    meta["description"], meta["title"] = meta.get("description", meta.get("mzTab-description", "")), meta.get("title", meta.get("mzTab-ID", ""))
    samples, studies = _numbers(meta, "assay", "-sample_ref"), _numbers(meta, "study_variable", "-description")
    section = {h: _Section(lines, h, r) for h, r in (("PSH", "PSM"), ("PRH", "PRT"), ("PEH", "PEP"), ("SMH", "SML"), ("SFH", "SMF"), ("SEH", "SME"))}
    section = {h: s for h, s in section.items() if s.names}
    compact = lambda *cells: F.array_compact(F.array(*cells))
    ids, quants, feats = [], [], []

    if s := section.get("PSH"):
        run, index = _reference(meta, s.cell("spectra_ref"), "imported")
        accession = s.cell("accession")
        entity = F.when(accession.isin("", "null"), s.cell("sequence")).otherwise(accession)
        scores = [F.coalesce(_real(c), F.lit(0.0)) for _, c in s.numbered("search_engine_score")]
        best = F.greatest(F.lit(0.0), *scores) if scores else F.lit(0.0)
        chain = compact(F.nullif(s.cell("search_engine"), F.lit("")), F.when(s.cell("PSM_ID") != "", F.concat(F.lit("PSM_ID="), s.cell("PSM_ID"))))
        ids.append(s.rows.select("line_no", run.alias("run_name"), index.alias("spectrum_index"), entity.alias("chemical_entity"), best.alias("confidence_score"), chain.alias("evidence_chain")).where("chemical_entity <> ''"))
    if s := section.get("PRH"):
        amounts = _amounts(s.numbered("protein_abundance_assay"), samples, "assay_")
        quants.append(s.rows.select("line_no", s.cell("accession").alias("chemical_entity"), F.explode(amounts).alias("a")).where("chemical_entity <> ''"))
    if s := section.get("PEH"):
        run, _ = _reference(meta, s.cell("spectra_ref"), "imported")
        amounts = F.concat(_amounts(s.numbered("peptide_abundance_assay"), samples, "assay_"), _amounts(s.numbered("peptide_abundance_study_variable"), studies, "study_variable_"))
        chain = compact(F.nullif(s.cell("spectra_ref"), F.lit("")))
        feats.append(s.rows.select("line_no", F.lit("pep").alias("kind"), F.lit("").alias("feature_id"), run.alias("run_name"), _first(s.cell("sequence"), s.cell("accession")).alias("chemical_entity"), s.real("retention_time").alias("rt"), s.real("mass_to_charge").alias("mz"), nullish_int(s.cell("charge")).alias("z"), F.lit("").alias("adduct_ion"), amounts.alias("amounts"), chain.alias("evidence_refs")).where("chemical_entity is not null"))
    if s := section.get("SMH"):
        name, formula = s.cell("chemical_name"), s.cell("chemical_formula")
        entity = _first(s.cell("database_identifier"), name, formula)
        ids.append(s.rows.select("line_no", F.lit("metabolomics").alias("run_name"), F.lit(0).cast("long").alias("spectrum_index"), entity.alias("chemical_entity"), F.coalesce(s.real("best_id_confidence_value"), F.lit(0.0)).alias("confidence_score"), compact(*_named_evidence(name, formula, entity)).alias("evidence_chain")).where("chemical_entity is not null"))
        quants.append(s.rows.select("line_no", entity.alias("chemical_entity"), F.explode(_amounts(s.numbered("abundance_study_variable"), studies, "study_variable_")).alias("a")).where("chemical_entity is not null"))
    if s := section.get("SEH"):
        name, formula, own = s.cell("chemical_name"), s.cell("chemical_formula"), s.cell("SME_ID")
        entity = _first(s.cell("database_identifier"), name, formula, own)
        run, index = _reference(meta, s.cell("spectra_ref"), "metabolomics")
        rank = F.coalesce(F.nullif(nullish_int(s.cell("rank")), F.lit(0).cast("long")), F.lit(1).cast("long"))
        evidence = s.rows.select("line_no", own.alias("sme_id"), run.alias("run_name"), index.alias("spectrum_index"), entity.alias("chemical_entity"), F.when(rank > 0, 1.0 / rank).otherwise(0.0).alias("confidence_score"), F.concat(F.array(F.concat(F.lit("SME_ID="), own)), compact(*_named_evidence(name, formula, entity))).alias("evidence_chain")).where("sme_id <> ''")
        ids.append(evidence.drop("sme_id"))
    if s := section.get("SFH"):
        refs = F.filter(F.split(s.cell("SME_ID_REFS"), r"\|"), lambda r: (r != "") & (F.lower(r) != "null"))
        adduct = F.when(F.lower(s.cell("adduct_ion")) == "null", "").otherwise(s.cell("adduct_ion"))
        found = s.rows.select("line_no", F.lit("smf").alias("kind"), s.cell("SMF_ID").alias("feature_id"), F.lit("metabolomics").alias("run_name"), F.coalesce(F.get(refs, F.lit(0)), s.cell("SMF_ID")).alias("chemical_entity"), s.real("retention_time_in_seconds").alias("rt"), s.real("exp_mass_to_charge").alias("mz"), nullish_int(s.cell("charge")).alias("z"), adduct.alias("adduct_ion"), _amounts(s.numbered("abundance_assay"), samples, "assay_").alias("amounts"), refs.alias("evidence_refs")).where("feature_id <> ''")
        if "SEH" in section:
            # Evidence further on in the file names what a feature that refers to it by its id is; of several rows the first.
            e = evidence.groupBy("sme_id", "line_no").agg(F.first("chemical_entity").alias("found")).withColumnRenamed("line_no", "at")
            met = found.select("line_no", "chemical_entity", "evidence_refs").join(e, (F.col("chemical_entity") == F.col("sme_id")) & F.array_contains("evidence_refs", F.col("sme_id")) & (F.col("line_no") < F.col("at")))
            upgraded = met.groupBy("line_no").agg(F.min_by("found", "at").alias("found"))
            found = found.join(upgraded, "line_no", "left").withColumn("chemical_entity", F.coalesce("found", "chemical_entity")).drop("found")
        feats.append(found)

    union = lambda parts, schema: _union(spark, parts, "line_no int, " + schema)
    quants = [q.select("line_no", "chemical_entity", F.col("a.sample").alias("sample_ref"), F.col("a.value").alias("abundance"), F.lit("").alias("normalization_method")) for q in quants]
    shaped = []
    for f in feats:
        from pyspark.sql import Window

        # Peptides have no id of their own: they are numbered, with the features before them.
        number = F.row_number().over(Window.orderBy("line_no")).cast("string")
        values = F.map_from_entries(F.transform(F.array_distinct(F.transform("amounts", lambda a: a["sample"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter("amounts", lambda a: a["sample"] == k), -1)["value"].alias("value"))))
        shaped.append(f.select("line_no", F.when(F.col("kind") == "pep", F.concat(F.lit("pep_"), number)).otherwise(F.concat(F.lit("smf_"), "feature_id")).alias("feature_id"), "run_name", "chemical_entity", F.coalesce("rt", F.lit(0.0)).alias("retention_time_seconds"), F.coalesce("mz", F.lit(0.0)).alias("exp_mass_to_charge"), F.coalesce("z", F.lit(0).cast("long")).cast("int").alias("charge"), "adduct_ion", values.alias("abundances"), "evidence_refs"))
    return MzTab(meta, union(ids, IDENTIFICATION), union(quants, QUANTIFICATION), union(shaped, FEATURE))


def _union(spark, parts: list[DataFrame], schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linked(tables: dict[str, DataFrame], found: MzTab) -> dict[str, DataFrame]:
    """A dataset's tables with what a file brings after what they hold already. Runs stay as they are."""
    out = dict(tables)
    for name, more in (("identifications", found.identifications), ("quantifications", found.quantifications), ("features", found.features)):
        more = more.drop("line_no")
        out[name] = out[name].unionByName(more, allowMissingColumns=True) if name in out else more
    return out


# -- writing --------------------------------------------------------------------------------------------------------------

# Column names of the sections.
PSM_COLUMNS = "PSH sequence PSM_ID accession unique database database_version search_engine search_engine_score[1] modifications retention_time charge exp_mass_to_charge calc_mass_to_charge spectra_ref pre post start end".split()
PRT_COLUMNS = "PRH accession description taxid species database database_version search_engine best_search_engine_score[1] ambiguity_members modifications protein_coverage".split()
PEP_COLUMNS = "PEH sequence accession unique database database_version search_engine best_search_engine_score[1] modifications retention_time charge mass_to_charge uri spectra_ref".split()
SML_COLUMNS = "SMH SML_ID SMF_ID_REFS database_identifier chemical_formula smiles inchi chemical_name uri theoretical_neutral_mass adduct_ions reliability best_id_confidence_measure best_id_confidence_value".split()
SMF_COLUMNS = "SFH SMF_ID SME_ID_REFS SME_ID_REF_ambiguity_code adduct_ion isotopomer exp_mass_to_charge charge retention_time_in_seconds retention_time_in_seconds_start retention_time_in_seconds_end".split()
SME_COLUMNS = "SEH SME_ID evidence_input_id database_identifier chemical_formula smiles inchi chemical_name uri derivatized_form adduct_ion exp_mass_to_charge charge calc_mass_to_charge spectra_ref identification_method ms_level id_confidence_measure[1] rank".split()


def _in_order(df: DataFrame | None) -> DataFrame | None:
    if df is None:
        return None
    return df if "line_no" in df.columns else df.withColumn("line_no", F.monotonically_increasing_id())


def _ordinals(parts: list[tuple[DataFrame, str]]) -> dict[str, int]:
    """Numbers from 1 of names by first appearance, tables one after the other. Names of runs and samples are metadata."""
    out: dict[str, int] = {}
    for df, column in parts:
        for r in df.groupBy(F.col(column).alias("v")).agg(F.min("line_no").alias("n")).orderBy("n", "v").collect():
            out.setdefault(r[0], len(out) + 1)
    return out


def mztab_rows(identifications: DataFrame | None = None, quantifications: DataFrame | None = None, features: DataFrame | None = None, version: str = "1.0", title: str = "", description: str = "", software: tuple[str, ...] = (), ms_run_locations: dict[int, str] | None = None) -> DataFrame:
    """section, nth, value: the lines of a file, in that order. Rows of a section are made where the tables' rows are.

    Of several quantities of an entity and a sample the last by line_no counts; entities come in order of first appearance,
    in version 2.0.0-M also those that are only identified. Without line_no tables are taken as they come.
    """
    if version not in ("1.0", "2.0.0-M"):
        raise ValueError(f"no version {version!r}")
    ids, quants, feats = map(_in_order, (identifications, quantifications, features))
    spark = next(d for d in (ids, quants, feats) if d is not None).sparkSession
    kept = lambda d: d is not None and not d.isEmpty()
    ids, quants, feats = (d if kept(d) else None for d in (ids, quants, feats))
    runs = {f"ms_run[{i}]": i for i in ms_run_locations or {}}
    for name in _ordinals([(d, "run_name") for d in (ids, feats) if d is not None]):
        runs.setdefault(name, len(runs) + 1)
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("sample"))
    if quants is not None:
        quants = quants.withColumn("sample_ref", named("sample_ref"))
    used = [(quants, "sample_ref")] if quants is not None else []
    if feats is not None:
        used.append((feats.select("line_no", F.explode(F.map_keys("abundances")).alias("s")).withColumn("s", named("s")), "s"))
    samples = _ordinals(used)
    cell = lambda t: t.replace("\t", " ").replace("\r", " ").replace("\n", " ")

    head = [f"MTD\tmzTab-version\t{version}", "MTD\tmzTab-mode\tSummary", "MTD\tmzTab-type\tIdentification"]
    head += ["MTD\tmzTab-ID\tlumenforge-export"] if version == "1.0" else []
    head += [f"MTD\t{k}\t{cell(v)}" for k, v in (("title", title), ("description", description)) if v]
    head.append("MTD\tsoftware[1]\t[MS, MS:1000799, custom unreleased software tool, lumenforge]")
    head += [f"MTD\tms_run[{i}]-location\t{(ms_run_locations or {}).get(i, f'file://{n}.mzML')}" for n, i in sorted(runs.items(), key=lambda kv: kv[1])]
    if quants is not None or feats is not None:
        for s, i in samples.items():
            head += [f"MTD\tassay[{i}]-sample_ref\t{cell(s)}", f"MTD\tassay[{i}]-quantification_reagent\t[MS, MS:1002038, unlabeled sample, {cell(s)}]", f"MTD\tassay[{i}]-ms_run_ref\tms_run[1]"]
            head += [f"MTD\tstudy_variable[{i}]-description\t{cell(s)}", f"MTD\tstudy_variable[{i}]-assay_refs\tassay[{i}]"] if version == "2.0.0-M" else []
    head += [f"MTD\tsoftware[{i}]\t[MS, MS:1001456, software analysis, {cell(s)}]" for i, s in enumerate(software, 2)]

    order, parts = sorted(samples, key=samples.get), []
    null, g = F.lit("null"), lambda c: F.coalesce(format_g(c), F.lit("null"))
    text = lambda c: tsv_cell(c if isinstance(c, Column) else F.col(c))
    run = lambda: F.element_at(F.create_map(*[F.lit(x) for kv in runs.items() for x in kv]), F.col("run_name")).cast("string")
    place = lambda index: F.concat(F.lit("ms_run["), run(), F.lit("]:index="), index.cast("string"))
    amounts = lambda m: [g(F.try_element_at(m, F.lit(s))) for s in order]
    numbers = lambda name: [f"{name}[{k}]" for k in range(1, len(order) + 1)]

    def add(section: int, columns: list[str], rows: DataFrame, cells: list[Column]) -> None:
        parts.append(spark.createDataFrame([(section, -1, "\t".join(columns))], "section int, nth long, value string"))
        parts.append(rows.select(F.lit(section).alias("section"), F.col("line_no").cast("long").alias("nth"), F.concat_ws("\t", *cells).alias("value")))
        parts.append(spark.createDataFrame([(section, 1 << 62, "")], "section int, nth long, value string"))

    def by_entity() -> DataFrame:
        out = None
        if quants is not None:
            last = quants.groupBy("chemical_entity", "sample_ref").agg(F.max_by("abundance", "line_no").alias("v"), F.min("line_no").alias("n"))
            out = last.groupBy("chemical_entity").agg(F.map_from_entries(F.collect_list(F.struct("sample_ref", "v"))).alias("m"), F.min("n").alias("line_no"))
        if version == "2.0.0-M" and ids is not None:
            best = ids.groupBy("chemical_entity").agg(F.greatest(F.max("confidence_score"), F.lit(0.0)).alias("best"), F.min("line_no").alias("id_no"))
            if out is None:
                return best.select("chemical_entity", F.create_map().cast("map<string,double>").alias("m"), F.col("id_no").alias("line_no"), "best")
            # Quantified entities come first, then those that are only identified.
            out = out.join(best, "chemical_entity", "full").withColumn("line_no", F.coalesce("line_no", F.col("id_no") + F.lit(1 << 40)))
            return out.withColumn("m", F.coalesce("m", F.create_map().cast("map<string,double>"))).drop("id_no")
        return None if out is None else out.withColumn("best", F.lit(None).cast("double"))

    if version == "1.0":
        if ids is not None:
            numbered = _numbered(ids)
            engine = F.coalesce(F.get("evidence_chain", F.lit(0)), F.lit("[MS, MS:1001083, mascot, ]"))
            add(1, PSM_COLUMNS, numbered, [F.lit("PSM"), F.lit(""), F.col("number").cast("string"), text("chemical_entity"), null, null, null, text(engine), format_g(F.col("confidence_score")), null, null, null, null, null, place(F.col("spectrum_index")), null, null, null, null])
        if quants is not None:
            add(2, PRT_COLUMNS + numbers("protein_abundance_assay"), by_entity(), [F.lit("PRT"), text("chemical_entity"), F.lit(""), *[null] * 9, *amounts(F.col("m"))])
        if feats is not None:
            first = F.coalesce(F.get("evidence_refs", F.lit(0)), place(F.lit(0)))
            add(3, PEP_COLUMNS + numbers("peptide_abundance_assay"), feats, [F.lit("PEP"), text("chemical_entity"), *[null] * 7, format_g(F.col("retention_time_seconds")), F.col("charge").cast("string"), format_g(F.col("exp_mass_to_charge")), null, text(first), *amounts(F.col("abundances"))])
    else:
        both = by_entity()
        if both is not None:
            pairs = [x for k in range(1, len(order) + 1) for x in (f"abundance_study_variable[{k}]", f"abundance_variation_study_variable[{k}]")]
            filled = [x for a in amounts(F.col("m")) for x in (a, null)]
            add(1, SML_COLUMNS + pairs, _numbered(both), [F.lit("SML"), F.col("number").cast("string"), null, text("chemical_entity"), *[null] * 7, F.lit("1"), F.lit("[MS, MS:1001090, null, ]"), format_g(F.coalesce("best", F.lit(0.0))), *filled])
        if feats is not None:
            refs = F.when(F.size("evidence_refs") > 0, F.array_join("evidence_refs", "|")).otherwise("null")
            add(2, SMF_COLUMNS + numbers("abundance_assay"), feats, [F.lit("SMF"), text("feature_id"), text(refs), null, F.coalesce(F.nullif(text("adduct_ion"), F.lit("")), null), null, format_g(F.col("exp_mass_to_charge")), F.col("charge").cast("string"), format_g(F.col("retention_time_seconds")), null, null, *amounts(F.col("abundances"))])
        if feats is not None and ids is not None:
            told = lambda label: F.get(F.transform(F.filter("evidence_chain", lambda e: e.startswith(label)), lambda e: F.substring(e, F.lit(len(label) + 1), F.length(e))), F.lit(0))
            score = F.col("confidence_score")
            rank = F.when(score > 0, F.greatest(F.lit(1.0), F.rint(F.when(score <= 1, 1.0 / score).otherwise(1.0)))).otherwise(1.0).cast("int").cast("string")
            own = F.coalesce(told("SME_ID="), F.concat(F.lit("sme_"), F.col("number").cast("string")))
            add(3, SME_COLUMNS, _numbered(ids), [F.lit("SME"), text(own), null, text("chemical_entity"), F.coalesce(text(told("formula=")), null), null, null, F.coalesce(text(told("name=")), null), *[null] * 6, place(F.col("spectrum_index")), null, null, null, rank])
    out = spark.createDataFrame([(0, i, line) for i, line in enumerate([*head, ""])], "section int, nth long, value string")
    for p in parts:
        out = out.unionByName(p)
    return out


def _numbered(df: DataFrame) -> DataFrame:
    """df with number, from 1 by line_no; the rows are ranked within blocks."""
    from ..operators.index import reindexed

    held = df.withColumn("_all", F.lit(0)).withColumn("number", F.col("line_no").cast("long"))
    return reindexed(held, "_all", "number").withColumn("number", F.col("number") + 1).drop("_all")


def write_mztab(path: str, **tables) -> None:
    """Writes the file as text parts in order; with few rows it is one part."""
    mztab_rows(**tables).orderBy("section", "nth").select("value").coalesce(1).write.mode("overwrite").text(path)
