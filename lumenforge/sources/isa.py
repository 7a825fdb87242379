"""ISA tables and JSON of a dataset: an investigation, a study with a row for each run, an assay file for each run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def cell(text) -> str:
    """Quoted, inner quotes doubled, if it holds a tab, a quote or a line end."""
    text = "" if text is None else str(text)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '\t"\r\n') else text


def _table(rows: list[list]) -> bytes:
    return "".join("\t".join(map(cell, r)) + "\n" for r in rows).encode()


def bundle(runs: DataFrame, title: str = "", investigation: str = "") -> dict[str, bytes]:
    """Files by name. Runs, of which there is a row each, are metadata and are named in order; genomic ones take no part."""
    found = sorted((r.asDict(recursive=True) for r in runs.where("coalesce(modality, '') <> 'genomic'").collect()), key=lambda r: r["run_name"])
    name = investigation or "investigation"
    study = [["Source Name", "Sample Name", "Characteristics[modality]", "Protocol REF", "Assay Name"]]
    out = {}
    assays = []
    for r in found:
        run, instrument = r["run_name"], r.get("instrument") or {}
        study.append([f"source_{run}", r.get("sample_name") or f"sample_{run}", r.get("modality") or "mass spectrometry", "mass spectrometry", run])
        model = instrument.get("model") or ""
        file = f"a_{run}.txt"
        out[file] = _table([["Sample Name", "Protocol REF", "Parameter Value[instrument]", "Parameter Value[ionisation]", "Parameter Value[analyzer]", "MS Assay Name", "Raw Spectral Data File"], [r.get("sample_name") or f"sample_{run}", "mass spectrometry", model, instrument.get("source_type") or "", instrument.get("analyzer_type") or "", run, f"{run}.mzML"]])
        assays.append({"filename": file, "measurementType": {"annotationValue": "metabolite profiling"}, "technologyType": {"annotationValue": "mass spectrometry"}, "dataFiles": [{"name": f"{run}.mzML", "type": "Raw Spectral Data File"}]})
    out["s_study.txt"] = _table(study)
    out["i_investigation.txt"] = _table([["ONTOLOGY SOURCE REFERENCE"], ["INVESTIGATION"], ["Investigation Identifier", name], ["Investigation Title", title], ["STUDY"], ["Study Identifier", name], ["Study Title", title], ["Study File Name", "s_study.txt"], ["STUDY ASSAYS"], ["Study Assay File Name", *[a["filename"] for a in assays]], ["Study Assay Measurement Type", *["metabolite profiling"] * len(assays)], ["Study Assay Technology Type", *["mass spectrometry"] * len(assays)]])
    samples = [{"name": r.get("sample_name") or f"sample_{r['run_name']}"} for r in found]
    whole = {"identifier": name, "title": title, "studies": [{"identifier": name, "title": title, "filename": "s_study.txt", "materials": {"samples": samples}, "assays": assays}]}
    out["investigation.json"] = (json.dumps(whole, indent=2, sort_keys=True) + "\n").encode()
    return out


def write_bundle(files: dict[str, bytes], folder: str) -> None:
    from .files import put

    for name, data in files.items():
        put(f"{folder}/{name}", data)
