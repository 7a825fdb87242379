"""Tables of a measurement dataset, and the integer enumerations their columns hold."""

from __future__ import annotations

from enum import IntEnum


class Polarity(IntEnum):
    UNKNOWN = 0
    POSITIVE = 1
    NEGATIVE = -1


class ChromatogramType(IntEnum):
    TIC = 0
    XIC = 1
    SRM = 2


#: SAM flag bits.
PAIRED, UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 0x1, 0x4, 0x10, 0x100, 0x800
#: Spectrum class of genomic access units on the wire.
GENOMIC_CLASS = 5

TABLES = {
    "runs": "run_name string, modality string, spectrum_class string, acquisition_mode int, nucleus_type string, channel_names array<string>, instrument struct<manufacturer: string, model: string, serial_number: string, source_type: string, analyzer_type: string, detector_type: string>, reference_uri string, platform string, sample_name string, dataset_id int, spectrum_count long",
    "spectra": "run_name string, spectrum_index long, length long, retention_time double, ms_level int, polarity int, precursor_mz double, precursor_charge int, base_peak_intensity double, activation_method int, isolation_target_mz double, isolation_lower_offset double, isolation_upper_offset double, mz array<double>, intensity array<double>, extra map<string, array<double>>",
    "reads": "run_name string, read_index long, read_name string, chromosome string, position long, mapq int, flags long, cigar string, seq string, qual binary, mate_chromosome string, mate_position long, template_length int, length long",
    "chromatograms": "run_name string, name string, chromatogram_type int, target_mz double, precursor_mz double, product_mz double, time array<double>, intensity array<double>",
    "identifications": "run_name string, spectrum_index long, chemical_entity string, confidence_score double, evidence_chain array<string>",
    "quantifications": "chemical_entity string, sample_ref string, abundance double, normalization_method string",
    "features": "feature_id string, run_name string, chemical_entity string, retention_time_seconds double, exp_mass_to_charge double, charge int, adduct_ion string, abundances map<string, double>, evidence_refs array<string>",
    "provenance": "run_name string, seq long, timestamp_unix long, software string, parameters map<string, string>, input_refs array<string>, output_refs array<string>",
    "transitions": "precursor_mz double, product_mz double, collision_energy double, rt_start double, rt_end double",
    "pixels": "image_id string, x int, y int, z int, intensity array<double>",
    "reference_seqs": "uri string, chromosome string, seq string, length long",
}
#: Columns the tables are laid out by, so that a run or a chromosome is a directory a filter prunes.
LAYOUT = {"spectra": ["run_name"], "reads": ["run_name", "chromosome"]}
