"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact, langid, lines, mixing, secrets, sharding, simhash, transcripts, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_secret_grammar": secrets.op2_secret_grammar,
    "op3_line_minhash": lines.op3_line_minhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash_anchors": simhash.op5_simhash_anchors,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_chunk_recipes": exact.op7_chunk_recipes,
    "op8_transcripts": transcripts.op8_transcripts,
    "op9_shards": sharding.op9_shards,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL = {
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_chunk_recipes": exact.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
}
