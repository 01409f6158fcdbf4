"""The queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

import corpus_pipeline

from . import kdfilter, linededup, media, merkle, mixing, pieces, pii, quality, simhash, substrings, suffixes, tokenids, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_pieces": pieces.op3_pieces,
    "op4_quality": quality.op4_quality,
    "op5_substrings": substrings.op5_substrings,
    "op6_pii": pii.op6_pii,
    "op7_warc": warc.op7_warc,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_ids": tokenids.op9_token_ids,
    "op10_media": media.op10_media,
    "op11_line_dedup": linededup.op11_line_dedup,
    "op12_merkle": merkle.op12_merkle,
    "op13_clusters": kdfilter.op13_clusters,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op2_suffix_dedup": suffixes.ORACLE_SQL,
    "op5_substrings": substrings.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op11_line_dedup": linededup.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_clusters": kdfilter.ORACLE_SQL,
}
