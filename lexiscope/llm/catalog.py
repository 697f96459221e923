"""The driver queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from lexiscope.llm import (
    alignment, chat, decontaminate, langid, licenses, minhash, packing, paragraphs, phrases, quality, simhash, suffix_dedup, warc,
)

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_warc_index": warc.op2_warc_index,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_paragraph_minhash": paragraphs.op4_paragraph_minhash,
    "op5_language_id": langid.op5_language_id,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_minhash_near_dedup": minhash.op12_minhash_near_dedup,
    "op13_phrase_mining": phrases.op13_phrase_mining,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op7_benchmark_decontamination": decontaminate.OP7_SQL.strip(),
    "op13_phrase_mining": phrases.OP13_SQL.strip(),
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
