"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from quarrylog.llm import chat, decontam, embed_dedup, langid, license_scan, mixing, ngram_join, reshard, token_align, toxicity, url_filter, warc, word_runs

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_language_id": langid.op3_language_id,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_embedding_dedup": embed_dedup.op5_embedding_dedup,
    "op6_chat": chat.op6_chat,
    "op7_warc": warc.op7_warc,
    "op8_mixing": mixing.op8_mixing,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_alignment": token_align.op11_token_alignment,
    "op12_resharding": reshard.op12_resharding,
    "op13_word_runs": word_runs.op13_word_runs,
}
SQL = {"op1_ngram_join": ngram_join.OP1_SQL, "op4_decontaminate": decontam.OP4_SQL, "op5_embedding_dedup": embed_dedup.OP5_SQL, "op8_mixing": mixing.OP8_SQL}
