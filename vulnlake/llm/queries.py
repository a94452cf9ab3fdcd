"""The registered queries of this package and the SQL each is compared with."""

from __future__ import annotations

from vulnlake.llm import (
    chat, decontaminate, embedding_dedup, jaccard_join, line_dedup, mixing, periodic_runs, pii, suffix_dedup, token_alignment, toxicity,
    url_filter, warc)

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_chat_format": chat.op4_chat_format,
    "op5_warc_round_trip": warc.op5_warc_round_trip,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_personal_data": pii.op9_personal_data,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op5_warc_round_trip": warc.OP5_SQL,
}
