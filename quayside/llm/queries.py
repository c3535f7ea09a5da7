"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quayside.llm import automaton, chat, contexttree, lines, minhash, mixing, quality, transducer, urls, weighted

QUERIES = {
    "op1_near_dedup": minhash.op1_near_dedup,
    "op2_chat_format": chat.op2_chat_format,
    "op3_decontamination": automaton.op3_decontamination,
    "op4_url_filter": urls.op4_url_filter,
    "op5_lm_score": contexttree.op5_lm_score,
    "op6_mixing": mixing.op6_mixing,
    "op7_fingerprints": weighted.op7_fingerprints,
    "op8_token_counts": transducer.op8_token_counts,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_quality": quality.op10_quality,
}
SQL = {"op1_near_dedup": minhash.SQL, "op2_chat_format": chat.SQL, "op3_decontamination": automaton.SQL, "op4_url_filter": urls.SQL, "op6_mixing": mixing.SQL, "op9_line_dedup": lines.SQL}
