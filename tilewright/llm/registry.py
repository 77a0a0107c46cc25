"""Queries and SQL of this package, for the entry module."""

from __future__ import annotations

from tilewright.llm import alignment, bpe, chat, decontaminate, fingerprint, language_id, line_dedup, near_dedup, neighbours, periodic_runs, token_counts, token_store, warc

QUERIES = {
    "op1_token_store": token_store.query,
    "op2_token_counts": token_counts.query,
    "op3_bpe": bpe.query,
    "op4_warc": warc.query,
    "op5_line_dedup": line_dedup.query,
    "op6_language_id": language_id.query,
    "op7_near_dedup": near_dedup.query,
    "op8_decontaminate": decontaminate.query,
    "op9_fingerprint": fingerprint.query,
    "op10_chat": chat.query,
    "op11_alignment": alignment.query,
    "op12_neighbours": neighbours.query,
    "op13_periodic_runs": periodic_runs.query,
}

SQL = {"op4_warc": warc.SQL, "op5_line_dedup": line_dedup.SQL, "op8_decontaminate": decontaminate.SQL, "op10_chat": chat.SQL}
