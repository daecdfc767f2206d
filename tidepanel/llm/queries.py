"""The registered queries of the text operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from . import bpe, chat, decontam, filter_audit, html, neighbours, oracles, quality, secrets, sharding, simhash, spelling, substrings, suffixes

QUERIES = {
    "op1_byte_bpe": bpe.query,
    "op2_html_text": html.query,
    "op3_chat_format": chat.query,
    "op4_neighbours": neighbours.query,
    "op5_shard": sharding.query,
    "op6_simhash": simhash.query,
    "op7_decontaminate": decontam.query,
    "op8_quality": quality.query,
    "op9_substrings": substrings.query,
    "op10_secret_ledger": secrets.query,
    "op11_spelling": spelling.query,
    "op12_filter_audit": filter_audit.query,
    "op13_suffixes": suffixes.query,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": chat.ORACLE,
    "op7_decontaminate": oracles.DECONTAMINATE,
    "op9_substrings": oracles.SUBSTRINGS,
    "op10_secret_ledger": oracles.SECRETS,
    "op11_spelling": spelling.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_suffixes": suffixes.ORACLE,
}
