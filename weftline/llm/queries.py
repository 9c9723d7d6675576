"""Queries of the operators on language-model text (P1, P2, P4, P5, P8, P9, P10)."""

from __future__ import annotations

from ..session import table
from . import conversations, credentials, dedup, mix, personal, tokens, truncation

QUERIES = {
    "p1_found": lambda s, d: credentials.secrets_found(table(s, d, "records"), table(s, d, "documents")),
    "p1_redacted": lambda s, d: credentials.redacted(table(s, d, "records"), table(s, d, "documents")),
    "p2_found": lambda s, d: personal.personal_found(table(s, d, "records"), table(s, d, "accounts")),
    "p2_redacted": lambda s, d: personal.redacted(table(s, d, "records"), table(s, d, "accounts")),
    "p4_found": lambda s, d: conversations.dropped(table(s, d, "codex_session")),
    "p4_messages": lambda s, d: conversations.messages(table(s, d, "codex_session")),
    "p5_found": lambda s, d: dedup.duplicates(table(s, d, "manifest_entries")),
    "p5_latest": lambda s, d: dedup.latest_batch(table(s, d, "manifest_entries")),
    "p8_ids": lambda s, d: tokens.encode_documents(table(s, d, "documents")),
    "p9_mix": lambda s, d: mix.mixed(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p9_shares": lambda s, d: mix.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p10_found": lambda s, d: truncation.truncated(table(s, d, "documents")),
    "p10_rates": lambda s, d: truncation.rates(table(s, d, "documents")),
}
SQL: dict[str, str] = {}
