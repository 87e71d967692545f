"""The queries of this subpackage: name to (query, SQL where SQL can express it)."""

from __future__ import annotations

from helixloom.llm import chat_format, code_search, edit_counts, html_text, mixing, packing, pii, quality, simhash, token_files


def registered() -> dict:
    return {
        "op1_mix": (mixing.op1_mix, None),
        "op2_chat_format": (chat_format.op2_chat_format, chat_format.OP2_SQL),
        "op3_quality": (quality.op3_quality, None),
        "op4_simhash": (simhash.op4_simhash, None),
        "op5_html_text": (html_text.op5_html_text, None),
        "op6_pack": (packing.op6_pack, None),
        "op7_token_files": (token_files.op7_token_files, None),
        "op8_pii": (pii.op8_pii, None),
        "op9_edit_counts": (edit_counts.op9_edit_counts, None),
        "op10_code_search": (code_search.op10_code_search, code_search.OP10_SQL),
    }
