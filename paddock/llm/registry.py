"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from paddock.llm import chat, decontaminate, dedup, fim, html, pieces, quality, repair, secrets, simhash, topk, toxicity, warc

REGISTRY = {f.__name__: f for f in (
    secrets.op1_secret_scan, topk.op2_topk_search, dedup.op3_minhash_dedup, quality.op4_quality,
    pieces.op5_sentencepiece, chat.op6_chat_formatting, html.op7_html_extraction, toxicity.op8_toxicity, warc.op9_warc,
    decontaminate.op10_decontamination, repair.op11_conversation_repair, simhash.op12_simhash_dedup, fim.op13_fill_in_middle)}

SQL = {"op2_topk_search": topk.OP2_SQL, "op3_minhash_dedup": dedup.OP3_SQL, "op6_chat_formatting": chat.OP6_SQL,
       "op9_warc": warc.OP9_SQL, "op11_conversation_repair": repair.OP11_SQL, "op13_fill_in_middle": fim.OP13_SQL}
