"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, chat, decontaminate, secrets, simhash, suffix_dedup, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_secrets": secrets.op2_secrets,
        "op3_chat": chat.op3_chat,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_bpe": bpe.op5_bpe,
        "op6_simhash": simhash.op6_simhash,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_ann": ann.op10_ann,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "op2_secrets": secrets.OP2_SQL,
        "op3_chat": chat.OP3_SQL,
        "op7_decontaminate": decontaminate.OP7_SQL,
        "op9_url_filter": url_filter.OP9_SQL,
    }
