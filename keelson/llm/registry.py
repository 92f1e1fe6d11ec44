"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from keelson.llm import byte_bpe, exact_dedup, packing, repeats, simhash, token_files, tool_calls, topk, toxicity, warc_zip


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_repeats": repeats.op2_repeats,
        "op3_warc_zip": warc_zip.op3_warc_zip,
        "op4_tool_calls": tool_calls.op4_tool_calls,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_packing": packing.op6_packing,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_simhash": simhash.op8_simhash,
        "op9_topk": topk.op9_topk,
        "op10_token_files": token_files.op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op3_warc_zip": warc_zip.OP3_SQL, "op4_tool_calls": tool_calls.OP4_SQL, "op9_topk": topk.OP9_SQL}
