"""Registered queries of the numbered operators and the SQL that states them, where SQL can."""

from __future__ import annotations

from catalogspark.llm import bpe, chat, extract, language, linededup, merkle, mixing, neardup, passages, periodic, quality, recurrent, spelling, toxicity

QUERIES = {
    "op1_linededup": linededup.op1_linededup,
    "op1_passages": passages.op1_passages,
    "op2_neardup": neardup.op2_neardup,
    "op3_language": language.op3_language,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_language_model": recurrent.op7_language_model,
    "op8_quality": quality.op8_quality,
    "op9_merkle": merkle.op9_merkle,
    "op10_chat": chat.op10_chat,
    "op11_main_text": extract.op11_main_text,
    "op12_spelling": spelling.op12_spelling,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLE = {"op1_linededup": linededup.ORACLE_SQL, "op4_mixing": mixing.ORACLE_SQL, "op8_quality": quality.ORACLE_SQL}
