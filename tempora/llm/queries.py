"""The registered text queries, with oracle SQL where SQL can say the same."""

from __future__ import annotations

from . import decontam, fillmiddle, htmltext, langid, linededup, minhash, mixing, periodic, quality, spotsigs, suffixdedup, toxicity, triejoin

_ALL = {
    "op1_minhash": (minhash.query, minhash.SQL),
    "op2_spotsigs": (spotsigs.query, spotsigs.SQL),
    "op3_decontaminate": (decontam.query, decontam.SQL),
    "op4_suffix_dedup": (suffixdedup.query, suffixdedup.SQL),
    "op5_language": (langid.query, None),
    "op6_curriculum_mix": (mixing.query, mixing.SQL),
    "op7_html_text": (htmltext.query, None),
    "op8_toxicity": (toxicity.query, None),
    "op9_quality": (quality.query, None),
    "op10_line_dedup": (linededup.query, None),
    "op11_ngram_join": (triejoin.query, triejoin.SQL),
    "op12_fill_middle": (fillmiddle.query, fillmiddle.SQL),
    "op13_periodic_runs": (periodic.query, periodic.SQL),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
