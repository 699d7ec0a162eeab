"""Reading a fine-tuned model's answer (M-4 .. M-6)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from divspark.functions.text import py_strip, whitespace_tokens

# Fixed value: the answer marker of the SFT template (a literal backslash).
ANSWER_MARKER = "[\\INST]"
# Fixed value: second answer words that keep a two-word label.
TWO_WORD_TAILS = ("positive", "negative")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_after_marker(c, marker: str = ANSWER_MARKER) -> Column:
    """M-4 ``r[r.find(marker) + len(marker):].strip()``; a missing marker
    (``find`` = -1) drops the first ``len(marker) - 1`` characters, as in Python."""
    c = _col(c)
    return py_strip(F.substr(c, F.instr(c, marker) + F.lit(len(marker))))


def _drop_last_non_letter(w: Column) -> Column:
    return F.when(F.substr(w, F.lit(-1), F.lit(1)).rlike(r"^\p{L}$"), w).otherwise(
        F.substr(w, F.lit(1), F.length(w) - 1))


def parse_answer(c) -> Column:
    """M-5 ``clean_txt_res``: words 2 and 3 of the answer, each without a
    trailing non-letter; both joined when the second is positive/negative,
    else the first.  Fewer than three words gives null (the exception path)."""
    words = whitespace_tokens(c)
    w1 = _drop_last_non_letter(words[1])
    w2 = _drop_last_non_letter(words[2])
    pick = F.when(w2.isin(*TWO_WORD_TAILS), F.concat(w1, F.lit(" "), w2)).otherwise(w1)
    return F.when(F.size(words) >= 3, pick)


def answer_label(c, names_to_id: Mapping[str, int], default: int = 0) -> Column:
    """M-6 ``get_num_labels``: label id of an answer, unknown (or null) -> ``default``."""
    m = F.create_map(*[e for k, v in names_to_id.items() for e in (F.lit(k), F.lit(int(v)))])
    return F.coalesce(m[_col(c)], F.lit(int(default)))


def answer_is_unknown(c, names_to_id: Mapping[str, int]) -> Column:
    m = F.create_map(*[e for k, v in names_to_id.items() for e in (F.lit(k), F.lit(int(v)))])
    return m[_col(c)].isNull()
