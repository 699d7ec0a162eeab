"""Response parsing and cleaning (P-1 .. P-5, C-5).

One operator, :func:`parse_responses`, turns each raw model response into
``(keys, label, seed, text)`` rows: marker cut -> ``split('\\n')`` -> per-line
rules -> clean -> distinct.  Everything is a built-in expression plus one
``explode``; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from divspark.functions.text import clean_text, py_strip

# Answer markers and the refusal test of the parsers.
LLAMA_MARKER = "[/INST]"
PLATYPUS_MARKER = "Response:"
REFUSAL_SUBSTRING = "paraphr"
INST_SUBSTRING = "inst"
NUMBER_CHARS = ("1", "2", "3")


@dataclass(frozen=True)
class Profile:
    name: str
    marker: str | None          # None: whole response
    keep_marker: bool           # True: cut *from* the marker (kept), else after it
    outer_strip: bool           # strip the text after the cut
    drop_first_line: bool
    strip_lines: bool
    refusal_test: str           # "none" | "numbered" | "all"
    remove_inst: bool
    clean_strip: bool           # strip inside the final clean


PROFILES = {
    # P-1: hosted model; first line kept, only zero-length lines skipped, no strip.
    "gpt": Profile("gpt", None, False, False, False, False, "none", False, False),
    # P-2: Llama 2 chat; refusal test only on numbered lines.
    "llama": Profile("llama", LLAMA_MARKER, False, True, True, True, "numbered", False, True),
    # P-3: Mistral instruct; refusal test on every line, 'inst' removed everywhere.
    "mistral": Profile("mistral", LLAMA_MARKER, False, True, True, True, "all", True, True),
    # P-4: Platypus (atis, fb, sst5); cut from 'Response:', no outer strip, no refusal test.
    "platypus": Profile("platypus", PLATYPUS_MARKER, True, False, True, True, "none", False, True),
    # P-5: Platypus (20news, yelp); outer strip and refusal test on every line.
    "platypus_filtered": Profile("platypus_filtered", PLATYPUS_MARKER, True, True, True, True, "all",
                                 False, True),
}


def _first(c: Column, dtype) -> Column:
    from pyspark.sql.types import ArrayType
    return c[0] if isinstance(dtype, ArrayType) else c


def _cut(r: Column, p: Profile) -> Column:
    if p.marker is None:
        return r
    pos = F.instr(r, p.marker)  # 1-based, 0 when missing (Python find = -1)
    if p.keep_marker:
        # r[find:]; a missing marker leaves only the last character (r[-1:])
        sub = F.when(pos > 0, F.substr(r, pos)).otherwise(F.substr(r, F.lit(-1), F.lit(1)))
    else:
        # r[find + len(marker):]; a missing marker drops len(marker) - 1 characters
        sub = F.substr(r, pos + F.lit(len(p.marker)))
    return py_strip(sub) if p.outer_strip else sub


def response_lines(r: Column, profile: str | Profile) -> Column:
    """The candidate lines of one response, before per-line rules."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    lines = F.split(_cut(r, p), "\n", -1)
    return F.filter(lines, lambda x, i: i >= 1) if p.drop_first_line else lines


def parse_responses(df: DataFrame, profile: str, keys: Sequence[str] = (), *, label: str = "label",
                    seed: str = "seed", response: str = "response", text: str = "text",
                    distinct: bool = True, carry: Sequence[str] = (),
                    remove_inst: bool | None = None) -> DataFrame:
    """P-1 .. P-5 ``filter_responses`` for one profile.

    ``response`` is a string or an array of returned sequences (only the first
    is read, as the scripts do).  Output ``(keys, label, seed, text)``, cleaned
    (lower, strip, dequote, depunctuate), empty texts dropped, distinct.
    ``carry`` columns (e.g. an event time for streaming) are kept and imply
    ``distinct=False``.  ``remove_inst`` overrides the profile's removal of the
    substring ``inst`` (on for ``mistral``, where it turns ``instant`` into
    ``ant``; ``False`` is the plain alternative).
    """
    p = PROFILES[profile]
    if remove_inst is not None:
        from dataclasses import replace
        p = replace(p, remove_inst=remove_inst)
    r = _first(F.col(response), df.schema[response].dataType)
    rows = df.select(*keys, label, seed, *carry, F.explode(response_lines(r, p)).alias("_line"))
    c = py_strip(F.col("_line")) if p.strip_lines else F.col("_line")
    numbered = F.substr(c, F.lit(1), F.lit(1)).isin(*NUMBER_CHARS)
    cut = F.when(numbered, F.substr(c, F.lit(4))).otherwise(c)
    keep = F.length(c) > 0
    if p.refusal_test == "all":
        keep = keep & ~cut.contains(REFUSAL_SUBSTRING)
    elif p.refusal_test == "numbered":
        keep = keep & ~(numbered & cut.contains(REFUSAL_SUBSTRING))
    if p.remove_inst:
        cut = F.replace(cut, F.lit(INST_SUBSTRING), F.lit(""))
    out = (rows.where(keep)
           .select(*keys, label, seed, clean_text(cut, strip=p.clean_strip).alias(text), *carry)
           .where(F.col(text).isNotNull()))
    return out.distinct() if distinct and not carry else out
