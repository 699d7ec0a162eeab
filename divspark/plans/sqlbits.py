"""SQL text snippets for the oracles, mirroring ``divspark.functions.text``.

RE2 classes are ASCII; the driver's tables hold only space and newline as
whitespace, so ``\\s`` agrees with Python's ``str.strip`` / ``str.split`` there.
"""

from __future__ import annotations

from divspark.functions.text import _WS_CLASS, ASCII_PUNCTUATION, PY_WHITESPACE, default_stop_words


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PUNCT = lit(ASCII_PUNCTUATION)


def strip(x: str) -> str:
    return f"trim({x}, {lit(PY_WHITESPACE)})"


def clean(x: str, *, lowercase=True, do_strip=True, dequote=True, depunct=True, nullify=True) -> str:
    e = x
    if lowercase:
        e = f"lower({e})"
    if do_strip:
        e = strip(e)
    if dequote:
        e = f"translate({e}, '\"', '')"
    if depunct:
        e = f"translate({e}, {PUNCT}, '')"
    return f"nullif({e}, '')" if nullify else e


def stop_list() -> str:
    return "[" + ", ".join(lit(w) for w in default_stop_words()) + "]"


def ws_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_WS_CLASS}+'), lambda w: w <> '')"


def no_stop_tokens(x: str) -> str:
    return (f"list_filter(string_split_regex({x}, '{_WS_CLASS}+'), "
            f"lambda w: w <> '' AND NOT list_contains({stop_list()}, w))")


def word_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def order_key(x: str, salt: str, *parts: str) -> str:
    lead = "".join(f" || coalesce(CAST({p} AS VARCHAR), '') || ':'" for p in parts)
    return f"md5({lit(str(salt) + ':')}{lead} || CAST({x} AS VARCHAR))"
