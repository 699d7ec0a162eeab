"""Column expressions for text cleaning and tokenisation (C-1 .. C-8).

All are built-in Spark expressions, so they run inside whole-stage codegen.
Python string semantics are kept where they differ from Java/SQL defaults:
``str.strip`` removes Unicode whitespace (Spark ``trim`` only removes U+0020),
``str.split()`` drops empty edge tokens (Spark ``split`` keeps them), and
a word character is a letter, a number of any kind, or ``_``.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal Python's for identical results.
# ASCII punctuation, as Python's ``string.punctuation``:
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Word token of scikit-learn's CountVectorizer default.  Python's ``\w`` is letters,
# every kind of number and ``_``; Java's ``(?U)\w`` would add combining marks and
# leave out numbers such as superscripts.
WORD_TOKEN_REGEX = r"[\p{L}\p{N}_]{2,}"
# Digits that Python's ``str.isdigit`` takes beside the decimal ones (superscripts,
# circled digits, ...), derived from Python itself:
OTHER_DIGITS = "".join(c for c in map(chr, range(0x20000)) if c.isdigit() and not c.isdecimal())
DIGIT_CLASS = r"[\p{Nd}" + "".join(f"\\x{{{ord(c):x}}}" for c in OTHER_DIGITS) + "]"
# Python's whitespace (``str.isspace``), derived from Python itself:
PY_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_WS_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE) + "]"
_WS_RUN = _WS_CLASS + "+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower(c) -> Column:
    """C-1: ``x.lower()``."""
    return F.lower(_col(c))


def py_strip(c) -> Column:
    """C-2: ``x.strip()``: Python's whitespace set trimmed from both ends (no regex)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def dequote(c) -> Column:
    """C-3: ``x.replace('"', '')``."""
    return F.translate(_col(c), '"', "")


def strip_punctuation(c) -> Column:
    """C-4: remove the 32 ASCII punctuation characters (curly quotes stay)."""
    return F.translate(_col(c), ASCII_PUNCTUATION, "")


def empty_to_null(c) -> Column:
    """A text cleaned down to ``""`` counts as missing (it is after a CSV round trip)."""
    c = _col(c)
    return F.when(F.length(c) > 0, c)


def clean_text(c, *, lowercase: bool = True, strip: bool = True, remove_quotes: bool = True,
               remove_punctuation: bool = True, nullify_empty: bool = True) -> Column:
    """C-5 / C-6: lower, strip, dequote, depunctuate, in that order (no re-strip)."""
    c = _col(c)
    if lowercase:
        c = lower(c)
    if strip:
        c = py_strip(c)
    if remove_quotes:
        c = dequote(c)
    if remove_punctuation:
        c = strip_punctuation(c)
    return empty_to_null(c) if nullify_empty else c


def whitespace_tokens(c) -> Column:
    """``x.split()``: Unicode-whitespace runs, no empty tokens (every white space becomes a
    space first: splitting at one character needs no regex)."""
    plain = F.translate(_col(c), PY_WHITESPACE, " " * len(PY_WHITESPACE))
    return F.filter(F.split(plain, " "), lambda w: w != F.lit(""))


@functools.lru_cache(maxsize=None)
def default_stop_words(language: str = "english") -> tuple[str, ...]:
    """Spark ML's default stop-word list, read from the mllib jar (no JVM needed).

    This is what ``StopWordsRemover.loadDefaultStopWords(language)`` returns.
    """
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if not jars:  # pragma: no cover - depends on the install layout
        from pyspark.ml.feature import StopWordsRemover
        return tuple(StopWordsRemover.loadDefaultStopWords(language))
    with zipfile.ZipFile(jars[0]) as z:
        txt = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8")
    return tuple(w for w in txt.split("\n") if w)


def remove_stop_words(c, stop_words=None) -> Column:
    """C-7 ``cleantext``: whitespace split, drop stop words (case-sensitive), as an array.

    ``stop_words`` is a fixed-size list, inlined as a literal set.
    """
    stops = list(stop_words if stop_words is not None else default_stop_words())
    if not stops:
        return whitespace_tokens(c)
    # ``isin`` with many literals becomes a hash-set lookup (InSet), not a scan
    return F.filter(whitespace_tokens(c), lambda w: ~w.isin(*stops))


def join_words(arr) -> Column:
    return F.array_join(_col(arr), " ")


def word_tokens(c) -> Column:
    """C-8: CountVectorizer default analyzer: lower-case, tokens of 2+ word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_TOKEN_REGEX), 0)


def is_digit_word(c) -> Column:
    """T-5 ``word.isdigit()``."""
    return _col(c).rlike(f"^{DIGIT_CLASS}+$")


def order_key(c, salt: str = "0", *parts) -> Column:
    """Repeatable pseudo-random order: ``md5(salt : part : ... : text)`` as hex (null
    for a null text, as in SQL; a null part counts as empty).

    ``parts`` are what the order must differ by: run keys, label, seed.  Same value
    in Spark and in SQL engines, independent of partitioning.
    """
    lead = [x for p in parts for x in (F.coalesce(_col(p).cast("string"), F.lit("")), F.lit(":"))]
    return F.md5(F.concat(F.lit(f"{salt}:"), *lead, _col(c).cast("string")))


def uniform(c, salt: str = "0") -> Column:
    """A repeatable uniform number in [0, 1) from the first 60 bits of ``order_key``."""
    h = F.conv(F.substring(order_key(c, salt), 1, 15), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(float(1 << 60))
