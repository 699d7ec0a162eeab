"""Token counts of fields and sections by offset mapping.

The fields of a row are joined into one document, which is encoded once, as a
model would see it.  The byte span of every token follows from the lengths of
the tokens' bytes; the sections (the lines of each field) are byte spans too,
and the two sorted lists of spans are joined by binary search.  A token that
lies in several sections is allocated by an explicit rule:

``start``  to the section of its first byte;
``end``    to the section of its last byte;
``most``   to the section with most of its bytes, the earlier one of equals.

The counts of a document's sections always add up to its number of tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from divspark.llm.common import Workspace, arrow_map, pick, read

SEPARATOR = "\n"
RULES = ("start", "end", "most")


#: A run of Unicode white space long enough to be cut out when the pattern fails.
LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


class SpanEncoder:
    """Byte lengths of the tokens of whole texts."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:  # a vocabulary file that every machine has, not data
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, k in ranks.items():
            self.sizes[k] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a text.  The library's pattern fails on white-space runs of about a
        million characters; such a text is cut at its long runs, where the pattern would: a
        run without its last character is one piece, the last one belongs to what follows."""
        try:
            return self.encoding.encode_to_numpy(text)
        except ValueError:
            parts, at = [], 0
            for m in LONG_RUN.finditer(text):
                end = m.end() - (m.end() < len(text))
                parts.append(self.encoding.encode_to_numpy(text[at:m.start()]))
                parts.append(np.array(self.encoding._encode_single_piece(text[m.start():end].encode()), dtype=np.uint32))
                at = end
            if not at:
                raise
            return np.concatenate([*parts, self.encoding.encode_to_numpy(text[at:])])

    def ends(self, text: str) -> np.ndarray:
        """End of every token in the UTF-8 bytes of the text."""
        return np.cumsum(self.sizes[self.ids(text)]) if text else np.zeros(0, np.int64)


_ENCODERS: dict[str, SpanEncoder] = {}


def encoder(path: str, pattern: str) -> SpanEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SpanEncoder(path, pattern)
    return _ENCODERS[path]


def sections(values: list[bytes], separator: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(field, place in the field, first byte, end) of the sections of one document.  A line
    holds its line break and the last line of a field the separator behind it, so the
    sections cover the document without gaps."""
    field, place, starts, at = [], [], [], 0
    for k, value in enumerate(values):
        breaks = np.flatnonzero(np.frombuffer(value, dtype=np.uint8) == 10) + 1
        first = np.concatenate([[0], breaks]) if len(breaks) == 0 or breaks[-1] < len(value) else \
            np.concatenate([[0], breaks[:-1]])
        field.append(np.full(len(first), k)), place.append(np.arange(len(first))), starts.append(first + at)
        at += len(value) + (len(separator) if k + 1 < len(values) else 0)
    start = np.concatenate(starts)
    return np.concatenate(field), np.concatenate(place), start, np.append(start[1:], at)


def allocate(ends: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that also lie in another section) of each section."""
    first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    a = np.searchsorted(start, first, side="right") - 1
    b = np.searchsorted(start, ends - 1, side="right") - 1
    own = a if rule == "start" else b if rule == "end" else a.copy()
    if rule == "most":
        for t in np.flatnonzero(a != b):
            span = np.arange(a[t], b[t] + 1)
            held = np.minimum(end[span], ends[t]) - np.maximum(start[span], first[t])
            own[t] = span[int(held.argmax())]
    n = len(start)
    return np.bincount(own, minlength=n), np.bincount(own[a != b], minlength=n)


def count_tokens(df: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = ("text",), *,
                 vocabulary: str | None = None, pattern: str | None = None, separator: str = SEPARATOR,
                 rule: str = "start") -> DataFrame:
    """One row per document and section: ``doc_id, field, section, first_byte,
    n_bytes, n_chars, n_tokens, n_crossing``.

    A section is a line of a field; a null field counts as empty, and an empty field
    is one empty section, so every document has a row for each field.  A section of
    no bytes has no tokens.  Texts of any length, runs of millions of white-space
    characters included, are encoded whole.  Repeated ids keep the sections of each row; an empty
    table gives an empty result; extra columns are ignored.
    """
    import public_tokenizers as vocabularies

    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    Workspace(df.sparkSession, "token-counts")
    path, pat = vocabulary or vocabularies.path("byte_bpe_50k.tiktoken"), pattern or vocabularies.PATTERN
    names = [f"f{k}" for k in range(len(fields))]
    docs = pick(df, doc_id=id_col, **dict(zip(names, fields, strict=True)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sep = separator.encode()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc, parts = encoder(path, pat), []
        columns = [[x or "" for x in b.column(c).cast(pa.string()).to_pylist()] for c in names]
        for i, values in enumerate(zip(*columns, strict=True)):
            text = separator.join(values)
            raw = text.encode()
            field, place, start, end = sections([v.encode() for v in values], sep)
            tokens, crossing = allocate(enc.ends(text), start, end, rule)
            lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            parts.append((np.full(len(field), i), field, place, start, end - start, lead[end] - lead[start],
                          tokens, crossing))
        row, field, place, start, size, chars, tokens, crossing = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array(row)), pa.array(list(fields), pa.string()).take(pa.array(field)),
             *[pa.array(x.astype(np.int64)) for x in (place, start, size, chars, tokens, crossing)]],
            ["doc_id", "field", "section", "first_byte", "n_bytes", "n_chars", "n_tokens", "n_crossing"])
    return arrow_map(docs, run, f"doc_id {id_type}, field string, section long, first_byte long, n_bytes long, "
                                "n_chars long, n_tokens long, n_crossing long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), fields=("source", "text"))
