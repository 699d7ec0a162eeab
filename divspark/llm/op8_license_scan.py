"""Licence scan by conditional compression.

Around every word that speaks of licences, a window of each template's length is
aligned with the template word by word, which cuts out the block that is closest
to it, wherever the block's lines, sentences or paragraphs begin and end.  Only templates
whose words are nearly all in the window get that far.  Each block is compressed
alone and with its template as a raw zstandard dictionary; what the dictionary
saves says how much of the block the template explains.  Blocks of enough saving
are confirmed by the wording: an exact word difference between template and
block lists what is missing, changed or added.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.llm.common import Workspace, arrow_map, pick, read
from divspark.llm.license_templates import TEMPLATES

CUE = re.compile(r"licen[cs]|copyright|warrant|permission|redistribut|spdx|public domain|creative commons"
                 r"|free software|all rights reserved|mozilla public", re.I)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
CLOSING = re.compile(r"[.!?/)\]\"']*")
MIN_SAVING = 0.3
MIN_SHARE = 0.9  # of the template's words that must be there
LEVEL = 3
REMEMBERED = 20_000  # blocks a worker keeps the answer for


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def added_at_most(size: int) -> int:
    """Words that a notice may have between those of a template of so many words."""
    return int(max(1, (1 - MIN_SHARE) * 2 * size))


def words_before(text: str, floor: int, end: int, n: int) -> list[tuple[int, int]]:
    """Spans of the last n words of text[floor:end]."""
    step = 16 * n
    while True:
        lo = max(floor, end - step)
        spans = [m.span() for m in WORD.finditer(text, lo, end)]
        if lo == floor:
            return spans[-n:]
        if len(spans) > n:  # the first may be a piece of a word
            return spans[-n:]
        step *= 4


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.templates = templates
        self.words = [words_of(t) for _, t in templates]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.ids = [np.array([self.vocabulary[w] for w in t], dtype=np.int64) for t in self.words]
        self.counts = np.array([np.bincount(t, minlength=len(self.vocabulary) + 1) for t in self.ids]) \
            if templates else np.zeros((0, 1), np.int64)
        self.least = np.array([MIN_SHARE * len(t) - 1e-9 for t in self.words])
        self.reach = max((len(t) + added_at_most(len(t)) for t in self.words), default=0)
        frame = dict(write_content_size=False, write_checksum=False, write_dict_id=False,
                     format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **frame)
        self.alone = zstandard.ZstdCompressor(compression_params=params)
        self.given = [zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            compression_params=params) for _, t in templates]
        self.known: dict[tuple[int, str], tuple | None] = {}

    def saving(self, template: int, block: str) -> float:
        raw = " ".join(block.lower().split()).encode(errors="replace")
        return 1 - len(self.given[template].compress(raw)) / len(self.alone.compress(raw))

    def differences(self, template: int, block: str) -> tuple[int, list[str], list[str]]:
        """(template words found in order, words missing, words added between the
        first and the last that were found)."""
        want, have = self.words[template], words_of(block)
        ops = SequenceMatcher(None, want, have, autojunk=False).get_opcodes()
        same = [k for k, op in enumerate(ops) if op[0] == "equal"]
        missing, added, found = [], [], 0
        for k, (op, a0, a1, b0, b1) in enumerate(ops):
            if op == "equal":
                found += a1 - a0
            else:
                missing += want[a0:a1]
                if same and same[0] < k < same[-1]:
                    added += have[b0:b1]
        return found, missing, added

    def match(self, template: int, block: str) -> tuple | None:
        """(words found, saving, share, missing, added) if the template is confirmed, or None."""
        key = template, block
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            answer, size = None, len(self.words[template])
            saving = self.saving(template, block)
            if saving >= MIN_SAVING:
                found, missing, added = self.differences(template, block)
                if found / size >= MIN_SHARE and len(added) <= added_at_most(size):
                    answer = found, saving, found / size, missing, added
            self.known[key] = answer
        return self.known[key]

    def closest(self, template: int, have: np.ndarray, cue: int) -> tuple[int, int] | None:
        """First and last place of the words closest to the template among those that
        begin at the place ``cue`` or before and end there or after, and begin and end
        with a word of the template in its place: a missing word costs as much as two
        added ones; ties go to the shortest."""
        n, size, far = len(have), len(self.words[template]), 1 << 50
        # a cell holds cost * unit + (unit - 1 - first place), so the smallest is also the shortest
        unit, places = 1 << 20, np.arange(n + 1)
        begin = np.where(places <= cue, unit - 1 - places, far)
        row, ends = np.full(n + 1, far), np.full(n + 1, far)
        for k, word in enumerate(self.ids[template]):
            same = np.full(n + 1, far)
            same[1:] = np.where(have == word, np.minimum(row, begin + 2 * k * unit)[:-1], far)
            ends = np.minimum(ends, same + 2 * (size - 1 - k) * unit)
            row = np.minimum.accumulate(np.minimum(row + 2 * unit, same) - places * unit) + places * unit
        end = cue + 1 + int(ends[cue + 1:].argmin())
        cost, first = int(ends[end]) // unit, unit - 1 - int(ends[end]) % unit
        if cost > 2 * (size - self.least[template]) + added_at_most(size):
            return None
        return first, end - 1

    def at_cue(self, text: str, cue: tuple[int, int], floor: int) -> tuple | None:
        """The notice around a cue, of the template with the most words found."""
        before = words_before(text, floor, cue[0], self.reach + 1)
        # the cue may lie inside a word, or reach over two
        first = before[-1][0] if before and before[-1][1] == cue[0] else cue[0]
        if before and before[-1][1] == cue[0]:
            before.pop()
        after = [m.span() for m in islice(WORD.finditer(text, first), self.reach + 1)]
        spans, at = before + after, len(before)
        if not after:
            return None
        have = np.array([self.vocabulary.get(text[a:b].lower(), 0) for a, b in spans], dtype=np.int64)
        best = None
        for k in self.nearly_all(have):
            size = len(self.words[k])
            reach = size + added_at_most(size)
            lo = max(0, at - reach)
            window = have[lo:at + reach + 1]
            shared = np.minimum(np.bincount(window, minlength=self.counts.shape[1]), self.counts[k])[1:].sum()
            place = self.closest(k, window, at - lo) if shared >= self.least[k] else None
            if place is None:
                continue
            start, end = spans[lo + place[0]][0], spans[lo + place[1]][1]
            end = CLOSING.match(text, end).end()
            got = self.match(k, text[start:end])
            if got:
                rank = got[0], got[2], -len(got[4]), got[1], -k
                if best is None or rank > best[0]:
                    best = rank, (start, end - start, self.templates[k][0], *got[1:])
        return best and best[1]

    def nearly_all(self, have: np.ndarray) -> list[int]:
        """Templates that have nearly all of their words there, in whatever order."""
        count = np.bincount(have, minlength=self.counts.shape[1])
        return np.flatnonzero(np.minimum(self.counts, count)[:, 1:].sum(axis=1) >= self.least).tolist()

    def scan(self, text: str) -> list[tuple]:
        """(first character, characters, licence, saving, share, missing, added) of
        every notice, in text order; notices do not overlap."""
        out, at, end_of_last = [], 0, 0
        while (cue := CUE.search(text, at)) is not None:
            found = self.at_cue(text, cue.span(), end_of_last)
            if found:
                out.append(found)
                at = end_of_last = found[0] + found[1]
            else:
                at = cue.end()
        return out


_SCANNERS: dict[tuple, Scanner] = {}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
         templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per notice: ``doc_id, notice, first_char, n_chars, license, saving,
    share, missing, added``.

    A null or empty text, or one without a notice, gives no row.  Every cue is
    looked at, however long the text or its lines.  Repeated ids keep the notices of each row;
    an empty table gives an empty result; extra columns are ignored.
    """
    Workspace(df.sparkSession, "licenses")
    docs = pick(df, doc_id=id_col, text=text_col).where("text IS NOT NULL")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        scanner = _SCANNERS.get(templates) or _SCANNERS.setdefault(templates, Scanner(templates))
        rows = []
        for i, text in enumerate(b.column("text").to_pylist()):
            rows += [(i, k, *n) for k, n in enumerate(scanner.scan(text))]
        if not rows:
            return None
        at, *cols = zip(*rows, strict=True)
        types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(),
                 pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["notice", "first_char", "n_chars", "license", "saving", "share", "missing", "added"]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array(at)), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
            ["doc_id", *names])
    return arrow_map(docs, run, f"doc_id {id_type}, notice int, first_char long, n_chars long, license string, "
                                "saving double, share double, missing array<string>, added array<string>")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    return found.withColumn("saving", F.round("saving", 6))
