"""Benchmark decontamination by spaced seeds.

A *spaced seed* is a fixed mask over consecutive words; the masked-out places
may differ, so a seed still hits where a word was substituted.  The words under
every mask at every place of the benchmark items are hashed into an index; each
document's windows are hashed the same way and joined to it; every hit names an
item and a diagonal (document place minus item place), and the diagonal is
verified once: the best run of aligned words in which matches outweigh
substitutions 4 to 1.  Items too short for that are looked up whole, word for
word.  In scripts written without spaces every character counts as a word.

The index is what is broadcast, so its size is checked: items are dealt into
blocks of about ``block_words`` words and each block is one pass over the
documents.  The corpus itself is never shuffled and a document's work stays in
one Arrow batch; the result has one row per document however many items share a
passage.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.llm.common import Workspace, arrow_map, numbered, pick, read

MASKS = ("111111", "1110111", "11011011", "110010111", "1010110011", "10011010101")
MIN_MATCH = 12  # words an overlap must share, or
MIN_SHARE = 0.8  # this share of a short item
MIN_ITEM = 8  # shorter items are only looked up whole
MIN_INSIDE = 3  # an item shorter than this must be the whole text
PENALTY = 4  # a substitution costs as much as this many matches
BLOCK_WORDS = 200_000
HITS = 1 << 20  # seed hits, or words of aligned diagonals, held at a time

#: ASCII other than letters and digits separates words.
SEPARATORS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

#: UTF-8 of Thai, Lao, Myanmar, Khmer, Kana, Han; their punctuation and full-width signs separate words.
UNSPACED = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xe3\x80[\x85\x87]"
                      rb"|\xe3[\x81-\x83\x87\x90-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}"
                      rb"|\xef[\xa4-\xab][\x80-\xbf]|\xef\xbd[\xa6-\xbf]|\xef\xbe[\x80-\x9f]"
                      rb"|\xf0[\xa0-\xbf][\x80-\xbf]{2}")
SIGNS = re.compile(rb"\xe3\x80[\x80-\x84\x86\x88-\xbf]|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]")
UNSPACED_SQL = r"[^\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}\p{IsHiragana}\p{IsKatakana}\p{IsHan}]"

FOUND = "n_items long, item_id {item}, matched_words int, substituted int, first_word int, item_ids array<{item}>"


def words_of(col: pa.Array) -> list[list[bytes]]:
    """Lower-cased words of each text, characters in scripts without spaces; a null
    text has none."""
    col = pc.utf8_lower(col.cast(pa.large_string())).cast(pa.large_binary())
    return [spaced(x).translate(SEPARATORS).split() if x else [] for x in col.to_pylist()]


def spaced(text: bytes) -> bytes:
    return text if text.isascii() else UNSPACED.sub(rb" \g<0> ", SIGNS.sub(b" ", text))


class Index:
    """Seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], short: bool = False):
        items = [(i, w) for i, w in items if len(w) >= MIN_ITEM or short and w]
        self.ids = [i for i, _ in items]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for _, w in items for x in w}))}
        words = [np.array([self.vocabulary[x] for x in w], dtype=np.int64) for _, w in items]
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.least = np.minimum(MIN_MATCH, np.ceil(MIN_SHARE * self.sizes - 1e-9)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.concatenate(words) if words else np.zeros(0, np.int64)
        self.seeds = []  # per mask: sorted hashes, item and place of each
        for mask in MASKS:
            keys = [seed_hashes(w if len(w) >= MIN_ITEM else w[:0], mask)[0] for w in words]
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(words)), [len(k) for k in keys])
            place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
            order = np.argsort(key, kind="stable")
            self.seeds.append((key[order], item[order], place[order]))
        self.short = []  # per length: sorted hashes of the whole short items, and items
        for size in sorted({len(w) for w in words if len(w) < MIN_ITEM}):
            item = np.flatnonzero(self.sizes == size)
            key = np.concatenate([seed_hashes(words[i], "1" * size)[0] for i in item])
            order = np.argsort(key, kind="stable")
            self.short.append((size, key[order], item[order]))

    def find(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(item number, matched, substituted, first word) of every item found, the
        longest overlap of each; ties go to the first place."""
        get = self.vocabulary.get
        doc = np.array([get(w, 0) for w in words], dtype=np.int64)
        best: dict[int, tuple[int, int, int, int]] = {}  # matched, minus diagonal, substituted, first word
        for cells in self.cells(doc):
            item, diagonal = cells >> 40, (cells & ((1 << 40) - 1)) - (1 << 30)
            matched, changed, first = self.verify(doc, item, diagonal)
            ok = np.flatnonzero(matched >= self.least[item])
            for i, d, m, c, f in zip(*(x[ok].tolist() for x in (item, diagonal, matched, changed, first)), strict=True):
                if i not in best or (m, -d) > best[i][:2]:
                    best[i] = m, -d, c, f
        best = {i: (m, c, f) for i, (m, _, c, f) in best.items()}
        for item, at in self.find_short(doc):
            if item not in best:
                best[item] = int(self.sizes[item]), 0, at
        return [(i, *f) for i, f in sorted(best.items())]

    def cells(self, doc: np.ndarray):
        """(item, diagonal) pairs that share a seed, as one number each and each once in an
        array; an array covers the document's places up to about ``HITS`` hits, so many
        items with one stem, or one stem many times, need no more memory."""
        hits = []  # per mask: places, first row of the seed table, rows
        load = np.zeros(len(doc) + 1, dtype=np.int64)
        for mask, (keys, _, _) in zip(MASKS, self.seeds, strict=True):
            key, at = seed_hashes(doc, mask)
            lo = np.searchsorted(keys, key, side="left")
            n = np.searchsorted(keys, key, side="right") - lo
            hit = np.flatnonzero(n)
            hits.append((at[hit], lo[hit], n[hit]))
            load[at[hit]] += n[hit]
        if not load.any():
            return
        upto = np.cumsum(load)
        edges = [0, *(np.flatnonzero(np.diff(upto // HITS)) + 1).tolist(), len(doc) + 1]
        for begin, end in zip(edges, edges[1:]):
            found = []
            for (at, lo, n), (_, item, place) in zip(hits, self.seeds, strict=True):
                a, b = np.searchsorted(at, (begin, end))
                if a < b:
                    at, lo, n = at[a:b], lo[a:b], n[a:b]
                    row = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    # a diagonal is above minus the item's size
                    found.append(item[row] * (1 << 40) + np.repeat(at, n) - place[row] + (1 << 30))
            if found:
                yield np.unique(np.concatenate(found))

    def find_short(self, doc: np.ndarray):
        """(item number, first word) of every place that holds a whole short item."""
        for size, keys, item in self.short:
            if len(doc) < size or size < MIN_INSIDE and len(doc) != size:
                continue
            key, at = seed_hashes(doc, "1" * size)
            lo, hi = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
            for k in np.flatnonzero(hi > lo).tolist():
                for i in item[lo[k]:hi[k]].tolist():
                    if np.array_equal(doc[at[k]:at[k] + size], self.words[self.starts[i]:self.starts[i] + size]):
                        yield i, int(at[k])

    def verify(self, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, ...]:
        """Best run of aligned words on each diagonal: matched, substituted and first word.
        Diagonals of like length are one matrix of at most about ``HITS`` entries."""
        lo, hi = np.maximum(0, diagonal), np.minimum(len(doc), diagonal + self.sizes[item])
        size = hi - lo
        out = np.zeros((3, len(item)), dtype=np.int64)
        order, at = np.argsort(size, kind="stable"), 0
        while at < len(order):
            most = max(1, HITS // max(1, int(size[order[at]]) + 1))
            rows = order[at:at + most]
            # lengths up to half as long again: the rest of a row counts as substituted
            rows = rows[size[rows] <= 1.5 * size[rows[0]] + 8]
            at += len(rows)
            k = np.arange(int(size[rows].max()))
            within = k < size[rows][:, None]
            mine = np.where(within, lo[rows][:, None] + k, 0)
            theirs = np.where(within, (self.starts[item[rows]] - diagonal[rows] + lo[rows])[:, None] + k, 0)
            same = (doc[mine] == self.words[theirs]) & within
            score = np.zeros((len(rows), len(k) + 1), dtype=np.int32)
            np.cumsum(np.where(same, 1, -PENALTY), axis=1, out=score[:, 1:])
            least = np.minimum.accumulate(score, axis=1)
            end = (score - least).argmax(axis=1)
            each = np.arange(len(rows))
            begin = (score == least[each, end][:, None]).argmax(axis=1)
            # gain = matched - PENALTY * substituted over end - begin words
            gain = (score[each, end] - least[each, end]).astype(np.int64)
            changed = (end - begin - gain) // (PENALTY + 1)
            out[:, rows] = end - begin - changed, changed, lo[rows] + begin
        return out[0], out[1], out[2]


def seed_hashes(words: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows whose masked words are all known, and their places."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k, used in enumerate(mask):
        if used == "1":
            w = words[k:k + n]
            known &= w > 0
            key = (key ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    at = np.flatnonzero(known)
    return key[at], at


def _blocks(bench: DataFrame, block_words: int) -> list[DataFrame]:
    words = F.size(F.split("text", r"\s+")) + F.length(F.regexp_replace("text", UNSPACED_SQL, ""))
    total = bench.agg(F.sum(words)).first()[0] or 0
    n = max(1, math.ceil(total / block_words))
    deal = F.pmod(F.xxhash64("text"), F.lit(n))
    return [bench.where(deal == k) for k in range(n)]


def _one_block(docs: DataFrame, block: DataFrame, short_items: bool) -> tuple[DataFrame, Broadcast]:
    """:func:`find_overlaps` for the items of one block, and the broadcast index it uses."""
    spark = docs.sparkSession
    item_type = block.schema["item_id"].dataType.simpleString()
    keep = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    # equal texts are one item, named by their smallest id
    got = block.groupBy("text").agg(F.min("item_id").alias("item_id")).orderBy("item_id").toArrow()
    index = spark.sparkContext.broadcast(
        Index(list(zip(got["item_id"].to_pylist(), words_of(got["text"].combine_chunks()), strict=True)), short_items))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seeds, rows = index.value, []
        for words in words_of(batch.column("text")):
            found = seeds.find(words)
            if found:
                item, matched, changed, first = max(found, key=lambda f: (f[1], -f[2], -f[0]))
                rows.append((len(found), seeds.ids[item], matched, changed, first, [seeds.ids[f[0]] for f in found]))
            else:
                rows.append((0, None, 0, 0, None, []))
        schema = pa.schema([(f.name, f.type) for f in empty.schema if f.name not in keep])
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], [*keep, *schema.names])
    spec = f"{fields}{', ' if keep else ''}{FOUND.format(item=item_type)}"
    empty = spark.createDataFrame([], spec).toArrow()
    return arrow_map(docs, run, spec), index


def find_overlaps(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS,
                  short_items: bool = False) -> DataFrame:
    """``docs`` (columns ..., text) with the columns of ``FOUND`` in place of the text.

    Of several blocks of items each is run and written before the next one's index
    is made, so there is one broadcast at a time.
    """
    blocks = _blocks(bench, block_words)
    if len(blocks) == 1:
        return _one_block(docs, blocks[0], short_items)[0]
    keep = [c for c in docs.columns if c != "text"]
    ws, both = Workspace(docs.sparkSession, "overlaps"), None
    for k, block in enumerate(blocks):
        found, index = _one_block(docs, block, short_items)
        found = ws.store(found, f"block{k}")
        index.unpersist()
        both = found if both is None else both.unionByName(found)
    best = F.min(F.struct((-F.col("matched_words")).alias("less"), "substituted", "item_id", "first_word"))
    return (both.groupBy(*keep)
            .agg(F.sum("n_items").alias("n_items"), best.alias("b"),
                 F.flatten(F.collect_list("item_ids")).alias("item_ids"))
            .select(*keep, "n_items", F.col("b.item_id").alias("item_id"), (-F.col("b.less")).alias("matched_words"),
                    F.col("b.substituted"), F.col("b.first_word"), F.array_sort("item_ids").alias("item_ids")))


def decontaminate(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", *,
                  block_words: int = BLOCK_WORDS, short_items: bool = False) -> DataFrame:
    """One row per document: ``doc_id, contaminated, n_items, item_id, matched_words,
    substituted, first_word, item_ids``.

    ``item_id`` is the item of the longest overlap (ties: fewer substitutions, then
    the smaller id).  A null or empty text is clean, as is every document when the
    benchmark is empty.  Items of fewer than 8 words are looked up with
    ``short_items`` only: whole and unchanged, inside the text from 3 words, else as
    the whole text.  Items without a word, null ones too, are not searched for;
    equal items count once, under their smallest id.  Texts of any length and items that all
    share one stem are searched whole, in bounded memory.  Repeated ids keep one result
    per row.  Extra columns are ignored.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "decontaminate")
    items = pick(bench, item_id=item_col, text=item_text_col).where("text IS NOT NULL")
    docs = pick(df, doc_id=id_col, text=text_col)
    if len(_blocks(items, block_words)) > 1:  # rows meet again by their place
        docs = ws.store(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    found = find_overlaps(docs, items, block_words, short_items)
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_id",
                        "matched_words", "substituted", "first_word", "item_ids")


def keep_clean(df: DataFrame, bench: DataFrame, text_col: str = "text", *,
               block_words: int = BLOCK_WORDS, short_items: bool = False) -> DataFrame:
    """The rows of ``df`` that hold no benchmark passage, with all their columns."""
    ws = Workspace(df.sparkSession, "decontaminate")
    named, own = numbered(df)
    text = F.col(own[df.columns.index(text_col)])
    rows = named.withColumn("text", text)
    blocks = _blocks(pick(bench, item_id="item_id", text="text").where("text IS NOT NULL"), block_words)
    for k, block in enumerate(blocks):
        found, index = _one_block(rows, block, short_items)
        rows = found.where("n_items = 0").select(*own)
        if len(blocks) > 1:  # one broadcast at a time
            rows = ws.store(rows, f"clean{k}")
            index.unpersist()
        rows = rows.withColumn("text", text)
    return rows.select(*own).toDF(*df.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"),
                         short_items=True)
