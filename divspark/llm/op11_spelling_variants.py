"""Grouping of spelling variants: words one inserted, deleted or replaced code point apart.

1. Words are counted with map-side combination; only those long and frequent enough
   stay (DataFrame functions).
2. Two words one edit apart, the longer one ``L`` code points long, have a common
   prefix ``P`` and suffix ``S`` with ``P + S >= L - 1``; so one of the two reaches
   ``h = L // 2``.  Every word is dealt to the groups of its first and of its last ``h``
   code points, for ``L`` its own length and one more.  A pair belongs to its prefix
   group when ``P >= h``, else to its suffix group: it is met exactly once.
3. A group is cut into blocks of bounded size, and block pairs (tiles) are dealt to
   tasks, so a hot prefix is spread.  A tile holds padded code-point matrices, forwards
   and backwards, and compares all its rows column by column; only pairs with
   ``P + S >= L - 1`` leave it, added up per word.  Small groups share one tile.
4. Chains of forms are followed by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.llm.common import Workspace, pick, read
from divspark.operators.joins import join_small

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
SLIP = 199
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCK = 1024  # rows of a block at most (twice: blocks are dealt by hash)
BLOCK_CELLS = 1 << 22  # code points of a block at most, for very long words
TILE_CELLS = 1 << 20  # pairs compared at once in tiles of small groups
PREFIX, SUFFIX = 0, 1
FOUND = "word string, near long, n_form long, form string"


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough; ``docs``: doc_id, text."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN),
                                                                F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
                .cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIP == 0, slip).otherwise(F.col("run"))
    return (runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def block_rows(length):
    """Rows of a block for words of a length (column or number)."""
    return F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_CELLS) / length)))


def dealt(vocabulary: DataFrame) -> DataFrame:
    """Rows of tiles: ``tile, longer, side, first, same, word, n``; ``first`` tells the row's
    block of the two, ``same`` a tile of one block."""
    def group(longer, side: int):
        h = (longer / 2).cast("int")
        part = F.substring("word", F.lit(1), h) if side == PREFIX else F.substring("word", F.length("word") - h + 1, h)
        return F.struct(longer.cast("int").alias("longer"), F.lit(side).alias("side"),
                        F.xxhash64(longer, F.lit(side), part).alias("g"))
    size = F.length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(
        *[group(size + more, side) for more in (0, 1) for side in (PREFIX, SUFFIX)])).alias("k"))
    rows = rows.select("word", "n", "k.longer", "k.side", "k.g")
    key = ["g", "longer", "side"]
    large = (rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
             .where(F.col("rows") > block_rows(F.col("longer")))
             .select(*key, F.ceil(F.col("rows") / block_rows(F.col("longer"))).cast("int").alias("blocks")))
    rows = join_small(rows, large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word", F.lit("block")), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.select(F.xxhash64("g", low, high).alias("tile"), "longer", "side", (F.col("own") == low).alias("first"),
                       (low == high).alias("same"), "word", "n")


def code_points(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Padded code-point rows of words, forwards and backwards; the padding is 0."""
    size = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    if not len(flat) or flat.max() < 256:
        flat = flat.astype(np.uint8)
    row = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((2, len(texts), width), dtype=flat.dtype)
    out[0, row, place] = flat
    out[1, row, np.repeat(size, size) - 1 - place] = flat
    return out[0], out[1]


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every row of ``a`` (g, i, w) with every row of
    ``b`` (g, j, w) of its group; different words never agree in the padding."""
    out = np.zeros((a.shape[0], a.shape[1], b.shape[1]), dtype=np.int16 if a.shape[2] < 1 << 15 else np.int32)
    alive = np.ones(out.shape, dtype=bool)
    for c in range(a.shape[2]):
        alive &= a[:, :, None, c] == b[:, None, :, c]
        if not alive.any():
            break
        out += alive
    return out


def near(rows_a: np.ndarray, rows_b: np.ndarray, matrix: tuple[np.ndarray, np.ndarray], size: np.ndarray,
         longer: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the single edits among the row blocks of every group (-1: no row)."""
    a, b = rows_a[:, :, None], rows_b[:, None, :]
    prefix = common(matrix[0][rows_a], matrix[0][rows_b])
    suffix = common(matrix[1][rows_a], matrix[1][rows_b])
    most, half = longer[:, None, None], (longer // 2)[:, None, None]
    hit = (prefix.astype(np.int32) + suffix >= most - 1) & ((prefix >= half) == (side == PREFIX)[:, None, None])
    hit &= (a >= 0) & (b >= 0) & (a != b) & (np.maximum(size[a], size[b]) == most)
    g, i, j = np.nonzero(hit)
    return rows_a[g, i], rows_b[g, j]


def tile_rows(tile: np.ndarray, longer: np.ndarray, side: np.ndarray, first: np.ndarray, same: np.ndarray,
              texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers one edit apart in whole tiles, sorted by tile."""
    cut = np.flatnonzero((np.diff(tile) != 0) | (np.diff(longer) != 0) | (np.diff(side) != 0)) + 1
    start, end = np.append(0, cut), np.append(cut, len(tile))
    size = np.array([len(t) for t in texts], dtype=np.int32)
    found_a, found_b = [], []

    def compare(picked: np.ndarray, rows_a: np.ndarray, rows_b: np.ndarray) -> None:
        own = np.unique(np.concatenate([rows_a.ravel(), rows_b.ravel()]))
        own = own[own >= 0]
        local = np.full(len(texts) + 1, -1)
        local[own] = np.arange(len(own))  # the last place stands for no row
        matrix = code_points([texts[k] for k in own], int(size[own].max()))
        x, y = near(local[rows_a], local[rows_b], matrix, size[own], longer[start[picked]], side[start[picked]])
        found_a.append(own[x])
        found_b.append(own[y])
    single, count = same[start], end - start
    for k in np.flatnonzero(~single | (count > 32)):
        rows = np.arange(start[k], end[k])
        a = rows if single[k] else rows[first[rows]]
        b = rows if single[k] else rows[~first[rows]]
        if len(a) and len(b):
            compare(np.array([k]), a[None, :], b[None, :])
    wide = 2
    while wide <= 32:  # small groups side by side, padded to 2, 4, 8, 16 or 32 rows
        chosen = np.flatnonzero(single & (count <= wide) & (count > (wide // 2 if wide > 2 else 1)))
        step = max(1, TILE_CELLS // (wide * wide))
        for at in range(0, len(chosen), step):
            part = chosen[at:at + step]
            rows = start[part][:, None] + np.arange(wide)[None, :]
            rows = np.where(rows < end[part][:, None], rows, -1)
            compare(part, rows, rows)
        wide *= 2
    if not found_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    one = np.concatenate(found_a), np.concatenate(found_b)
    # a tile of two blocks meets a pair once, a tile of one block in both directions
    both = ~same[one[0]]
    return np.concatenate([one[0], one[1][both]]), np.concatenate([one[1], one[0][both]])


def summed(texts: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Per word: its near words, counted, and the most frequent of them."""
    rank = np.empty(len(texts), dtype=np.int64)
    rank[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    code = {}
    word = np.array([code.setdefault(t, len(code)) for t in texts], dtype=np.int64)
    order = np.lexsort((rank[b], -n[b], word[a]))
    a, b = a[order], b[order]
    top = np.flatnonzero(np.append(True, np.diff(word[a]) != 0)) if len(a) else np.zeros(0, dtype=np.int64)
    near_count = np.diff(np.append(top, len(a)))
    return pa.RecordBatch.from_arrays(
        [pa.array([texts[k] for k in a[top]], pa.string()), pa.array(near_count, pa.int64()),
         pa.array(n[b[top]], pa.int64()), pa.array([texts[k] for k in b[top]], pa.string())],
        ["word", "near", "n_form", "form"])


def links(rows: DataFrame) -> DataFrame:
    """``word, near, n_form, form``: parts of a word's near words, by tile."""
    names = ("tile", "longer", "side", "first", "same")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(cols: list[np.ndarray], texts: list[str], n: np.ndarray) -> pa.RecordBatch | None:
            a, b = tile_rows(*cols, texts)
            return summed(texts, n, a, b) if len(a) else None
        held: pa.Table | None = None  # the tile that may go on in the next batch, two blocks at most

        def columns(t: pa.Table) -> tuple[list[np.ndarray], list[str], np.ndarray]:
            return ([t.column(c).to_numpy() for c in names], t.column("word").to_pylist(), t.column("n").to_numpy())
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            tile = t.column("tile").to_numpy()
            last = int(np.searchsorted(tile, tile[-1], side="left"))
            held = t.slice(last)
            if last:
                out = done(*columns(t.slice(0, last)))
                if out is not None:
                    yield out
        if held is not None:
            out = done(*columns(held))
            if out is not None:
                yield out
    spread = rows.repartition("tile").sortWithinPartitions("tile", "longer", "side")
    return spread.mapInArrow(run, FOUND)


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word that is long and frequent enough.

    Null and empty texts have no words; a null id counts as an empty one in the slip
    rule; repeated rows count each.  An empty table, or one without such words, gives
    an empty result.  Ties of the most frequent near word go to the smallest in
    code-point order.  A word of any length is compared whole.  Extra columns are
    ignored.
    """
    ws = Workspace(df.sparkSession, "spelling")
    vocabulary = ws.store(words(pick(df, doc_id=id_col, text=text_col), min_length, min_count), "words")
    found = links(dealt(vocabulary))
    best = F.min(F.struct((-F.col("n_form")).alias("less"), F.col("form")))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    enough = -F.col("b.less") >= ratio * F.col("n")
    table = ws.store(
        vocabulary.join(found, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(enough, F.col("b.form")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n")),
        "table")
    # forms grow by ``ratio`` each step, so chains are short: doubling ends after a few rounds
    up = table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    step = 0
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = ws.store(up.join(over, "root", "left")
                      .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                      f"up{step}")
        if step:
            ws.drop(f"up{step - 1}")
        moved = up.where("moved").limit(1).count()
        up = up.drop("moved")
        if not moved:
            break
        step += 1
    return (table.join(up, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


#: crc32 of the UTF-8 bytes by its bitwise definition: eight steps a byte, folded into a
#: table that the query makes from its rule.
ORACLE_SQL = """
WITH RECURSIVE bits AS (
  SELECT range AS b, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
long_runs AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hexed AS (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM long_runs),
crc AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2),
          lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))),
          lambda c, d: xor(c >> 8, tab.t[(xor(c, d) & 255) + 1])), 4294967295) AS h FROM hexed, tab),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                   ELSE run END AS word, times FROM crc),
v AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6
                   GROUP BY word HAVING sum(times) >= 5),
holes AS MATERIALIZED (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS hole
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
swaps AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM swaps a JOIN swaps b
           ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM holes a JOIN v b ON a.hole = b.word
         UNION SELECT b.word, a.word, a.n FROM holes a JOIN v b ON a.hole = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(best.n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form,
                  CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
up AS (SELECT word, word AS root, 0 AS k FROM formed
       UNION ALL SELECT up.word, f.form, k + 1 FROM up JOIN formed f ON up.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM up GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON f.word = r.word
"""
