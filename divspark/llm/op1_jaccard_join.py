"""Similarity join on word n-grams: Jaccard by prefix filtering.

1. *Sets.*  Each text becomes its set of hashed word n-grams (64 bits).  Texts
   with equal sets are one class, so copies never meet pair by pair.
2. *Rare first.*  A counting sketch of fixed size over all texts orders the
   n-grams of a set; frequent ones go last.  Any order gives the same links,
   this one gives the fewest candidates.
3. *Prefixes.*  For a link with overlap at least ``alpha`` the two sets share an
   n-gram among the first ``n - alpha + 1`` of each.  The longest prefix that any
   partner allows is emitted; rows whose n-gram no other set emitted go.
4. *Candidates* come from joining prefix rows on the n-gram, with the length
   filter and the positional filter in the join condition.  In each bucket the
   best connected set (the *hub*) meets every member; members that end up in
   the component of the hub need not meet each other, for a link between them
   would change nothing.  After two rounds of hubs, whatever is still in another
   component than its bucket's hub meets all members of the bucket.  So a group
   of near copies costs work in proportion to its size and no link is lost.
5. *Verification*, once per pair: a suffix filter (overlap bound from counts by
   hash range), then the exact intersection.
6. Components of the links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from divspark.llm.common import Workspace, arrow_map, numbered, pick, read, utf8
from divspark.llm.components import components

SKETCH_BITS = 18
CHUNK = 4096
MAX_WORDS = 150_000  # word hashes a worker remembers
RANGES = 16  # hash ranges of the suffix filter


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the word n-grams of a text, A-Z lower-cased;
    a text of fewer words is one n-gram, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(w))
    out = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ w[k:len(w) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def set_key(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def rare_first(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return s[np.lexsort((s, sketch[s >> np.uint64(64 - SKETCH_BITS)]))]


def _sets_and_sketch(docs: DataFrame, n: int) -> DataFrame:
    """Per row its set size and key; per partition its counts, in chunks."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, dtype=np.uint32), set()
        schema = None
        for b in batches:
            size, keys = [], []
            for text in utf8(b.column("text")):
                s = shingles(text, n)
                key = set_key(s) if len(s) else None
                size.append(len(s)), keys.append(key)
                if key is not None and key not in seen:
                    seen.add(key)
                    np.add.at(counts, s >> np.uint64(64 - SKETCH_BITS), 1)
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("hash"), pa.array(size, pa.int64()), pa.array(keys, pa.int64()),
                 pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())],
                ["doc_id", "hash", "n", "key", "chunk", "counts"])
            schema = out.schema
            yield out
        if schema is not None:
            k = len(counts) // CHUNK
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, schema.field("doc_id").type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                 pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()),
                 pa.array([c.tobytes() for c in counts.reshape(k, CHUNK)], pa.binary())], schema=schema)
    return docs.mapInArrow(run, f"doc_id {id_type}, hash long, n long, key long, chunk int, counts binary")


def _sum_sketch(chunks: DataFrame) -> np.ndarray:
    """Sum of the partitions' counts: each chunk is added up as its rows stream
    through one task; the result has a fixed size."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(raw, dtype=np.uint32)
                total[chunk] = total[chunk] + part if chunk in total else part.astype(np.uint64)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(total), pa.int32()),
                                          "counts": pa.array([v.tobytes() for v in total.values()], pa.binary())})
    rows = chunks.repartition("chunk").mapInArrow(run, "chunk int, counts binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint64)
    for r in rows:
        sketch[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["counts"]), dtype=np.uint64)
    return sketch


def _prefixes(docs: DataFrame, sketch, n: int, num: int, den: int) -> DataFrame:
    """(gram, key, n, pos) for the prefix of every distinct set of a partition."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            grams, keys, sizes = [], [], []
            for text in utf8(b.column("text")):
                s = shingles(text, n)
                key = set_key(s) if len(s) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                size = len(s)
                # the least overlap with any partner that passes the length filter
                grams.append(rare_first(s, sketch.value)[:size - -(-num * size // den) + 1])
                keys.append(key), sizes.append(size)
            if keys:
                reps = [len(g) for g in grams]
                yield pa.RecordBatch.from_pydict({
                    "gram": pa.array(np.concatenate(grams).view(np.int64)),
                    "key": pa.array(np.repeat(np.array(keys, dtype=np.int64), reps)),
                    "n": pa.array(np.repeat(np.array(sizes, dtype=np.int32), reps)),
                    "pos": pa.array(np.concatenate([np.arange(r, dtype=np.int32) for r in reps]))})
    return docs.select("text").mapInArrow(run, "gram long, key long, n int, pos int")


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Length filter and positional filter for the first common n-gram of two sets:
    what follows it in either set must hold the overlap that a link needs."""
    nx, ny, px, py = (F.col(c).cast("long") for c in (f"{x}.n", f"{y}.n", f"{x}.pos", f"{y}.pos"))
    need = num * (nx + ny)
    return ((den * F.least(nx, ny) >= num * F.greatest(nx, ny))
            & ((num + den) * (nx - px) >= need) & ((num + den) * (ny - py) >= need))


def _pair() -> list[Column]:
    return [F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")]


def _fetch_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """(key, grams) of the wanted classes, computed again from one text of each."""
    want = keys.join(classes, "key").select(F.col("row_id").alias("doc_id"), "hash", F.col("key").alias("want"))
    same = docs["doc_id"].eqNullSafe(want["doc_id"]) & (docs["hash"] == want["hash"])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, n) for t in utf8(b.column("text"))]
        return pa.RecordBatch.from_arrays([b.column("want"), pa.array([s.tobytes() for s in sets], pa.binary())],
                                          ["key", "grams"])
    return (arrow_map(docs.join(want, same).select("want", "text"), run, "key long, grams binary")
            .dropDuplicates(["key"]))


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough."""
    edges = (np.arange(1, RANGES, dtype=np.uint64) << np.uint64(60))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for i, (rx, ry) in enumerate(zip(b.column("sx").to_pylist(), b.column("sy").to_pylist(), strict=True)):
            x, y = np.frombuffer(rx, dtype=np.uint64), np.frombuffer(ry, dtype=np.uint64)
            need = -(-num * (len(x) + len(y)) // (num + den))
            cx, cy = (np.diff(np.searchsorted(s, edges), prepend=0, append=len(s)) for s in (x, y))
            if np.minimum(cx, cy).sum() < need:  # suffix filter
                continue
            if len(np.intersect1d(x, y, assume_unique=True)) >= need:
                keep.append(i)
        at = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])
    sx = sets.select(F.col("key").alias("a"), F.col("grams").alias("sx"))
    sy = sets.select(F.col("key").alias("b"), F.col("grams").alias("sy"))
    return arrow_map(pairs.join(sy, "b").join(sx, "a").select("a", "b", "sx", "sy"), run, "a long, b long")


def _links(ws: Workspace, docs: DataFrame, classes: DataFrame, prefix: DataFrame, n: int, num: int, den: int
           ) -> DataFrame | None:
    """(key, root) of the sets that have links; None without any."""
    prefix = ws.store(prefix, "prefix")
    # partial sums before the shuffle: a gram that many sets share is a row a task
    shared = (prefix.groupBy("gram").agg(F.min("key").alias("lo"), F.max("key").alias("hi"),
                                         F.count(F.lit(1)).alias("members"))
              .where("lo != hi").select("gram", "members"))
    rows = ws.store(prefix.join(shared, "gram").select("gram", "key", "n", "pos", "members"), "shared")
    ws.drop("prefix")
    degree = rows.groupBy("key").agg(F.sum("members").alias("degree"))
    rows = ws.store(rows.drop("members").join(degree, "key").distinct(), "rows")
    ws.drop("shared")
    sets = tried = roots = None
    links: list[DataFrame] = []
    for step in ("hub", "second", "rest"):
        own = rows if roots is None else (
            rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
        if roots is None:
            own = own.withColumn("root", F.col("key"))
        hub = F.max(F.struct("degree", "key", "n", "pos", "root"))
        if step == "hub":
            hubs = own.groupBy("gram").agg(hub.alias("h"))
        else:  # hubs of the buckets that hold more than one component
            first = own.groupBy("gram").agg(hub.alias("first"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            first = first.where("lo != hi").select("gram", F.col("first.root").alias("first_root"))
            others = own.join(first, "gram").where("root != first_root")
            hubs = others.groupBy("gram").agg(hub.alias("h"))
        if step == "rest":  # what is not with its bucket's hub meets every member
            x, y = others.alias("x"), own.alias("y")
        else:
            x, y = hubs.select("gram", "h.key", "h.n", "h.pos", "h.root").alias("x"), own.alias("y")
        pairs = (x.join(y, F.col("x.gram") == F.col("y.gram"))
                 .where((F.col("x.root") != F.col("y.root")) & _may_link("x", "y", num, den))
                 .select(*_pair()).distinct())
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = ws.store(pairs, f"pairs-{step}", few=True)
        tried = pairs if tried is None else tried.unionByName(pairs)
        keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        if sets is not None:
            keys = keys.join(sets.select("key"), "key", "left_anti")
        if step == "hub" or not keys.isEmpty():
            got = ws.store(_fetch_sets(docs, classes, keys, n), f"sets-{step}")
            sets = got if sets is None else sets.unionByName(got)
        links.append(ws.store(_verify(pairs, sets, num, den), f"links-{step}"))
        if links[-1].isEmpty():
            continue
        edges = links[0]
        for more in links[1:]:
            edges = edges.unionByName(more)
        roots = components(ws, edges, f"components-{step}")
    ws.drop("rows", "pairs-hub", "pairs-second", "pairs-rest", "sets-hub", "sets-second", "sets-rest")
    return roots


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5,
                    num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: ``doc_id, hash, n_shingles, component_id, first``.

    Two rows link when ``den * |A & B| >= num * |A | B|`` for their sets of word
    n-grams; ``component_id`` is the smallest id that links reach (nulls apart),
    ``first`` whether the row holds it, and ``hash`` is xxhash64 of the text.  A
    null text, an empty one, or one of white space alone has an empty set and
    links with nothing, not even its like.  Equal sets (repeated rows too) always
    link.  An empty table gives an empty result; extra columns are ignored.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "jaccard")
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("hash", F.xxhash64("text"))
    table = ws.store(_sets_and_sketch(docs, n), "sets")
    rows = table.where("chunk IS NULL").select("doc_id", "hash", "n", "key")
    sketch = spark.sparkContext.broadcast(_sum_sketch(table.where("chunk IS NOT NULL").select("chunk", "counts")))
    classes = ws.store(rows.where("n > 0").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("row"))
        .select("key", F.col("row.none").alias("none"), F.col("row.doc_id").alias("row_id"),
                F.col("row.hash").alias("hash")), "classes")
    roots = _links(ws, docs, classes, _prefixes(docs, sketch, n, num, den), n, num, den)
    least = F.min(F.struct("none", "row_id", "hash"))
    if roots is None:
        named = classes.select("key", F.struct("none", "row_id", "hash").alias("c"))
    else:
        linked = classes.join(roots, "key")
        first = linked.groupBy("root").agg(least.alias("c"))
        named = (classes.join(roots, "key", "left").join(first, "root", "left")
                 .select("key", F.coalesce("c", F.struct("none", "row_id", "hash")).alias("c")))
    named = ws.store(named.select("key", F.col("c.row_id").alias("component"), F.col("c.hash").alias("first_hash")),
                     "named")
    alone = F.col("key").isNull()
    return (rows.join(named, "key", "left")
            .select("doc_id", "hash", F.col("n").alias("n_shingles"),
                    F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
                    (alone | (F.col("doc_id").eqNullSafe(F.col("component")) & (F.col("hash") == F.col("first_hash"))))
                    .alias("first")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5,
             num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df`` that stand for their group (smallest id), with all their
    columns; a row is known by its id and text."""
    rows, names = numbered(df)
    id_, text = names[df.columns.index(id_col)], names[df.columns.index(text_col)]
    first = (jaccard_classes(df, id_col, text_col, n=n, num=num, den=den).where("first")
             .select("doc_id", "hash").distinct())
    own = rows.withColumn("own", F.xxhash64(text))
    return (own.join(first, own[id_].eqNullSafe(first["doc_id"]) & (own["own"] == first["hash"]), "left_semi")
            .select(*names).toDF(*df.columns))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return jaccard_classes(docs, n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")
