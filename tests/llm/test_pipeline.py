"""The corpus pipeline, stage by stage, against brute force; and the registry."""

import random
import re

import __spark_entry__ as E
import corpus_pipeline as C
from divspark.llm import registry
from tests.llm import helpers as H


def fixture(spark, tmp_path):
    rng = random.Random(9)
    items = [(k, H.sentence(rng, 25)) for k in range(4)]
    docs = [(k, H.sentence(rng, rng.randint(20, 80)), "en" if k % 2 else "de") for k in range(60)]
    docs += [(100 + k, docs[k][1], "en") for k in range(5)]  # exact copies
    docs += [(110, "  " + docs[6][1].replace(" ", "\n"), "en"), (6, docs[6][1], "en")]
    for k in range(7, 12):  # near copies
        w = docs[k][1].split()
        w[len(w) // 2] = "edited"
        docs.append((120 + k, " ".join(w), "de"))
    docs += [(200, docs[12][1] + " " + items[0][1], "en"), (201, items[1][1].upper(), "en"),
             (202, None, "en"), (203, "12 34 !!", None), (204, "", "de"), (205, "12 34 !!", "en"),
             (206, H.sentence(rng, 3000), None)]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, H.SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = fixture(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in C.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination",
                                        "best-fit packing"]

    def step(k, docs):
        C.STAGES[k][1](spark, docs, sf).write.parquet(str(tmp_path / f"stage{k}"))
        return spark.read.parquet(str(tmp_path / f"stage{k}"))

    def ids(df):
        return sorted(r["doc_id"] for r in df.collect())
    docs = step(0, docs)
    kept = [r for r in rows if r[1] is not None and re.search(r"[^\W\d_]", r[1])]
    assert docs.columns == columns and ids(docs) == sorted(r[0] for r in kept)

    docs = step(1, docs)
    groups = {}
    for r in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), []).append(r)
    kept = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    assert docs.columns == columns and ids(docs) == sorted(r[0] for r in kept)

    docs = step(2, docs)
    comp = H.components([H.shingles(r[1], 5) for r in kept], 80, 100)
    best = {}
    for c, r in zip(comp, kept):
        best[c] = min(best.get(c, r), r)
    assert len(best) < len(kept)
    kept = list(best.values())
    assert docs.columns == columns and ids(docs) == sorted(r[0] for r in kept)

    docs = step(3, docs)
    def words(t):
        return re.sub(r"[^0-9a-z]+", " ", t.lower()).split()
    grams = {tuple(words(t)[k:k + 12]) for _, t in items for k in range(len(words(t)) - 11)}
    kept = [r for r in kept if not any(tuple(words(r[1])[k:k + 12]) in grams for k in range(len(words(r[1]))))]
    assert docs.columns == columns and ids(docs) == sorted(r[0] for r in kept) and 201 not in ids(docs)

    packed = step(4, docs).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in kept}
    room = {}
    for r in packed:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 4096 and len(room) == -(-sum(room.values()) // 4096)


def test_run_applies_all_stages(spark, tmp_path):
    rows, _ = fixture(spark, tmp_path)
    got = C.run(spark, str(tmp_path))
    assert "sequence_id" in got.columns and 0 < got.select("doc_id").distinct().count() < len(rows)


def test_every_operator_is_registered_once():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(E.queries()) and set(registry.oracle_sql()) <= set(E.oracle_sql())
