"""Diagonals of the benchmark search (10) against brute force, and many items with one stem."""

import math
import random
import time

import pytest

from divspark.llm import op10_decontamination as D
from tests.llm import helpers as H  # noqa: F401


def brute(items, doc):
    """Every diagonal that shares the words under some mask, and on it every run."""
    found = {}
    for i, words in items:
        least = min(D.MIN_MATCH, math.ceil(D.MIN_SHARE * len(words)))
        for d in range(-len(words), len(doc)) if len(words) >= D.MIN_ITEM else ():
            same = [0 <= d + k < len(doc) and doc[d + k] == w for k, w in enumerate(words)]
            at = [k for k in range(len(words)) if 0 <= d + k < len(doc)]
            if not any(all(same[p + k] for k, m in enumerate(mask) if m == "1") and d + p >= 0 and d + p + len(mask) <= len(doc)
                       for mask in D.MASKS for p in range(len(words) - len(mask) + 1)):
                continue
            best, score, begin = (0, 0, 0), 0, at[0]
            for k in at:    # the best run: matches less four times the substitutions
                score += 1 if same[k] else -D.PENALTY
                if score <= 0:
                    score, begin = 0, k + 1
                elif score > best[0]:
                    best = score, begin, k + 1
            m = sum(same[best[1]:best[2]])
            if best[0] and m >= least and (i not in found or m > found[i][0]):
                found[i] = m, best[2] - best[1] - m, d + best[1]
    return [(i, *f) for i, f in sorted(found.items())]


@pytest.mark.parametrize("held", [1 << 20, 32])
def test_diagonals_against_brute_force(monkeypatch, held):
    monkeypatch.setattr(D, "HITS", held)
    rng = random.Random(11)
    words = [b"w%d" % k for k in range(40)]
    items = [(k, [rng.choice(words[:10 if k % 3 else 40]) for _ in range(rng.choice([8, 9, 14, 30]))]) for k in range(30)]
    index, n = D.Index(items), 0
    for _ in range(60):
        doc = [rng.choice(words) for _ in range(rng.choice([0, 3, 30]))]
        for _ in range(rng.randint(0, 3)):
            part = [w if rng.random() > 0.07 else rng.choice(words) for w in rng.choice(items)[1]]
            doc += part + [rng.choice(words) for _ in range(4)]
        got = [(m, c, f) for _, m, c, f in index.find(doc)]
        want = brute(items, doc)
        assert [f[0] for f in index.find(doc)] == [f[0] for f in want]
        assert got == [f[1:] for f in want]
        n += len(want)
    assert n > 40


def test_ten_thousand_items_with_one_stem():
    stem = [b"s%d" % k for k in range(14)]
    items = [(i, stem + [b"u%d" % (8 * i + k) for k in range(8)]) for i in range(10_000)]
    index, start = D.Index(items), time.time()
    found = index.find((stem + [b"x"] * 6) * 30)
    assert len(found) == 10_000 and {f[1:] for f in found} == {(14, 0, 0)}
    assert index.find([b"x"] * 100) == [] and time.time() - start < 20


def test_blocks_of_items_give_one_result(spark):
    stem = "one stem that every item of the benchmark shares with all of the others"
    items = spark.createDataFrame([(k, f"{stem} and tail number t{k} of many") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(0, f"Before. {stem} after"), (1, None), (2, "clean"), (3, f"{stem} and tail number t7 of many")],
                                 "doc_id long, text string")
    one = sorted(D.decontaminate(docs, items).collect())
    assert [r["n_items"] for r in one] == [40, 0, 0, 40] and one[3]["item_id"] == 7
    assert sorted(D.decontaminate(docs, items, block_words=200).collect()) == one
    kept = D.keep_clean(docs, items, block_words=200)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
