"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
from collections import defaultdict

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
         "phi chi psi omega river stone cloud forest meadow harbor").split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 30)}" for _ in range(n))


def documents(seed: int = 0) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, ties, repeated rows,
    null and empty texts, null ids, a very long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(30):
        rows.append([i, sentence(rng, rng.randint(1, 60))])
    base = sentence(rng, 80).split()
    for i in range(30, 50):  # near copies of one text
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append([i, " ".join(w)])
    rows += [[50, rows[3][1]], [51, rows[3][1].replace(" ", "\n")], [52, "  " + rows[3][1] + " \t"], [53, rows[4][1].upper()]]
    rows += [[60, None], [61, ""], [62, " \n\t"], [63, None], [None, rows[5][1]], [None, None], [None, "only null id here"]]
    rows += [[70, "one"], [71, "ONE"], [72, "one two"], [73, "été À l'ÉCOLE ñ 漢字  x"], [74, "12 34 -- !!"]]
    rows += [[80, sentence(rng, 9000)], [3, rows[3][1]], [3, rows[3][1]], [61, "same id, other text"]]
    langs = ["en", "fr", "de", None]
    return [(i, t, langs[k % 4], f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, clash: bool = True):
    """The documents, with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)
    if clash:
        for name in ("row", "key", "hash", "n", "run", "digest", "kept", "length", "bucket", "gram", "c0", "probe",
                     "html", "__id", "rank", "score", "held_out"):
            df = df.withColumn(name, df["doc_id"].cast("string"))
    return df


def shingles(text: str | None, n: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(sets: list[frozenset], num: int, den: int) -> list[int]:
    """Component number of every row, by comparing all pairs."""
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    return [root(k) for k in range(len(sets))]


def groups(pairs) -> list[tuple]:
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return sorted(tuple(sorted(v, key=repr)) for v in out.values())
