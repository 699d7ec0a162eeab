"""Packing (2), language ID (5), LM scoring (7), licences (8), token counts (9)."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from divspark.llm import config_lp, license_templates, op9_token_counts as T
from divspark.llm.chunk_tokens import ChunkEncoder
from divspark.llm.license_templates import TEMPLATES
from divspark.llm.noise_contrastive import LogBilinear
from divspark.llm.op2_best_fit_packing import pack
from divspark.llm.op5_language_id import family_of, identify, keep_identified
from divspark.llm.op7_lm_scoring import score
from divspark.llm.op8_license_scan import Scanner, scan
from tests.llm import helpers as H

VOCABULARY = P.path("word_bpe_49k.json")


# ------------------------------------------------------------------ packing

def test_chunk_encoder_equals_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    alphabet = [*"aéÉBz ..,,'\n\t_-<|>0١²ªß§ﬁΣςİé \xa0\x1c\x85", "<|endoftext|>", "'s", ". ", ", ", ".\n", "...",
                "don't ", "é", "漢字"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    want = Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)
    got = ChunkEncoder(VOCABULARY).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_packing_is_whole_gapless_and_tight(spark):
    from tokenizers import Tokenizer

    rows = H.documents()
    got = pack(H.frame(spark), capacity=512).collect()
    tok = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at:at + 512]
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(seqs) == math.ceil(sum(r["length"] for r in got) / 512)
    assert pack(H.frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_configuration_lp_against_lower_bound_and_best_fit(seed):
    rng = random.Random(seed)
    hist = {}
    for _ in range(400):
        x = rng.choice([rng.randint(1, 256), rng.randint(80, 130)])
        hist[x] = hist.get(x, 0) + rng.randint(1, 1000 if seed else 1)
    out = config_lp.pack(hist, 256)
    back = Counter()
    for config, bins in out.items():
        assert bins > 0 and sum(length * n for length, n in config) <= 256
        for length, n in config:
            back[length] += n * bins
    assert back == Counter(hist)
    fit = sum(config_lp.best_fit(hist, 256).values())
    assert sum(out.values()) <= fit * 1.005 + 1
    assert config_lp.pack({}, 256) == {}


# ------------------------------------------------------------------ language ID

def test_language_id_learns_and_marks_undetermined(spark):
    rng = random.Random(2)
    # en and de, fr and es share a family; each language has its own endings
    ends = {"en": ("ing", "tion", "ed"), "de": ("ung", "keit", "ich"), "fr": ("eaux", "ment", "oir"), "es": ("dad", "ción", "ñar")}
    rows = []
    for i in range(400):
        lang = list(ends)[i % 4]
        text = " ".join(rng.choice("bcdfglmprst") + rng.choice("aeiou") + rng.choice(ends[lang]) for _ in range(rng.randint(3, 40)))
        rows.append((i, text, lang, "s", 0))
    rows += [(1000, None, "en", "s", 0), (1001, "123 -- 456", None, "s", 0), (1002, "", "fr", "s", 0), (None, rows[0][1], None, "s", 0),
             (1003, rows[1][1] * 3000, None, "s", 0), (7, rows[7][1], "es", "s", 0)]
    got = identify(H.frame(spark, rows), per_language=50).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, *_ in rows if i is not None and i < 400 and i != 7}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[None]["lang_pred"] == "en" and by[1003]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = keep_identified(H.frame(spark, rows))
    assert kept.columns == H.frame(spark, rows).columns and kept.count() == len(rows) - 3


def test_language_id_without_labels_or_rows(spark):
    rows = [(1, "some words", None, "s", 0), (2, None, None, "s", 0)]
    assert {r["lang_pred"] for r in identify(H.frame(spark, rows)).collect()} == {"und"}
    assert identify(H.frame(spark, [])).count() == 0
    assert family_of("de-AT") == "germanic" and family_of("xx") == "own:xx"


# ------------------------------------------------------------------ LM scoring

def lm_base(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    c = Counter()
    for h, (_, t, *_) in zip(held, rows):
        if not h:
            c.update((t or "").encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for h, (i, t, *_) in zip(held, rows):
        w = [*(t or "").encode().lower().split(), None]
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


@pytest.mark.parametrize("head,classes", [(1 << 17, 64), (20, 8)])
def test_lm_counts_and_base_score(spark, head, classes):
    rows = H.documents()
    got = score(H.frame(spark), head_words=head, classes=classes).collect()
    key = lambda r: (repr(r[0]), r[2], r[5])
    for a, b in zip(sorted((tuple(r)[:6] for r in got), key=key), sorted(lm_base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * abs(b[5]) + 1e-9
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert score(H.frame(spark, [])).count() == 0


def test_lm_learns_order_and_is_normalised(spark):
    rng = random.Random(4)
    nxt = {w: rng.sample(H.WORDS, 2) for w in H.WORDS}
    rows = []
    for i in range(600):
        w = [rng.choice(H.WORDS)]
        while len(w) < 60:
            w.append(rng.choice(nxt[w[-1]]))
        rows.append((i, " ".join(w), "en", "s", 0))
    got = [r for r in score(H.frame(spark, rows, clash=False).coalesce(1), classes=64).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.985 * sum(r["base_score"] for r in got)  # log probabilities: less negative
    m = LogBilinear(np.arange(1, 12).astype(float))
    m.train(np.array([1, 2, 3] * 50), np.array([0, 1, 2] * 50), np.array([2, 3, 4] * 50), 0.2, 1)
    all_targets = [m.log_probabilities(np.array([2]), np.array([1]), np.array([t]))[0] for t in range(11)]
    assert abs(sum(10 ** x for x in all_targets) - 1) < 1e-5


# ------------------------------------------------------------------ licences

def test_license_scan(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
           "documentation files (the \"Software\"), to deal\nin the Software without restriction, including without "
           "limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of "
           "the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following "
           "conditions: The above copyright notice and this permission notice shall be included in all\ncopies or "
           "substantial portions of the Software.")
    texts = ["Some prose.\nLicensed under CC BY-NC 4.0.\nMore prose.", "Released under the MIT License.", mit + "\nThe end.",
             "They asked permission to enter the old house and were told to wait.", None, "",
             "x " * 50000 + "\nThis work is licensed under the GNU General Public License, version 3.",
             "Licensed under the Apache Licence, Version 2.0\nReleased under the MIT License."]
    got = scan(H.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).orderBy("doc_id", "notice").collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [
        (0, "CC-BY-NC-4.0"), (1, "MIT"), (2, "MIT"), (6, "GPL-3.0"), (7, "MIT")] or \
        [(r["doc_id"], r["license"]) for r in got] == [
        (0, "CC-BY-NC-4.0"), (1, "MIT"), (2, "MIT"), (6, "GPL-3.0"), (7, "Apache-2.0"), (7, "MIT")]
    for r in got:
        t = texts[r["doc_id"]]
        assert 0 <= r["first_char"] and r["first_char"] + r["n_chars"] <= len(t) and r["saving"] > 0.3
    whole = next(r for r in got if r["doc_id"] == 2)
    assert whole["missing"] == [] and whole["added"] == [] and whole["n_chars"] == len(mit)
    assert scan(H.frame(spark, [])).count() == 0


def test_license_notices_inside_a_line():
    prose = "The houses by the river were painted again in spring, and "
    for name, wording in TEMPLATES:
        text = prose * 4 + wording + " " + prose * 4
        (first, n, got, saving, share, missing, added), = Scanner().scan(text)
        assert (got, share, missing, added) == (name, 1.0, [], []) and saving > 0.5
        assert text[first:first + n].rstrip(".)") == wording.rstrip(".)")
    two = prose + "it is Licensed under CC BY 4.0. The code is Released under the MIT License. " + prose
    assert [n[2] for n in Scanner().scan(two * 3)] == ["CC-BY-4.0", "MIT"] * 3
    assert Scanner().scan(prose + "they asked permission under the license of the port.") == []


def test_license_notices_of_several_paragraphs():
    mit = license_templates.MIT_TEXT.replace("conditions: The", "conditions:\n\nThe")
    bsd = (license_templates.BSD_TEXT.replace("met: Redis", "met:\n\n1. Redis")
           .replace("disclaimer. Redis", "disclaimer.\n\n2. Redis"))
    apache = (license_templates.APACHE_TEXT.replace("License. You", "License.\nYou")
              .replace("at http", "at\n\n    http").replace("2.0 Unless", "2.0\n\nUnless"))
    for name, text in (("MIT", mit), ("BSD", bsd), ("Apache-2.0", apache)):
        assert "\n\n" in text
        (first, n, got, _, share, missing, added), = Scanner().scan(f"Copyright 2020 A. Person\n\n{text}\n\nThe rest.")
        assert (got, share, missing, first, n) == (name, 1.0, [], 26, len(text))
        assert added == (["1", "2"] if name == "BSD" else [])
        commented = "\n".join(f" * {line}".rstrip() for line in text.split("\n"))
        assert [x[2] for x in Scanner().scan(f"/*\n{commented}\n */\nint main")] == [name]


# ------------------------------------------------------------------ token counts

@pytest.mark.parametrize("rule", T.RULES)
def test_token_counts_against_brute_force(spark, rule):
    rows = H.documents() + [(90, "a\n\n\nb  \n c\n", "en", "s", 0), (91, "\n\n", "en", None, 0), (92, "é\n漢", "en", "x", 0)]
    got = T.count_tokens(H.frame(spark, rows), fields=("source", "text"), rule=rule).collect()
    enc = T.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = Counter()
    for i, text, _, source, _ in rows:
        lines = [("source", 0, (source or "") + "\n")]
        parts = (text or "").splitlines(keepends=True) if "\x0b" not in (text or "") else [text]
        parts = [p for p in (text or "").replace("\n", "\n\0").split("\0")]
        if len(parts) > 1 and parts[-1] == "":
            parts.pop()
        lines += [("text", k, p) for k, p in enumerate(parts)]
        spans, at = [], 0
        for *_, p in lines:
            spans.append((at, at + len(p.encode())))
            at = spans[-1][1]
        count, begin = [0] * len(lines), 0
        for end in enc.ends("".join(p for *_, p in lines)).tolist():
            held = [max(0, min(end, b) - max(begin, a)) for a, b in spans]
            inside = [k for k, h in enumerate(held) if h]
            own = inside[0] if rule == "start" else inside[-1] if rule == "end" else held.index(max(held))
            count[own] += 1
            begin = end
        for (f, k, p), (a, b), c in zip(lines, spans, count):
            want[(i, f, k, a, b - a, len(p), c)] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert T.count_tokens(H.frame(spark, [])).count() == 0


def test_token_ids_of_long_white_space_runs(monkeypatch):
    """Cut runs give the ids of the whole text (fuzzed where the library can read it), and
    a run of more than a million is read at all."""
    import random
    import re

    import public_tokenizers as vocabularies

    from divspark.llm import op9_token_counts as TC
    enc = TC.SpanEncoder(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
    monkeypatch.setattr(TC, "LONG_RUN", re.compile(TC.LONG_RUN.pattern.replace("10000", "5")))
    whole = enc.encoding

    class Failing:
        """Fails on runs of five like the library on very long ones."""
        _encode_single_piece = staticmethod(whole._encode_single_piece)

        @staticmethod
        def encode_to_numpy(text):
            if TC.LONG_RUN.search(text):
                raise ValueError("stack")
            return whole.encode_to_numpy(text)
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice([" " * rng.randint(1, 9), "\n" * rng.randint(1, 7), "\t \n", "ab", "x.", "7", "é", "!\n", "'s"])
                       for _ in range(rng.randint(1, 12)))
        want = whole.encode_to_numpy(text).tolist()
        enc.encoding = Failing
        assert enc.ids(text).tolist() == want, repr(text)
        enc.encoding = whole
    monkeypatch.undo()
    long = "a word" + " " * 1_200_000 + "another" + "\n" * 1_200_000
    assert enc.ends(long)[-1] == len(long)
