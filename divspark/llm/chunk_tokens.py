"""Token ids of whole texts through their white-space chunks.

For a tokenizer that drops white space and never lets a token cross it, the ids
of a text are the ids of its chunks in order.  A worker remembers the ids of
chunks, so the library is asked once per new chunk; memory is bounded by the
entry limit (a full memory is emptied, nothing is lost).
"""

from __future__ import annotations

import json
import re

import numpy as np

MAX_CHUNKS = 900_000
ASK = 2000  # chunks in one call of the library

#: Whether a chunk is letters of ASCII and Latin-1 alone, which every Unicode version agrees on.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch

#: Latin-1 marks (neither letters, digits nor white space) as 1, the rest as 0.
MARKS = bytes(bool(re.match(r"[^\w\t-\r \x85\xa0]|_", chr(c))) for c in range(256))


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit bytes, per text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        # between two chunks of one call stands a special token, where the library
        # cuts the text before anything else; a chunk that may hold one goes alone
        self.cut_id, self.cut = next(((i, t.content) for i, t in special.items() if t.special), (None, ""))
        self.marks = {t.content[0].encode() for t in special.values()}
        self.lower = '"Lowercase"' in self.tokenizer.to_str()
        # ids that end a word, where the vocabulary marks them; a run of letters is one word
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(k) or "").endswith(suffix)
                              for k in range(self.tokenizer.get_vocab_size())])
        self.chunks: dict[bytes, bytes] = {}

    def prepare(self, text: bytes) -> bytes:
        """A text with the same ids and fewer different chunks.  In Latin-1 texts of a
        lower-casing vocabulary letters can be lowered beforehand, and a stop or comma
        at the end of a chunk may stand alone unless it touches another mark."""
        if not self.lower:
            return text
        plain = text.decode()
        try:
            latin = plain.encode("latin-1")
        except UnicodeEncodeError:
            return text
        if any(m in text for m in self.marks):
            return text
        plain = plain.lower()
        if b"\1\1" not in latin.translate(MARKS):
            plain = (plain.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
                     .replace(",\n", " ,\n"))
        return plain.encode()

    def _ask(self, chunks: list[bytes]) -> list[bytes]:
        if self.cut_id is None or len(chunks) == 1:
            got = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
            return [np.array(e.ids, dtype="<u4").tobytes() for e in got]
        joined = self.cut.join([c.decode() for c in chunks])
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.append(np.flatnonzero(ids == self.cut_id), len(ids))
        starts = np.append([0], ends[:-1] + 1)
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _ask_words(self, words: list[bytes]) -> list[bytes] | None:
        """Ids of words of letters only, told apart by the ids that end a word; None if
        they are not as many as the words."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids,
                       dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return None
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, new: list[bytes]) -> None:
        plain = []
        if self.ends.any():
            words = [c for c in new if LETTERS(c)]
            for at in range(0, len(words), ASK):
                part = words[at:at + ASK]
                got = self._ask_words(part)
                self.chunks.update(zip(part, got or self._ask(part), strict=True))
            new = [c for c in new if c not in self.chunks]
        for c in new:
            if any(m in c for m in self.marks):
                self.chunks[c] = self._ask([c])[0]
            else:
                plain.append(c)
        for at in range(0, len(plain), ASK):
            part = plain[at:at + ASK]
            self.chunks.update(zip(part, self._ask(part), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):  # as many texts at a time as keep the new chunks well within the limit
            split, new = [], set()
            while at < len(texts) and len(new) < MAX_CHUNKS // 8:
                pieces = self.prepare(texts[at]).split()
                new |= set(pieces).difference(self.chunks)
                split.append(pieces)
                at += 1
            if len(self.chunks) + len(new) > MAX_CHUNKS:
                self.chunks.clear()
                new = set().union(*split)
            self._learn(list(new))
            get = self.chunks.__getitem__
            out.extend(b"".join(map(get, pieces)) for pieces in split)
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
