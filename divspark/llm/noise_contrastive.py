"""Log-bilinear language model over a bounded vocabulary, in numpy.

The model predicts an output class from the two classes before it: the context
vector is ``r[c1] @ A1 + r[c2] @ A2`` and a class scores its product with the
target vector plus a bias.  It is trained by noise-contrastive estimation with
the unigram distribution as noise (samples shared by a minibatch, so every step
is a few matrix products) and evaluated with exact normalisation.
"""

from __future__ import annotations

import numpy as np

NOISE = 64
BATCH = 2048
LIMIT = 0.1  # of one step of one parameter


class LogBilinear:
    def __init__(self, unigram: np.ndarray, dim: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = len(unigram)
        self.unigram = (unigram / unigram.sum()).astype(np.float64)
        self.params = {
            "r": rng.normal(0, 0.1, (size, dim)).astype(np.float32),  # context vectors
            "q": rng.normal(0, 0.1, (size, dim)).astype(np.float32),  # target vectors
            "a": np.stack([np.eye(dim), np.eye(dim) / 2]).astype(np.float32),
            "b": np.log(self.unigram).astype(np.float32),
        }

    def context(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        p = self.params
        return p["r"][c1] @ p["a"][0] + p["r"][c2] @ p["a"][1]

    def train(self, c1: np.ndarray, c2: np.ndarray, target: np.ndarray, rate: float, seed: int) -> None:
        """One pass over (context, target) rows in order, minibatch gradient steps."""
        p, rng = self.params, np.random.default_rng(seed)
        size, dim = p["r"].shape
        cumulative = np.cumsum(self.unigram)
        offset = np.log(NOISE * self.unigram).astype(np.float32)
        cells = np.arange(dim)

        def scatter(rows: np.ndarray, grad: np.ndarray) -> np.ndarray:
            at = (rows[:, None] * dim + cells).ravel()
            return np.bincount(at, weights=grad.ravel(), minlength=size * dim).reshape(size, dim).astype(np.float32)

        for at in range(0, len(target), BATCH):
            x1, x2, t = c1[at:at + BATCH], c2[at:at + BATCH], target[at:at + BATCH]
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), size - 1)
            h, qt, qn = self.context(x1, x2), p["q"][t], p["q"][noise]
            # gradients of the log likelihood of data against noise
            gt = 1 / (1 + np.exp(np.clip((h * qt).sum(1) + p["b"][t] - offset[t], -30, 30)))
            gn = -1 / (1 + np.exp(-np.clip(h @ qn.T + p["b"][noise] - offset[noise], -30, 30)))
            gh = gt[:, None] * qt + gn @ qn
            dq = scatter(t, gt[:, None] * h)
            np.add.at(dq, noise, gn.T @ h)
            db = np.bincount(t, weights=gt, minlength=size)
            np.add.at(db, noise, gn.sum(0))
            r1, r2 = p["r"][x1], p["r"][x2]
            dr = scatter(x1, gh @ p["a"][0].T) + scatter(x2, gh @ p["a"][1].T)
            da = np.stack([r1.T @ gh, r2.T @ gh])
            # a row's step is scaled by how often the minibatch can be expected to hold it
            scale = (1 / np.sqrt(self.unigram * len(t) + 1))[:, None].astype(np.float32)
            size_of = rate / np.sqrt(len(t)) * scale
            p["q"] += np.clip(size_of * dq, -LIMIT, LIMIT)
            p["r"] += np.clip(size_of * dr, -LIMIT, LIMIT)
            p["b"] += np.clip(size_of[:, 0] * db, -LIMIT, LIMIT).astype(np.float32)
            p["a"] += np.clip(rate / len(t) * da, -LIMIT, LIMIT).astype(np.float32)

    def log_probabilities(self, c1: np.ndarray, c2: np.ndarray, target: np.ndarray,
                          rows: int = 1024) -> np.ndarray:
        """Normalised log10 probabilities: equal contexts are computed once, in
        batches of matrix products over the whole vocabulary."""
        size = len(self.unigram)
        code, back = np.unique(c1.astype(np.int64) * size + c2, return_inverse=True)
        logz = np.empty(len(code), dtype=np.float32)
        p = self.params
        h = self.context(code // size, code % size)
        for at in range(0, len(code), rows):
            s = h[at:at + rows] @ p["q"].T + p["b"]
            top = s.max(axis=1)
            logz[at:at + rows] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        score = np.einsum("ij,ij->i", h[back], p["q"][target]) + p["b"][target]
        return (score - logz[back]).astype(np.float64) / np.log(10)
