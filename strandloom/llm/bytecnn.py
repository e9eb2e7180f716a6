"""A convolutional network over bytes in numpy: filters of several widths, max
pooling, one dense layer. Shared by language identification and quality.

Byte 0 pads and has a zero embedding. Training is deterministic for a given
seed and input order. The gradient of max pooling touches one window for each
filter, so the backward pass costs little beside the forward pass.
"""

from __future__ import annotations

import numpy as np

WIDTHS = ((2, 8), (3, 12), (4, 12))  # width, filters
DIM = 8
SPAN = max(w for w, _ in WIDTHS)
FILTERS = sum(n for _, n in WIDTHS)
#: Chunks whose responses are in memory at once.
BLOCK = 128


class ByteCNN:
    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "emb": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "conv": rng.normal(0, 0.25, (SPAN * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "dense": rng.normal(0, 0.2, (FILTERS, classes)).astype(np.float32),
            "out": np.zeros(classes, np.float32),
        }
        self.mask = np.zeros((SPAN * DIM, FILTERS), np.float32)
        at = 0
        for width, n in WIDTHS:
            self.mask[: width * DIM, at : at + n] = 1
            at += n
        self.p["emb"][0] = 0
        self.p["conv"] *= self.mask

    def _convolved(self, codes: np.ndarray) -> np.ndarray:
        """(chunks, positions, filters) of (chunks, length) bytes."""
        n, length = codes.shape
        emb = self.p["emb"][codes]
        rows = np.lib.stride_tricks.sliding_window_view(emb.reshape(n, length * DIM), SPAN * DIM, axis=1)[:, ::DIM]
        return (rows.reshape(-1, SPAN * DIM) @ self.p["conv"]).reshape(n, length - SPAN + 1, FILTERS)

    def _pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, filters): where each filter responds most in each chunk, and how much."""
        best, top = [np.zeros((0, FILTERS), np.int64)], [np.zeros((0, FILTERS), np.float32)]
        for k in range(0, len(codes), BLOCK):
            response = self._convolved(codes[k : k + BLOCK])
            best.append(response.argmax(axis=1))
            top.append(np.take_along_axis(response, best[-1][:, None, :], axis=1)[:, 0])
        return np.concatenate(best), np.concatenate(top)

    def features(self, codes: np.ndarray) -> np.ndarray:
        """(chunks, filters): each filter's largest response in each chunk."""
        top = [self._convolved(codes[k : k + BLOCK]).max(axis=1) for k in range(0, len(codes), BLOCK)]
        return np.maximum(np.concatenate(top) + self.p["bias"], 0) if top else np.zeros((0, FILTERS), np.float32)

    def logits(self, features: np.ndarray) -> np.ndarray:
        return features @ self.p["dense"] + self.p["out"]

    def fit(self, groups: list[np.ndarray], labels: np.ndarray, epochs: int, batch: int, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        """Each group of chunks is one example; its features are its chunks' mean."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(groups) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(groups))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                grads = self._gradients([groups[i] for i in own], labels[own])
                step += 1
                now = rate * min(1, 2 * (1 - (step - 1) / steps))
                for name, g in grads.items():
                    mean[name] += 0.1 * (g - mean[name])
                    square[name] += 0.01 * (g * g - square[name])
                    self.p[name] -= now * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-7)
                self.p["emb"][0] = 0
        return self

    def _gradients(self, groups: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        sizes = np.array([len(g) for g in groups])
        owner = np.repeat(np.arange(len(groups)), sizes)
        codes = np.concatenate(groups)
        best, top = self._pooled(codes)
        top = top + self.p["bias"]
        feats = np.maximum(top, 0)
        share = (1 / sizes)[owner].astype(np.float32)
        joined = np.zeros((len(groups), FILTERS), np.float32)
        np.add.at(joined, owner, feats * share[:, None])
        scores = self.logits(joined)
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        odds[np.arange(len(labels)), labels] -= 1
        odds /= len(labels)
        back = (odds @ self.p["dense"].T)[owner] * share[:, None] * (top > 0)
        emb, conv = np.zeros((256, DIM)), np.zeros_like(self.p["conv"])
        for k in range(0, len(codes), BLOCK):
            own, pulled = codes[k : k + BLOCK], back[k : k + BLOCK]
            where = own[np.arange(len(own))[:, None, None], best[k : k + BLOCK, :, None] + np.arange(SPAN)]  # (chunks, filters, SPAN)
            seen = self.p["emb"][where].reshape(len(own), FILTERS, SPAN * DIM)
            to_emb = (pulled[:, :, None] * self.p["conv"].T[None]).reshape(-1, DIM)
            flat = where.reshape(-1)
            emb += np.stack([np.bincount(flat, to_emb[:, d], 256) for d in range(DIM)], axis=1)
            conv += np.einsum("nf,nfk->kf", pulled, seen) * self.mask
        return {
            "emb": emb.astype(np.float32),
            "conv": conv,
            "bias": back.sum(axis=0),
            "dense": joined.T @ odds + 1e-4 * self.p["dense"],
            "out": odds.sum(axis=0),
        }


def softmax(scores: np.ndarray) -> np.ndarray:
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def chunked(texts: list[str], length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that cover each text whole: bytes, the text of each, its real bytes.

    An empty text has one chunk of padding, which counts as one byte.
    """
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    n = np.array([1 if len(r) <= length else -(-(len(r) - length) // stride) + 1 for r in raw], np.int64)
    codes = np.zeros((int(n.sum()), length), np.uint8)
    weight = np.empty(len(codes), np.float64)
    at = 0
    for r, k in zip(raw, n.tolist(), strict=True):
        padded = np.zeros((k - 1) * stride + length, np.uint8)
        padded[: len(r)] = r
        codes[at : at + k] = np.lib.stride_tricks.as_strided(padded, (k, length), (stride, 1))
        weight[at : at + k] = length
        weight[at + k - 1] = max(1, len(r) - (k - 1) * stride)
        at += k
    return codes, np.repeat(np.arange(len(raw)), n), weight


def averaged(values: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weighted means of the rows of each owner."""
    total = np.bincount(owner, weight, n)
    return np.stack([np.bincount(owner, weight * values[:, c], n) for c in range(values.shape[1])], axis=1) / total[:, None]
