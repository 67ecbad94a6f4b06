"""Conditional random fields in numpy: a linear chain with exact inference, trained by full-batch gradient ascent.

Every item of a chain has features of all labels and, if wanted, lexical features that speak for one label only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class FeatureIndex:
    """Numbers for feature names; names first met after ``freeze`` are dropped."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.frozen = False

    def __call__(self, names: list[str]) -> list[int]:
        if self.frozen:
            return [i for n in names if (i := self.ids.get(n)) is not None]
        return [self.ids.setdefault(n, len(self.ids)) for n in names]

    def freeze(self) -> None:
        self.frozen = True

    def __len__(self):
        return len(self.ids)


@dataclass
class Sparse:
    """Features of items: feature ``feat[k]`` of item ``item[k]``, items ascending; each counts ``value[k]`` or 1."""

    item: np.ndarray
    feat: np.ndarray
    items: int
    features: int
    value: np.ndarray | None = None

    def __post_init__(self):
        self.order = None

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each item's features."""
        w = weights[self.feat]
        if self.value is not None:
            w = w * (self.value if w.ndim == 1 else self.value[:, None])
        return _sum_by(self.item, w, self.items)

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        """Sum of the residuals of the items of each feature."""
        if self.order is None:
            self.order = np.argsort(self.feat, kind="stable")
            self.by = self.feat[self.order]
        r = residual[self.item[self.order]]
        if self.value is not None:
            r = r * (self.value[self.order] if r.ndim == 1 else self.value[self.order][:, None])
        return _sum_by(self.by, r, self.features)


def _sum_by(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by ascending keys."""
    out = np.zeros((n, *values.shape[1:]))
    if len(key):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        out[key[first]] = np.add.reduceat(values, first, axis=0)
    return out


def sparse(features: list[list[int]], n: int) -> Sparse:
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    flat = np.concatenate([np.asarray(f, dtype=np.int64) for f in features]) if len(features) else np.zeros(0, np.int64)
    return Sparse(np.repeat(np.arange(len(features)), lengths), flat, len(features), n)


def emissions(features: list[list[int]], weights: np.ndarray) -> np.ndarray:
    """Sum of each item's feature weights: (items, labels)."""
    return sparse(features, len(weights)).scores(weights)


def _pad(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    longest = int(lengths.max())
    mask = np.arange(longest)[None, :] < lengths[:, None]
    out = np.zeros((len(lengths), longest, *flat.shape[1:]), dtype=flat.dtype)
    out[mask] = flat
    return out, mask


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best labels of all chains, flat. Chains of like length advance together, so one long chain costs only itself."""
    out = np.zeros(len(scores), dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 512)):
        part = part[lengths[part] > 0]
        if not len(part):
            continue
        own = lengths[part]
        index = np.repeat(starts[part] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        e, mask = _pad(scores[index], own)
        best, back = e[:, 0].copy(), np.zeros(e.shape[:2] + (e.shape[2],), dtype=np.int8)
        for t in range(1, e.shape[1]):
            all_ = best[:, :, None] + transitions[None]
            back[:, t] = all_.argmax(axis=1)
            step = all_.max(axis=1) + e[:, t]
            best = np.where(mask[:, t][:, None], step, best)
        at = best.argmax(axis=1)
        labels = np.zeros(e.shape[:2], dtype=np.int64)
        rows = np.arange(len(part))
        for t in range(e.shape[1] - 1, -1, -1):
            labels[:, t] = at
            if t:
                at = np.where(mask[:, t], back[rows, t, at], at)
        out[index] = labels[mask]
    return out


def train_chain(features: Sparse | list[list[int]], labels: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int, *, lexical: tuple[Sparse, int] | None = None, free: np.ndarray | None = None, rounds: int = 80, rate: float = 0.3, l2: float = 2e-4, lexical_l2: float = 2e-5):
    """(feature weights, transitions) of the maximum-likelihood linear chain, and with ``lexical`` (features, their
    label) also the weights of those; weights where ``free`` is 0 stay 0; deterministic."""
    feats = features if isinstance(features, Sparse) else sparse(features, n_features)
    params = {"w": np.zeros((n_features, n_labels)), "t": np.zeros((n_labels, n_labels))}
    if lexical:
        params["x"] = np.zeros(lexical[0].features)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    gold = np.eye(n_labels)[labels]
    order = np.argsort(lengths, kind="stable")
    starts = np.cumsum(lengths) - lengths
    parts = []  # chains of like length together: one long chain doesn't widen the others
    for p in np.array_split(order, max(1, len(order) // 256)):
        own = lengths[p]
        index = np.repeat(starts[p] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        lab, mask = _pad(labels[index], own)
        both = mask[:, 1:] & mask[:, :-1]
        gold_t = np.zeros((n_labels, n_labels))
        np.add.at(gold_t, (lab[:, :-1][both], lab[:, 1:][both]), 1)
        parts.append((own, index, mask, both, gold_t))
    n = len(lengths)
    for step in range(1, rounds + 1):
        flat, tr = feats.scores(params["w"]), params["t"]
        if lexical:
            flat[:, lexical[1]] += lexical[0].scores(params["x"])
        own_p, gt = np.zeros_like(gold), np.zeros_like(tr)
        for own, index, mask, both, gold_t in parts:
            e, _ = _pad(flat[index], own)
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, e.shape[1]):
                fwd[:, t] = np.where(mask[:, t][:, None], _logsumexp(fwd[:, t - 1][:, :, None] + tr[None], 1) + e[:, t], fwd[:, t - 1])
            for t in range(e.shape[1] - 2, -1, -1):
                bwd[:, t] = np.where(mask[:, t + 1][:, None], _logsumexp(tr[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0.0)
            z = _logsumexp(fwd[:, -1], 1)
            own_p[index] = np.exp(fwd + bwd - z[:, None, None])[mask]
            if e.shape[1] > 1:
                pair = np.exp(fwd[:, :-1, :, None] + tr[None, None] + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
                gt += gold_t - pair[both].sum(axis=0)
        residual = gold - own_p
        grads = {"w": feats.gradient(residual) * (1 if free is None else free), "t": gt}
        if lexical:
            grads["x"] = lexical[0].gradient(residual[:, lexical[1]])
        for k, x in params.items():
            m, v = moments[k]
            g = grads[k] / n - (lexical_l2 if k == "x" else l2) * x
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return (params["w"], params["t"], params["x"]) if lexical else (params["w"], params["t"])
