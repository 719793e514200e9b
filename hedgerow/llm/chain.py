"""Forward-backward over linear chains, for many sequences laid end to end."""

from __future__ import annotations

import numpy as np


def marginals(emission: np.ndarray, fresh: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Posterior label probabilities (n, labels) of the words, and with ``pairs`` the expected label pairs.

    ``emission`` (n, labels) and ``moves`` (labels, labels) are log potentials; ``fresh`` marks the first word of each
    sequence. The words are cut into runs of equal length that advance together: the product of a run's matrices carries
    a message through it, so a long text costs no more steps than many short ones.
    """
    n, labels = emission.shape
    length = max(8, int(np.sqrt(n) / 2))
    runs = -(-n // length)
    e = np.ones((runs * length, labels))
    e[:n] = np.exp(emission - emission.max(axis=1, keepdims=True))
    new = np.ones(runs * length, bool)
    new[:n] = fresh
    e, new = e.reshape(runs, length, labels), new.reshape(runs, length)
    a = np.exp(moves - moves.max())

    product = np.broadcast_to(np.eye(labels), (runs, labels, labels)).copy()
    for t in range(length):
        product = np.where(new[:, t, None, None], product.sum(axis=2, keepdims=True), product @ a) * e[:, t, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)
    left = np.full((runs, labels), 1 / labels)
    for c in range(1, runs):
        v = left[c - 1] @ product[c - 1]
        left[c] = v / v.sum()
    right = np.full((runs, labels), 1 / labels)
    for c in range(runs - 2, -1, -1):
        v = product[c + 1] @ right[c + 1]
        right[c] = v / v.sum()

    alpha = np.empty_like(e)
    v = left
    for t in range(length):
        v = np.where(new[:, t, None], 1.0, v @ a) * e[:, t]
        v /= v.sum(axis=1, keepdims=True)
        alpha[:, t] = v
    beta = np.empty_like(e)
    v = right
    for t in range(length - 1, -1, -1):
        beta[:, t] = v
        v = v * e[:, t]
        v = np.where(new[:, t, None], v.sum(axis=1, keepdims=True), v @ a.T)
        v /= v.sum(axis=1, keepdims=True)
    both = (alpha * beta).reshape(-1, labels)[:n]
    both /= both.sum(axis=1, keepdims=True)
    if not pairs:
        return both
    alpha, after = alpha.reshape(-1, labels)[: n - 1], (e * beta).reshape(-1, labels)[1:n]
    joint = alpha[:, :, None] * a * after[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return both, joint[~fresh[1:]].sum(axis=0)
