"""Non-negative positive-unlabelled learning for linear models, in numpy.

The risk is the one of Kiryo et al. (2017): with trusted positives P, unlabelled rows U and a class prior p,

    risk = p * mean_P loss(+1) + max(0, mean_U loss(-1) - p * mean_P loss(-1))

The second term estimates the risk on negatives from rows that have no label. A flexible model can push that estimate
below zero, which a risk cannot be; then the step goes against the estimate's gradient until it is not negative.
The loss is logistic, so that the fitted score is an estimate of P(positive | row).
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Linear:
    """Standardised inputs, weights and intercept; a row's score is the sigmoid of its margin."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def prior_from_labels(positive: int, labelled: int) -> float:
    """Share of positives among labelled training rows, kept off 0 and 1 (one added to each side)."""
    return (positive + 1.0) / (labelled + 2.0)


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05,
             l2: float = 1e-4, beta: float = 0.0, standardise: bool = True) -> Linear:
    """Full-batch Adam on the non-negative risk. Deterministic: no random draw is made here.

    Without positives every row scores the prior; so it does without unlabelled rows.
    """
    d = pos.shape[1] if pos.ndim == 2 else unl.shape[1]
    both = np.concatenate([pos, unl]) if len(pos) and len(unl) else np.zeros((1, d))
    mean, scale = both.mean(0), both.std(0)
    scale = np.where((scale > 1e-9) & standardise, scale, 1.0)
    w, b = np.zeros(d), float(np.log(prior / (1 - prior)))
    if not len(pos) or not len(unl):
        return Linear(mean, scale, w, b)
    p, u = ((pos - mean) / scale).astype(np.float32), ((unl - mean) / scale).astype(np.float32)
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w.astype(np.float32) + b, u @ w.astype(np.float32) + b
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, uu = prior * (sp - 1) / len(p), su / len(u)          # gradients of loss(+1) on P and loss(-1) on U
        back = prior * sp / len(p)                               # gradient of prior * loss(-1) on P
        if negative >= -beta:
            gp, gu = up - back, uu
        else:                                                    # the estimate went below zero: undo, by the plain rule
            gp, gu = back, -uu
        g = np.append(p.T @ gp.astype(np.float32) + u.T @ gu.astype(np.float32), gp.sum() + gu.sum())
        g[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], float(b - step[-1])
    return Linear(mean, scale, w, b)
