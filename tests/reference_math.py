"""The model's formulas in NumPy, one at a time and without sharing code with the engine."""

from __future__ import annotations

import numpy as np


def loss_gradient(y, x, w, regularizer=0.0):
    m = y * (x @ w)
    loss = np.logaddexp(0, -m).sum() + regularizer / 2 * w @ w
    return loss, (-y / (1 + np.exp(m))) @ x + regularizer * w


def search(y, x, w, p, start, phi0, slope, regularizer):
    trials, alpha = 0, start
    while True:
        trials += 1
        if loss_gradient(y, x, w + alpha * p, regularizer)[0] <= phi0 + 1e-4 * alpha * slope:
            return alpha, trials
        alpha /= 2


def descend(y, x, algo, iters, start, regularizer, w0=0.0):
    """[(loss, gradient norm, trials, step)] of bgd, cgd or textbook lbfgs with memory 5."""
    w, step, out, old = np.full(x.shape[1], w0), start, [], None
    pairs = []
    for _ in range(iters):
        loss, g = loss_gradient(y, x, w, regularizer)
        p = -g
        if old and algo == "cgd":
            p = -g + (g @ g) / (old[0] @ old[0]) * old[1]
        if old and algo == "lbfgs":
            pairs = (pairs + [(w - old[2], g - old[0])])[-5:]
            q, alphas = g.copy(), []
            for s, t in pairs[::-1]:
                a = s @ q / (s @ t)
                alphas.append(a)
                q -= a * t
            s, t = pairs[-1]
            r = (s @ t) / (t @ t) * q
            for (s, t), a in zip(pairs, alphas[::-1], strict=True):
                r += (a - t @ r / (s @ t)) * s
            p = -r
        begin = 1.0 if algo == "lbfgs" else step
        alpha, trials = search(y, x, w, p, begin, loss, g @ p, regularizer)
        out.append((loss, np.sqrt(g @ g), trials, alpha))
        old = (g, p, w)
        step = 1.2 * alpha
        w = w + step * p
    return out, w
