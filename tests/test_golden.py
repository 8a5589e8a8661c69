"""A published training trace, over a published pair of tables.

The tables are not part of this repository.  ``NORMLEARN_GOLDEN_DIR`` names a folder
with their plain text files ``s`` (500 rows, 3 features) and ``r`` (50 rows, 7
features); without it the tests are skipped.
"""

from __future__ import annotations

import os

import numpy as np
import pytest

from normlearn.operators import train as T
from normlearn.operators.data import normalized
from normlearn.plans import gradient as G
from normlearn.sources import text
from normlearn.sources.spec import TrainSpec

FOLDER = os.environ.get("NORMLEARN_GOLDEN_DIR")
pytestmark = pytest.mark.skipif(not FOLDER, reason="NORMLEARN_GOLDEN_DIR is not set")

# iteration's loss, gradient norm, trials and step of conjugate gradients (lambda 2, w 0, first step 1).
CGD = [
    (346.57359028, 162.285997719, 5, 0.0625),
    (349.032833624, 39.1983721457, 1, 0.075),
    (252.60140221, 31.4414696823, 1, 0.09),
    (148.725240852, 12.0830716388, 1, 0.108),
    (142.252534782, 12.975558672, 2, 0.0648),
    (142.210343258, 10.5140567449, 2, 0.03888),
    (141.888086138, 8.84619934491, 1, 0.046656),
    (140.176129699, 7.73574044622, 1, 0.0559872),
    (138.065692169, 4.2046678939, 1, 0.06718464),
    (137.76905631, 2.6194187041, 1, 0.080621568),
]
# Losses of the other methods with the same parameters.
LOSSES = {
    "bgd": [346.57359028, 349.03283362, 227.93945047, 156.32109066, 139.31017191, 138.22298254, 137.51102691, 137.44360594, 137.41081504, 137.40209851],
    "lbfgs_compat": [346.57359028, 349.03283362, 339.76741452, 339.38595666, 339.30811065, 339.30693577, 339.30678701, 140.69931582, 141.61816017, 141.40360324],
    "lbfgs": [346.57359028, 349.03283362, 251.41217786, 167.88736593, 185.45844529, 145.30395994, 137.61773529, 137.49056617, 137.41787071, 137.39563775],
}


@pytest.fixture(scope="module")
def data(spark):
    return normalized(text.read_plain_s(spark, f"{FOLDER}/s"), text.read_plain_r(spark, f"{FOLDER}/r"))


def spec(algo, approach):
    return TrainSpec(algo=algo, approach=approach, iters=10, w_init=0.0, stepsize=1.0, regularizer=2.0, srsplits=3)


@pytest.mark.parametrize("approach", ["f", "s", "sr", "m", "fsql"])
def test_conjugate_gradients(data, approach):
    trace = T.fit(data, spec("cgd", approach)).trace
    assert [(t[3], round(t[4], 12)) for t in trace] == [(n, a) for _, _, n, a in CGD]
    assert np.array([t[1:3] for t in trace]) == pytest.approx(np.array([c[:2] for c in CGD]), abs=1e-8)


@pytest.mark.parametrize("algo", sorted(LOSSES))
def test_other_methods(data, algo):
    assert [t[1] for t in T.fit(data, spec(algo, "f")).trace] == pytest.approx(LOSSES[algo], abs=1e-6)


def test_flat_rows(data):
    trace = T.fit_rows(G.denormalized(data), spec("cgd", "t")).trace
    assert np.array([t[1:3] for t in trace]) == pytest.approx(np.array([c[:2] for c in CGD]), abs=1e-8)
