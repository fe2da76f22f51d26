"""FTRL-proximal against a plain loop over dictionaries."""

import math
import random

import numpy as np
import pytest

from ebbflow.llm import toxicity


def plain(rows, cfg):
    z, n = {}, {}

    def weight(k):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        if k != cfg.dims and abs(zk) <= cfg.l1:
            return 0.0
        return -(zk - (math.copysign(cfg.l1, zk) if k != cfg.dims else 0.0)) / ((cfg.beta + math.sqrt(nk)) / cfg.alpha + cfg.l2)

    for _ in range(cfg.epochs):
        for features, label in rows:
            x = {int(k): (1.0 if k < cfg.dims // 4 else cfg.pair_value) for k in features} | {cfg.dims: 1.0}
            w = {k: weight(k) for k in x}
            p = 1.0 / (1.0 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                grown = n.get(k, 0.0) + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(grown) - math.sqrt(n.get(k, 0.0))) / cfg.alpha * w[k]
                n[k] = grown
    return {k: weight(k) for k in z}


@pytest.mark.parametrize("l1", [0.0, 0.5])
def test_training_equals_a_plain_loop(l1):
    r = random.Random(1)
    cfg = toxicity.FtrlConfig(dims=256, l1=l1, epochs=3)
    rows = []
    for _ in range(120):
        label = int(r.random() < 0.4)
        features = {r.randrange(256) for _ in range(12)} | ({7, 200} if label and r.random() < 0.9 else set())
        rows.append((np.array(sorted(features), np.uint32), label))
    rows.append((np.zeros(0, np.uint32), 0))
    got, expected = toxicity.train(rows, cfg), plain(rows, cfg)
    assert all(got[k] == pytest.approx(w, abs=1e-9) for k, w in expected.items())
    assert np.count_nonzero(got) == sum(w != 0 for w in expected.values()) and got[7] > 0.5
    assert (np.count_nonzero(got) < 40) == (l1 > 0)
