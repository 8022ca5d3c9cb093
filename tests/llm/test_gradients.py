"""The first step of the classifier's fit against finite differences of its loss, factors included."""

import numpy as np

from siltstone.llm import classifier


def test_first_step_goes_down_by_finite_differences():
    rng, dims, rank = np.random.default_rng(2), 12, 3
    rows = [(np.sort(rng.choice(dims, 5, replace=False)).astype(np.int32), rng.random(5), rng.random(classifier.N_STATS)) for _ in range(40)]
    labels = (rng.random(40) < 0.4).astype(float)
    fitted = classifier.fit(rows, labels, dims, rank, epochs=1, rate=0.01)
    size = dims + classifier.N_STATS
    stats = np.array([r[2] for r in rows])
    mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    share = (labels.sum() + 1) / (len(labels) + 2)
    # The same draws as the fit's.
    factor = np.random.default_rng(10).normal(0, 0.02, (size, rank))
    starts, index, value = np.cumsum([0] + [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])

    def loss(bias, weight, factor):
        z = classifier.Machine(dims, bias, weight, factor, mean, scale).logits(starts, index, value, stats)
        return np.mean(np.log1p(np.exp(z)) - labels * z) + 0.5e-4 * ((weight**2).sum() + (factor**2).sum())

    def slopes(of, start):
        out = np.zeros(start.size)
        for i in range(start.size):
            step = np.zeros(start.size)
            step[i] = 1e-5
            out[i] = (of(start + step.reshape(start.shape)) - of(start - step.reshape(start.shape))) / 2e-5
        return out.reshape(start.shape)

    bias, weight = float(np.log(share / (1 - share))), np.zeros(size)
    for got, start, slope in ((fitted.weight, weight, slopes(lambda w: loss(bias, w, factor), weight)), (fitted.factor, factor, slopes(lambda v: loss(bias, weight, v), factor))):
        clear = np.abs(slope) > 1e-7
        assert clear.mean() > 0.8 and (np.sign(got - start)[clear] == -np.sign(slope)[clear]).all()
    assert abs(fitted.bias - (bias - 0.01 * slopes(lambda b: loss(float(b[0]), weight, factor), np.array([bias]))[0])) < 1e-8
