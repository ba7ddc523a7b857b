"""Gates stand apart, so that a step's array operations run over whole arrays."""

import numpy as np


def test_steps_by_whole_gates():
    from briefmill.llm import language_model as lm

    rng = np.random.default_rng(3)
    voc = lm.Vocabulary(np.arange(12, dtype=np.uint64), np.arange(12, 0, -1), 90, 15, most=12, classes=3)
    net = {k: (w + 0.3 * rng.standard_normal(w.shape)).astype(np.float32) for k, w in lm.start(voc).items()}
    h, x, k = rng.standard_normal((5, lm.HIDDEN)).astype(np.float32), np.array([0, 3, 3, 12, 7]), lm.HIDDEN
    a, g = net["inputs"][x], h @ net["state"]
    z, r = (1 / (1 + np.exp(-(a + g)[:, part])) for part in (slice(k), slice(k, 2 * k)))
    n = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
    new, kept = lm.step(net, h, x)
    assert np.allclose(new, (1 - z) * n + z * h, atol=1e-6)
    assert np.array_equal(new, lm.step(lm.gates(net), h, x)[0])
    gates, last = kept
    assert gates.shape == (3, 5, k) and all(one.flags.c_contiguous for one in (*gates, last))  # before, gates were columns of one array
    for got, want in zip((*gates, last), (z, r, g[:, 2 * k :], n), strict=True):
        assert np.allclose(got, want, atol=1e-5)
