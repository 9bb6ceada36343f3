"""Kernels against values that are known in closed form."""

import itertools
import math

import numpy as np
import pytest

from wavelode.functions import kernels


def test_vmd_parts_two_tones():
    t = np.arange(400)
    x = np.sin(2 * np.pi * 0.02 * t) + 0.5 * np.sin(2 * np.pi * 0.1 * t)
    modes, omega = kernels.vmd(x, 2000.0, 3)
    assert modes.shape == (3, 400)
    assert any(abs(omega - 0.02) < 0.01) and any(abs(omega - 0.1) < 0.01)
    assert np.sqrt(((modes.sum(0) - x)[20:-20] ** 2).mean()) < 0.1


def test_spectrum_of_a_tone():
    x = np.sin(2 * np.pi * 8 * np.arange(64) / 64)
    assert kernels.dominant_frequency(x, 0.5) == pytest.approx(8 / 32)
    assert kernels.spectral_entropy(x) < 0.01
    assert kernels.spectral_entropy(np.zeros(64)) == 0.0
    assert kernels.spectral_entropy(np.zeros(3)) is None


def test_probabilities():
    assert kernels.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert kernels.t_two_sided(2.0, 1.0) == pytest.approx(1 - 2 * math.atan(2.0) / math.pi, abs=1e-12)
    assert kernels.exact_rank_sum(56, 7, 8) == pytest.approx(2 / math.comb(15, 7))


def test_exact_rank_sum_counts_all_orders():
    for n1, n2 in ((2, 3), (3, 3)):
        all_u = [sum(r) - n1 * (n1 + 1) / 2 for r in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(n1 * n2 + 1):
            top = max(u, n1 * n2 - u)
            expected = min(1.0, 2 * sum(v >= top for v in all_u) / len(all_u))
            assert kernels.exact_rank_sum(u, n1, n2) == pytest.approx(expected)


def test_series_decomposed_side_by_side_are_as_alone():
    rng = np.random.default_rng(3)
    x, alpha = rng.normal(size=(5, 41)), np.array([1500.0, 2000.0, 2500.0, 3000.0, 3500.0])
    modes, omega = kernels.vmd_many(x, alpha, 4)
    for i in range(5):
        alone, centre = kernels.vmd(x[i], alpha[i], 4)
        assert np.allclose(modes[i], alone, atol=1e-9) and np.allclose(omega[i], centre, atol=1e-9)


def test_recurrent_pairs_of_one_pass_are_those_of_two():
    from wavelode.functions import window_kernel

    rng = np.random.default_rng(5)
    for n, rate, theiler in ((700, 0.05, 1), (700, 0.0, 3), (600, 1.0, 2), (9, 0.3, 2), (3, 0.5, 1)):
        v = np.round(rng.exponential(size=(n, 3)), 2)
        epsilon, i, j = window_kernel.recurrence(v, rate, theiler)
        assert epsilon == window_kernel.distance_quantile(v, rate, theiler)
        assert np.array_equal((i, j), window_kernel.recurrent_pairs(v, epsilon, theiler))


def test_most_distances_of_a_long_window_are_not_computed(monkeypatch):
    from wavelode.functions import window_kernel

    computed, block = [], window_kernel._block
    monkeypatch.setattr(window_kernel, "_block", lambda rows, v: computed.append(len(rows) * len(v)) or block(rows, v))
    rng = np.random.default_rng(6)
    for digits, m, theiler, cap in ((6, 3, 1, 30), (1, 3, 1, 30), (0, 2, 3, 4)):
        v = window_kernel.embed(np.round(np.repeat(rng.exponential(size=500), 3), digits), m, 1)
        want, whole = window_kernel.nearest(v, theiler, cap, [(0, block(v, v))]), len(v) ** 2
        computed.clear()
        assert all(map(np.array_equal, window_kernel.nearest(v, theiler, cap), want)) and sum(computed) < whole / 2
        computed.clear()
        epsilon, i, j = window_kernel.recurrence(v, 0.02, theiler)
        assert sum(computed) < whole / 2
        assert epsilon == window_kernel.distance_quantile(v, 0.02, theiler) and np.array_equal((i, j), window_kernel.recurrent_pairs(v, epsilon, theiler))
