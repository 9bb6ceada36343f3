"""Small numpy functions that run inside tasks, one window or one row at a time."""

from __future__ import annotations

import math

import numpy as np


def spectral_entropy(x: np.ndarray) -> float | None:
    """Entropy of the one-sided power spectrum over the logarithm of its size, from 0 to 1."""
    if len(x) < 4:
        return None
    power = np.abs(np.fft.fft(x))[: len(x) // 2] ** 2
    if power.sum() <= 1e-12:
        return 0.0
    p = power / (power.sum() + 1e-12)
    return float(np.clip(-(p * np.log(p + 1e-12)).sum() / (math.log(len(p)) + 1e-12), 0, 1))


def dominant_frequency(x: np.ndarray, dt: float) -> float | None:
    """Frequency of the largest one-sided amplitude."""
    if len(x) < 4:
        return None
    amp = np.abs(np.fft.fft(x))[: len(x) // 2]
    return float(amp.argmax() / (len(x) * dt)) if amp.max() > 0 else None


def vmd(x: np.ndarray, alpha: float = 2000.0, k: int = 5, tau: float = 0.0, dc: bool = True, tol: float = 1e-7, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Variational mode decomposition of one series: modes of shape (k, n) and their centre frequencies."""
    modes, omega = vmd_many(np.asarray(x, float)[None], np.array([alpha], float), k, tau, dc, tol, most)
    return modes[0], omega[0]


def vmd_many(x: np.ndarray, alpha: np.ndarray, k: int, tau: float = 0.0, dc: bool = True, tol: float = 1e-7, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Variational mode decomposition of series of one length, as rows of ``x``, each with its own ``alpha``: modes of shape (rows, k, n) and their centre frequencies.

    A signal is mirrored at both ends; modes are Wiener-filtered one after another on the
    positive half of the spectrum until they settle, and a row that has settled is not
    touched again. Frequencies start evenly spaced and the first stays at 0 with ``dc``.
    """
    rows, n = x.shape
    h = n // 2
    wide = np.concatenate([x[:, :h][:, ::-1], x, x[:, n - h :][:, ::-1]], 1)
    size = wide.shape[1]
    freq = np.fft.fftshift(np.fft.fftfreq(size))
    full = np.fft.fftshift(np.fft.fft(wide, axis=1), axes=1)
    upper = freq >= 0
    f, w, a = full[:, upper], freq[upper], alpha[:, None]
    omega = np.tile(np.arange(k) * 0.5 / k, (rows, 1))
    if dc:
        omega[:, 0] = 0.0
    # By mode first, so that a mode of all rows lies together.
    modes, dual = np.zeros((k, rows, f.shape[1]), complex), np.zeros(f.shape, complex)
    total = np.zeros(f.shape, complex)
    settled_modes, settled_omega, left = np.zeros_like(modes), np.zeros_like(omega), np.arange(rows)
    for _ in range(most):
        change = np.zeros(len(left))
        for i in range(k):
            rest = total - modes[i]
            new = (f - rest + dual / 2) / (1 + a * (w - omega[:, i, None]) ** 2)
            away = new - modes[i]
            change += (away.real**2 + away.imag**2).sum(1) / size
            total = rest + new
            modes[i] = new
            if i or not dc:
                power = np.abs(new) ** 2
                omega[:, i] = (w * power).sum(1) / np.maximum(power.sum(1), 1e-300)
        dual = dual + tau * (f - total)
        done = change <= tol
        if done.any():
            settled_modes[:, left[done]], settled_omega[left[done]] = modes[:, done], omega[done]
            go = ~done
            left, f, a, omega, modes, dual, total = left[go], f[go], a[go], omega[go], modes[:, go], dual[go], total[go]
            if not len(left):
                break
    settled_modes[:, left], settled_omega[left] = modes, omega
    spectrum = np.zeros((rows, k, size), complex)
    spectrum[:, :, upper] = settled_modes.transpose(1, 0, 2)
    real = np.fft.ifft(np.fft.ifftshift(spectrum, axes=2), axis=2).real * 2
    middle = np.fft.fftshift(np.fft.fftfreq(size)) == 0
    real -= np.real(spectrum[:, :, middle]) / size
    return real[:, :, h : h + n], settled_omega


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, d = 1e-300, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    c, out = 1.0, d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def exact_rank_sum(u: float, n1: int, n2: int) -> float:
    """Two-sided exact Mann-Whitney probability without ties."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1
    # Generating function of U: product of (1 - q^(n2 + i)) / (1 - q^i).
    for i in range(1, n1 + 1):
        for j in range(len(counts) - 1, n2 + i - 1, -1):
            counts[j] -= counts[j - n2 - i]
        for j in range(i, len(counts)):
            counts[j] += counts[j - i]
    top = max(u, n1 * n2 - u)
    return float(min(1.0, 2 * counts[math.ceil(top) :].sum() / counts.sum()))


def rolling_medians(x: np.ndarray, held: np.ndarray, half: int, at: np.ndarray, deviations: bool, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the values ``held`` within ``half`` samples of places ``at``, or of their distances from the median; and how many are there.

    At most ``cells`` values are sorted at a time, or one window's.
    """
    wide = 2 * half + 1
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(np.where(held, x, np.nan), half, constant_values=np.nan), wide)
    counts = np.cumsum(np.r_[0, np.pad(held, half).astype(np.int64)])
    n = (counts[wide:] - counts[:-wide])[at]
    out, step = np.full(len(at), np.nan), max(1, cells // wide)
    with np.errstate(invalid="ignore", over="ignore"):
        for lo in range(0, len(at), step):
            near, m = windows[at[lo : lo + step]], n[lo : lo + step]
            rows, low, high = np.arange(len(m)), np.maximum((m + 1) // 2 - 1, 0), np.minimum(m // 2, wide - 1)
            # What is not held sorts last.
            ordered = np.sort(near, axis=1)
            middle = (ordered[rows, low] + ordered[rows, high]) / 2
            if deviations:
                ordered = np.sort(np.abs(near - middle[:, None]), axis=1)
                middle = (ordered[rows, low] + ordered[rows, high]) / 2
            out[lo : lo + step] = middle
    return out, n
