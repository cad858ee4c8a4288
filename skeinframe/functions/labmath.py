"""Lab arithmetic in numpy for the per-image helpers, on arrays of colours (n, 3)."""

from __future__ import annotations

import numpy as np

from skeinframe.functions.color import TO_XYZ, WHITE


def rgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    c = np.asarray(rgb, float) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ np.array(TO_XYZ).T / np.array(WHITE)
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def ciede2000(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Differences of colours that broadcast against each other."""
    seventh = lambda c: np.sqrt(c**7 / (c**7 + 25.0**7))
    stretch = 1 + 0.5 * (1 - seventh((np.hypot(p[..., 1], p[..., 2]) + np.hypot(q[..., 1], q[..., 2])) / 2))
    a1, a2 = p[..., 1] * stretch, q[..., 1] * stretch
    c1, c2 = np.hypot(a1, p[..., 2]), np.hypot(a2, q[..., 2])
    h1, h2 = np.degrees(np.arctan2(p[..., 2], a1)) % 360, np.degrees(np.arctan2(q[..., 2], a2)) % 360
    grey = c1 * c2 == 0
    turn = np.where(grey, 0, (h2 - h1 + 180) % 360 - 180)
    turn = np.where((turn == -180) & (h2 > h1), 180, turn)
    both = h1 + h2
    mean_h = np.where(grey, both, np.where(np.abs(h1 - h2) <= 180, both / 2, np.where(both < 360, both / 2 + 180, both / 2 - 180)))
    mean_l, mean_c = (p[..., 0] + q[..., 0]) / 2, (c1 + c2) / 2
    cos = lambda d: np.cos(np.radians(d))
    weight = 1 - 0.17 * cos(mean_h - 30) + 0.24 * cos(2 * mean_h) + 0.32 * cos(3 * mean_h + 6) - 0.2 * cos(4 * mean_h - 63)
    off = (mean_l - 50) ** 2
    dl = (q[..., 0] - p[..., 0]) / (1 + 0.015 * off / np.sqrt(20 + off))
    dc = (c2 - c1) / (1 + 0.045 * mean_c)
    dh = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * mean_c * weight)
    rotation = -np.sin(np.radians(60 * np.exp(-(((mean_h - 275) / 25) ** 2)))) * 2 * seventh(mean_c)
    return np.sqrt(np.maximum(dl**2 + dc**2 + dh**2 + rotation * dc * dh, 0))
