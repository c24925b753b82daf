"""A character tagger in numpy: bidirectional LSTM emissions with CRF transitions.

Small dense arrays, so a batch of windows is a few matrix products a step. Used inside
tasks for decoding and on the driver for training on a bounded set of windows.
"""

from __future__ import annotations

import numpy as np

from sensorlake.functions.shipping import by_value

by_value(__name__)

EMBED, HIDDEN = 8, 16
_FORBIDDEN = -1e4


def start_weights(classes: int, tags: int, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"embed": normal(classes, EMBED) * 3, "out": normal(2 * HIDDEN, tags), "out_b": np.zeros(tags, np.float32),
         "moves": np.zeros((tags, tags), np.float32)}
    for side in "lr":
        w |= {f"x_{side}": normal(EMBED, 4 * HIDDEN), f"h_{side}": normal(HIDDEN, 4 * HIDDEN),
              f"b_{side}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool):
    """x (time, batch, embed) -> hidden states (time, batch, hidden), and what training needs."""
    steps, n = x.shape[:2]
    z_x = x @ wx + b
    h = c = np.zeros((n, HIDDEN), np.float32)
    out, saved = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = z_x[t] + h @ wh
        ifo = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN:2 * HIDDEN], ifo[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        before, h_before = c, h
        c = f * c + i * g
        th = np.tanh(c)
        h = o * th
        out[t] = h
        if keep:
            saved.append((i, f, o, g, before, th, h_before))
    return out, saved


def _lstm_back(x, wx, wh, saved, d_out):
    d_wx, d_wh, d_b = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN, np.float32)
    d_x = np.empty_like(x)
    d_h = d_c = np.zeros(d_out.shape[1:], np.float32)
    for t in range(len(saved) - 1, -1, -1):
        i, f, o, g, before, th, h_before = saved[t]
        d_h = d_h + d_out[t]
        d_c = d_c + d_h * o * (1 - th * th)
        d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * th * o * (1 - o),
                              d_c * i * (1 - g * g)], axis=1)
        d_wx += x[t].T @ d_z
        d_wh += h_before.T @ d_z
        d_b += d_z.sum(axis=0)
        d_x[t] = d_z @ wx.T
        d_h, d_c = d_z @ wh.T, d_c * f
    return d_wx, d_wh, d_b, d_x


def emissions(w: dict, classes: np.ndarray, keep: bool = False):
    """classes (batch, time) -> scores (time, batch, tags)."""
    x = w["embed"][classes.T]
    left, saved_l = _lstm(x, w["x_l"], w["h_l"], w["b_l"], keep)
    right, saved_r = _lstm(x[::-1], w["x_r"], w["h_r"], w["b_r"], keep)
    both = np.concatenate([left, right[::-1]], axis=2)
    return both @ w["out"] + w["out_b"], (x, both, saved_l, saved_r)


def _log_sum(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(z - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_slopes(w: dict, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Negative log-likelihood per window under the CRF, and its slopes."""
    scores, (x, both, saved_l, saved_r) = emissions(w, classes, keep=True)
    steps, n, k = scores.shape
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = scores[t] + _log_sum(ahead[t - 1][:, :, None] + w["moves"], 1)
    for t in range(steps - 2, -1, -1):
        behind[t] = _log_sum(w["moves"] + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    gold = tags.T
    at_t, at_n = np.arange(steps)[:, None], np.arange(n)
    found = scores[at_t, at_n, gold].sum(axis=0) + w["moves"][gold[:-1], gold[1:]].sum(axis=0)
    d_scores = np.exp(ahead + behind - total[None, :, None])
    d_scores[at_t, at_n, gold] -= 1
    d_scores /= n
    d_moves = np.zeros_like(w["moves"])
    for t in range(steps - 1):
        d_moves += np.exp(ahead[t][:, :, None] + w["moves"] + (scores[t + 1] + behind[t + 1])[:, None, :]
                          - total[:, None, None]).sum(axis=0)
    np.add.at(d_moves, (gold[:-1].ravel(), gold[1:].ravel()), -1)
    slopes = {"moves": d_moves / n, "out": both.reshape(-1, 2 * HIDDEN).T @ d_scores.reshape(-1, k),
              "out_b": d_scores.sum(axis=(0, 1))}
    d_both = d_scores @ w["out"].T
    slopes["x_l"], slopes["h_l"], slopes["b_l"], d_l = _lstm_back(x, w["x_l"], w["h_l"], saved_l, d_both[:, :, :HIDDEN])
    slopes["x_r"], slopes["h_r"], slopes["b_r"], d_r = _lstm_back(
        x[::-1], w["x_r"], w["h_r"], saved_r, d_both[::-1, :, HIDDEN:])
    slopes["embed"] = np.zeros_like(w["embed"])
    np.add.at(slopes["embed"], classes.T, d_l + d_r[::-1])
    return float((total - found).mean()), slopes


def fit(classes: np.ndarray, tags: np.ndarray, n_classes: int, n_tags: int, steps: int = 300, batch: int = 64,
        rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights by Adam over random batches of windows."""
    w = start_weights(n_classes, n_tags, seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(classes), min(batch, len(classes)))
        _, slopes = loss_and_slopes(w, classes[pick], tags[pick])
        size = np.sqrt(sum(float((d * d).sum()) for d in slopes.values()))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, d in slopes.items():
            d = d * min(1.0, 5.0 / max(size, 1e-9))
            m[k] += 0.1 * (d - m[k])
            s[k] += 0.01 * (d * d - s[k])
            w[k] = (w[k] - pace * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return w


def decode(w: dict, classes: np.ndarray, forbidden: np.ndarray) -> np.ndarray:
    """Best tags (batch, time); ``forbidden`` marks moves that never happen."""
    scores, _ = emissions(w, classes)
    moves = w["moves"] + np.where(forbidden, _FORBIDDEN, 0).astype(np.float32)
    steps, n, k = scores.shape
    best, back = scores[0], np.empty((steps, n, k), np.int8)
    for t in range(1, steps):
        reach = best[:, :, None] + moves
        back[t] = reach.argmax(axis=1)
        best = reach.max(axis=1) + scores[t]
    tags = np.empty((n, steps), np.int8)
    tags[:, -1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t, np.arange(n), tags[:, t]]
    return tags
