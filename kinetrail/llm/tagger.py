"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and emissions for windows."""

from __future__ import annotations

import numpy as np

#: Characters with a code of their own; others share one for letters, one for digits and one for the rest.
_ASCII = {chr(c): c - 29 for c in range(32, 127)}
SYMBOLS = 127 - 29 + 1


def encode(text: str) -> np.ndarray:
    get = _ASCII.get
    return np.array([get(ch) or (0 if ch.isalpha() else 1 if ch.isdigit() else 2) for ch in text], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _outer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The outer products of the last axes, summed over all others (in one thread: a matrix product of this shape would
    wake as many as there are cores, whoever uses them)."""
    return np.einsum("tbx,tby->xy", x, y)


class Tagger:
    """labels: names; label 0 is outside, then a begin and an inside label for each kind."""

    def __init__(self, kinds: int, hidden: int = 24, width: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, 1 + 2 * kinds
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"e": rng.normal(0, 0.5, (SYMBOLS, width)), "u": scale(2 * hidden, self.labels), "c": np.zeros(self.labels), "t": np.zeros((self.labels, self.labels))}
        for d in ("f", "b"):
            self.p |= {f"w{d}": scale(width, 4 * hidden), f"r{d}": scale(hidden, 4 * hidden), f"o{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}
        # An inside label follows only its own begin or inside label.
        self.bar = np.zeros((self.labels, self.labels))
        for k in range(kinds):
            self.bar[:, 2 + 2 * k] = -1e4
            self.bar[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.start = np.where([i and i % 2 == 0 for i in range(self.labels)], -1e4, 0.0)

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction over x (time, rows, width)."""
        w, r, o, h = self.p[f"w{d}"], self.p[f"r{d}"], self.p[f"o{d}"], self.hidden
        steps, rows = x.shape[:2]
        drive = x @ w + o
        out = np.zeros((steps, rows, h))
        s, c, kept = np.zeros((rows, h)), np.zeros((rows, h)), []
        for t in range(steps):
            a = drive[t] + s @ r
            i, f, g = _sigmoid(a[:, :h]), _sigmoid(a[:, h : 2 * h]), _sigmoid(a[:, 2 * h : 3 * h])
            z = np.tanh(a[:, 3 * h :])
            before, last = s, c
            c = f * c + i * z
            q = np.tanh(c)
            s = g * q
            out[t] = s
            kept.append((i, f, g, z, q, last, before))
        return out, kept

    def _back(self, x: np.ndarray, grad: np.ndarray, kept: list, d: str, into: dict) -> np.ndarray:
        w, r = self.p[f"w{d}"], self.p[f"r{d}"]
        ds, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        da = np.zeros((*grad.shape[:2], 4 * self.hidden))
        for t in range(len(grad) - 1, -1, -1):
            i, f, g, z, q, last, before = kept[t]
            ds = ds + grad[t]
            dc = dc + ds * g * (1 - q * q)
            da[t] = np.concatenate([dc * z * i * (1 - i), dc * last * f * (1 - f), ds * q * g * (1 - g), dc * i * (1 - z * z)], axis=1)
            into[f"r{d}"] += before.T @ da[t]
            ds, dc = da[t] @ r.T, dc * f
        into[f"w{d}"] += _outer(x, da)
        into[f"o{d}"] += da.sum(axis=(0, 1))
        return da @ w.T

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Label scores (rows, time, labels) of windows of symbol codes (rows, time)."""
        x = self.p["e"][ids.T]
        both = np.concatenate([self._run(x, "f")[0], self._run(x[::-1], "b")[0][::-1]], axis=2)
        return (both @ self.p["u"] + self.p["c"]).transpose(1, 0, 2)

    def step(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the gold label paths, and its gradients."""
        rows, steps = ids.shape
        x = self.p["e"][ids.T]
        hf, kf = self._run(x, "f")
        hb, kb = self._run(x[::-1], "b")
        both = np.concatenate([hf, hb[::-1]], axis=2)
        em = both @ self.p["u"] + self.p["c"]
        trans = self.p["t"] + self.bar
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0] + self.start
        for t in range(1, steps):
            alpha[t] = em[t] + _logsumexp(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        g = gold.T
        at = np.arange(rows)
        score = sum(em[t, at, g[t]] for t in range(steps)) + sum(trans[g[t - 1], g[t]] for t in range(1, steps))
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        dem = np.exp(alpha + beta - z[:, None])
        for t in range(steps):
            dem[t, at, g[t]] -= 1
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + trans + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
                np.add.at(pair, (g[t - 1], g[t]), -1)
                grads["t"] += pair
        dem /= rows
        grads["t"] /= rows
        grads["u"] += _outer(both, dem)
        grads["c"] += dem.sum(axis=(0, 1))
        dh = dem @ self.p["u"].T
        h = self.hidden
        dx = self._back(x, dh[:, :, :h], kf, "f", grads) + self._back(x[::-1], dh[::-1, :, h:], kb, "b", grads)[::-1]
        np.add.at(grads["e"], ids.T, dx)
        return float((z - score).mean()), grads

    def fit(self, ids: np.ndarray, gold: np.ndarray, epochs: int, rows: int = 64, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m, v, n, loss = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0, 0.0
        m, v = m
        for epoch in range(epochs):
            order, losses = rng.permutation(len(ids)), []
            pace = rate * (1 - epoch / epochs) + 0.002
            for a in range(0, len(order), rows):
                part = order[a : a + rows]
                loss, grads = self.step(ids[part], gold[part])
                losses.append(loss)
                n += 1
                size = np.sqrt(sum((g * g).sum() for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= pace * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
            loss = float(np.mean(losses))
        return loss

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """The best label path of one sequence of emissions (time, labels)."""
        trans = self.p["t"] + self.bar
        score, back = em[0] + self.start, np.zeros(em.shape, np.int64)
        for t in range(1, len(em)):
            options = score[:, None] + trans
            back[t] = options.argmax(axis=0)
            score = em[t] + options[back[t], np.arange(len(score))]
        path = [int(score.argmax())]
        for t in range(len(em) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return np.array(path[::-1])
