"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

# Characters with a class of their own; letters, digits and the rest share classes.
OWN = "@.-+_%()[]/:, \n#*|"
CLASSES = 1 + 26 + 1 + 1 + len(OWN) + 1  # padding, a-z, other letters, digits, own, rest


def _class_of(c: str) -> int:
    low = c.lower()
    if "a" <= low <= "z" and len(low) == 1:
        return ord(low) - 96
    if c.isdigit():
        return 28
    if c.isalpha():
        return 27
    k = OWN.find(c)
    return 29 + k if k >= 0 else CLASSES - 1


LOW = np.array([_class_of(chr(i)) for i in range(0x600)], np.int16)


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = LOW[np.minimum(codes, len(LOW) - 1)]
    for i in np.flatnonzero(codes >= len(LOW)).tolist():
        out[i] = _class_of(text[i])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    """Weights in `p`: embedding e, for each direction input, recurrent and bias weights, output, transitions."""

    def __init__(self, tags: int, hidden: int = 16, embed: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h, self.k = hidden, tags
        self.p = {"e": w(CLASSES, embed) * 2, "o": w(2 * hidden, tags), "c": np.zeros(tags, np.float32), "t": np.zeros((tags, tags), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p |= {f"x{d}": w(embed, 4 * hidden), f"h{d}": w(hidden, 4 * hidden), f"s{d}": bias}

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, h = x.shape[0], x.shape[1], self.h
        pre = x @ self.p[f"x{d}"] + self.p[f"s{d}"]
        hs, out = np.zeros((n, h), np.float32), np.empty((n, steps, h), np.float32)
        c, trail = np.zeros((n, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = pre[:, t] + hs @ self.p[f"h{d}"]
            s = _sigmoid(g[:, : 3 * h])
            a = np.tanh(g[:, 3 * h :])
            was, old = c, hs
            c = s[:, h : 2 * h] * c + s[:, :h] * a
            tc = np.tanh(c)
            hs = s[:, 2 * h :] * tc
            out[:, t] = hs
            if keep:
                trail.append((t, s, a, was, tc, old))
        return out, trail

    def _lstm_back(self, x: np.ndarray, d: str, trail: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        h = self.h
        dpre = np.empty((*x.shape[:2], 4 * h), np.float32)
        dh, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
        wh = np.zeros_like(self.p[f"h{d}"])
        for t, s, a, was, tc, old in reversed(trail):
            dh = dh + dout[:, t]
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            dc = dc + dh * o * (1 - tc * tc)
            g = np.concatenate([dc * a * i * (1 - i), dc * was * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
            dpre[:, t] = g
            wh += old.T @ g
            dh, dc = g @ self.p[f"h{d}"].T, dc * f
        flat = dpre.reshape(-1, 4 * h)
        grad[f"h{d}"], grad[f"s{d}"], grad[f"x{d}"] = wh, flat.sum(0), x.reshape(-1, x.shape[2]).T @ flat
        return dpre @ self.p[f"x{d}"].T

    def emissions(self, idx: np.ndarray) -> np.ndarray:
        x = self.p["e"][idx]
        return np.concatenate([self._lstm(x, "f", False)[0], self._lstm(x, "b", False)[0]], axis=2) @ self.p["o"] + self.p["c"]

    def gradients(self, idx: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        p, n, steps = self.p, len(idx), idx.shape[1]
        x = p["e"][idx]
        hf, tf = self._lstm(x, "f", True)
        hb, tb = self._lstm(x, "b", True)
        hid = np.concatenate([hf, hb], axis=2)
        em = (hid @ p["o"] + p["c"]).astype(np.float64)
        tr = p["t"].astype(np.float64)
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        for t in range(1, steps):
            alpha[:, t] = em[:, t] + _lse(alpha[:, t - 1, :, None] + tr, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _lse(tr + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        rows = np.arange(n)[:, None]
        gold = em[rows, np.arange(steps), tags].sum() + tr[tags[:, :-1], tags[:, 1:]].sum()
        pair = np.exp(alpha[:, :-1, :, None] + tr + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        np.add.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        de[rows, np.arange(steps), tags] -= 1
        de = (de / n).astype(np.float32)
        grad = {"t": (pair / n).astype(np.float32), "c": de.sum((0, 1)), "o": hid.reshape(-1, 2 * self.h).T @ de.reshape(-1, self.k)}
        dh = de @ p["o"].T
        dx = self._lstm_back(x, "f", tf, dh[:, :, : self.h], grad) + self._lstm_back(x, "b", tb, dh[:, :, self.h :], grad)
        grad["e"] = np.zeros_like(p["e"])
        np.add.at(grad["e"], idx.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((z.sum() - gold) / n), grad

    def fit(self, idx: np.ndarray, tags: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.012, seed: int = 3) -> float:
        r, m, v, step, loss = np.random.default_rng(seed), {}, {}, 0, 0.0
        total = max(1, epochs * -(-len(idx) // batch))
        for _ in range(epochs):
            order, loss = r.permutation(len(idx)), 0.0
            for s in range(0, len(idx), batch):
                pick = order[s : s + batch]
                part, grad = self.gradients(idx[pick], tags[pick])
                loss += part * len(pick) / len(idx)
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, g in grad.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return loss

    def decode(self, idx: np.ndarray) -> np.ndarray:
        """Viterbi tags of each window."""
        em, tr = self.emissions(idx), self.p["t"]
        n, steps, _ = em.shape
        back = np.empty((n, steps, self.k), np.int8)
        best = em[:, 0]
        for t in range(1, steps):
            s = best[:, :, None] + tr
            back[:, t] = s.argmax(1)
            best = s.max(1) + em[:, t]
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags
