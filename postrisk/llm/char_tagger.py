"""Character-level bidirectional LSTM with CRF transitions, in numpy: training, scoring, decoding.

Tags: 0 outside; 1 + 2k begins and 2 + 2k continues a span of kind k. Transitions
that no sequence of spans can have are ruled out, in training and in decoding."""

from __future__ import annotations

import numpy as np

OTHER_LETTER, OTHER, PAD = 128, 129, 130
ALPHABET = 131
_NEVER = np.float32(-1e4)


def encode(text: str, length: int | None = None) -> np.ndarray:
    """Character classes: ASCII by itself, other letters, anything else, padding."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    far = c >= 128
    if far.any():
        c[far] = [OTHER_LETTER if chr(x).isalpha() else OTHER for x in c[far]]
    if length is not None and len(c) < length:
        c = np.concatenate([c, np.full(length - len(c), PAD)])
    return c


def allowed(n_kinds: int) -> np.ndarray:
    """Additive mask over (from, to); row n_tags is the start."""
    k = 1 + 2 * n_kinds
    m = np.zeros((k + 1, k), np.float32)
    for kind in range(n_kinds):
        inside = 2 + 2 * kind
        m[:, inside] = _NEVER
        m[inside - 1, inside] = m[inside, inside] = 0
    return m


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    def __init__(self, n_kinds: int, hidden: int = 20, embed: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        k = 1 + 2 * n_kinds
        self.hidden, self.k, self.mask = hidden, k, allowed(n_kinds)

        def init(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"E": init(ALPHABET, embed, scale=0.5), "V": init(2 * hidden, k, scale=(2 * hidden) ** -0.5), "v": np.zeros(k, np.float32),
                  "T": np.zeros((k, k), np.float32)}
        # the two reading directions are the first axis
        self.p |= {"W": init(2, embed, 4 * hidden, scale=embed ** -0.5), "U": init(2, hidden, 4 * hidden, scale=hidden ** -0.5),
                   "b": np.zeros((2, 1, 4 * hidden), np.float32)}
        self.p["b"][:, :, hidden:2 * hidden] = 1  # remember at first

    def _lstm(self, c: np.ndarray, keep: bool):
        """Hidden states (n, t, 2 * hidden) of both directions over classes c (n, t)."""
        h_n, (n, t_n) = self.hidden, c.shape
        table, u = self.p["E"] @ self.p["W"] + self.p["b"], self.p["U"]
        h = np.zeros((2, n, h_n), table.dtype)
        s = np.zeros_like(h)
        out, memo = np.empty((n, t_n, 2, h_n), table.dtype), []
        for t in range(t_n):
            back = t_n - 1 - t
            g = h @ u
            g[0] += table[0][c[:, t]]
            g[1] += table[1][c[:, back]]
            gates = _sigmoid(g[:, :, :3 * h_n])
            i, f, o = gates[:, :, :h_n], gates[:, :, h_n:2 * h_n], gates[:, :, 2 * h_n:]
            z = np.tanh(g[:, :, 3 * h_n:])
            s2 = f * s + i * z
            y = np.tanh(s2)
            if keep:
                memo.append((h, s, i, f, o, z, y))
            h, s = o * y, s2
            out[:, t, 0], out[:, back, 1] = h
        return out.reshape(n, t_n, 2 * h_n), memo

    def emissions(self, c: np.ndarray) -> np.ndarray:
        """(n, t, tags) scores of windows c (n, t)."""
        return self._lstm(c, False)[0] @ self.p["V"] + self.p["v"]

    def _lstm_back(self, c: np.ndarray, memo: list, dout: np.ndarray, grad: dict) -> None:
        h_n, u, (n, t_n) = self.hidden, self.p["U"], c.shape
        dout = dout.reshape(n, t_n, 2, h_n)
        dh = np.zeros((2, n, h_n), u.dtype)
        ds = np.zeros_like(dh)
        du, dg_all = np.zeros_like(u), np.empty((2, n, t_n, 4 * h_n), u.dtype)
        for t in range(t_n - 1, -1, -1):
            h, s, i, f, o, z, y = memo[t]
            dh[0] += dout[:, t, 0]
            dh[1] += dout[:, t_n - 1 - t, 1]
            ds = ds + dh * o * (1 - y * y)
            dg = np.concatenate([ds * z * i * (1 - i), ds * s * f * (1 - f), dh * y * o * (1 - o), ds * i * (1 - z * z)], axis=2)
            dg_all[0, :, t], dg_all[1, :, t_n - 1 - t] = dg
            du += h.transpose(0, 2, 1) @ dg
            dh, ds = dg @ u.transpose(0, 2, 1), ds * f
        hot = np.zeros((ALPHABET, c.size), u.dtype)
        hot[c.ravel(), np.arange(c.size)] = 1
        dtable = hot @ dg_all.reshape(2, -1, 4 * h_n)
        grad["U"], grad["b"] = du, dtable.sum(1, keepdims=True)
        grad["W"] = self.p["E"].T @ dtable
        grad["E"] = (dtable @ self.p["W"].transpose(0, 2, 1)).sum(0)

    def loss(self, c: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tag sequences and its gradients."""
        n, t_n = c.shape
        both, memo = self._lstm(c, True)
        e = both @ self.p["V"] + self.p["v"]
        trans, start = self.p["T"] + self.mask[:-1], self.mask[-1]
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + start
        for t in range(1, t_n):
            fwd[:, t] = _lse(fwd[:, t - 1][:, :, None] + trans, 1) + e[:, t]
        for t in range(t_n - 2, -1, -1):
            bwd[:, t] = _lse(trans + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        z = _lse(fwd[:, -1], 1)
        rows = np.arange(n)
        gold = e[rows[:, None], np.arange(t_n), tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1) + start[tags[:, 0]]
        de = np.exp(fwd + bwd - z[:, None, None])
        de[rows[:, None], np.arange(t_n), tags] -= 1
        de /= n
        dtrans = np.zeros_like(trans)
        for t in range(1, t_n):
            dtrans += np.exp(fwd[:, t - 1][:, :, None] + trans + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dtrans, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        grad = {"V": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, self.k), "v": de.sum((0, 1)), "T": dtrans / n}
        self._lstm_back(c, memo, de @ self.p["V"].T, grad)
        return float((z - gold).mean()), grad

    def fit(self, c: np.ndarray, tags: np.ndarray, steps: int = 240, batch: int = 64, rate: float = 0.02, seed: int = 3) -> "Tagger":
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, r.permutation(len(c))])
            take, order = order[:batch], order[batch:]
            _, g = self.loss(c[take], tags[take])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            clip = min(1.0, 5.0 / (norm + 1e-9))
            eta = rate * (1 - 0.9 * step / steps)
            for k in self.p:
                x = g[k] * clip
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.p[k] -= (eta * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, e: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Best tag sequence of every region; e is (regions, longest, tags), n their lengths."""
        trans = self.p["T"] + self.mask[:-1]
        score = e[:, 0] + self.mask[-1]
        back = np.zeros(e.shape, np.int8)
        end = score.copy()
        for t in range(1, e.shape[1]):
            x = score[:, :, None] + trans
            back[:, t] = x.argmax(1)
            score = x.max(1) + e[:, t]
            end[n == t + 1] = score[n == t + 1]
        out = []
        for r, size in enumerate(n):
            tags = np.empty(size, np.int64)
            tags[-1] = end[r].argmax()
            for t in range(size - 1, 0, -1):
                tags[t - 1] = back[r, t, tags[t]]
            out.append(tags)
        return out
