"""A causal self-attention model over subword classes, in numpy.

A subword id is predicted in two steps: its class from the context by attention, then the id
within its class by the corpus counts. The most frequent ids are classes of their own; the
others share ``TAIL`` classes of about equal mass, in the order of the first axis along which
their neighbours differ.

One layer of masked multi-head attention with learned biases by distance, a residual and one
hidden layer. A text is scored in blocks of ``STRIDE`` predictions; every block sees a window of
``WINDOW`` inputs that ends with it, so each token is scored once and has between
``WINDOW - STRIDE`` and ``WINDOW`` inputs before it (fewer only at the start of the text)."""

from __future__ import annotations

import numpy as np

WINDOW, STRIDE = 40, 32
HEADS, DIM = 1, 16
CLASSES, TAIL = 160, 24
GROUP = 64  # windows in one batch of scoring
BATCH = 96  # windows in one step of fitting


def frequent(counts: np.ndarray, end: int, n: int) -> np.ndarray:
    """The ``n`` ids that are classes of their own: the end mark and the most frequent ones, ties by id."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    return np.concatenate([[end], order[order != end]])[:min(n, len(counts))]


def class_table(counts: np.ndarray, end: int, keys: np.ndarray, times: np.ndarray, classes: int = CLASSES,
                tail: int = TAIL) -> np.ndarray:
    """Class of every id. ``counts``: of the whole corpus; ``times``: how often each other id stands beside a frequent one.

    A key is ``id * 2 * own + place of the frequent one``, plus ``own`` if that one comes first."""
    n = len(counts)
    order = frequent(counts, end, n)
    own = order[:min(n, classes - tail)]
    out = np.full(n, -1, np.int64)
    out[own] = np.arange(len(own))
    rest = order[len(own):]
    if len(rest):
        place = np.full(n, -1)
        place[rest] = np.arange(len(rest))
        seen = np.zeros((len(rest), 2 * len(own)), np.float32)
        seen[place[keys // (2 * len(own))], keys % (2 * len(own))] = times  # neighbours on both sides
        known = seen.sum(1) > 0
        axis = np.zeros(len(rest), np.float32)
        if known.sum() > 1:
            x = np.sqrt(seen[known] / seen[known].sum(1, keepdims=True))
            x -= x.mean(0)
            first = np.linalg.eigh(x.T @ x)[1][:, -1]
            axis[known] = x @ (first * np.sign(first[np.abs(first).argmax()]))
        by = np.lexsort((rest, axis))
        mass = np.cumsum(counts[rest][by] + 1e-3)
        out[rest[by]] = len(own) + np.minimum((mass / mass[-1] * tail * (1 - 1e-9)).astype(np.int64), tail - 1)
    return out


class AttentionLM:
    """Input class ``classes`` stands for the start of a text.

    ``prior``: log probabilities of a class after each input class, counted over a whole corpus; the
    network adds to them what its context tells beyond the last input."""

    def __init__(self, classes: int = CLASSES, seed: int = 5, prior: np.ndarray | None = None):
        r = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)
        c, d = classes + 1, DIM
        self.classes, self._kept = classes, None
        self.prior = np.zeros((c, classes), np.float32) if prior is None else prior.astype(np.float32)
        self.p = {"q": normal(c, d, scale=0.3), "k": normal(c, d, scale=0.3), "v": normal(c, d, scale=0.3),
                  "u": normal(c, d, scale=0.3), "near": np.zeros((HEADS, WINDOW), np.float32),
                  "w1": normal(d, d, scale=d ** -0.5), "b1": np.zeros(d, np.float32),
                  "w2": normal(d, classes, scale=0.01), "b2": np.zeros(classes, np.float32)}

    @classmethod
    def of(cls, classes: int, prior: np.ndarray, weights: dict) -> "AttentionLM":
        out = cls(classes, prior=prior)
        out.p = weights
        return out

    def vector(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def with_vector(self, v: np.ndarray) -> "AttentionLM":
        """The model with the weights of a row that ``vector`` gave."""
        names = sorted(self.p)
        cut = np.split(v, np.cumsum([self.p[k].size for k in names])[:-1])
        return self.of(self.classes, self.prior, {k: x.reshape(self.p[k].shape).copy() for k, x in zip(names, cut)})

    # x: classes of the windows (batch, WINDOW), -1 before the text. The last STRIDE inputs predict.

    def hidden(self, x: np.ndarray):
        p, b, dh = self.p, len(x), DIM // HEADS
        inside = x >= 0
        at = np.where(inside, x, self.classes)
        cur = at[:, -STRIDE:]
        q = p["q"][cur].reshape(b, STRIDE, HEADS, dh).transpose(0, 2, 1, 3)
        k = p["k"][at].reshape(b, WINDOW, HEADS, dh).transpose(0, 2, 3, 1)
        v = p["v"][at].reshape(b, WINDOW, HEADS, dh).transpose(0, 2, 1, 3)
        gap = np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW)[None]
        bias = np.where(gap >= 0, p["near"][:, np.maximum(gap, 0)], np.float32(-1e9))
        s = np.matmul(q, k)
        s += bias[None]
        np.minimum(s, np.float32(60), out=s)
        if not inside.all():
            s += np.where(inside, np.float32(0), np.float32(-1e9))[:, None, None, :]
        np.exp(s, out=s)
        s /= s.sum(-1, keepdims=True) + np.float32(1e-30)
        o = np.matmul(s, v).transpose(0, 2, 1, 3).reshape(b, STRIDE, DIM)
        h = p["u"][cur] + o
        z = h.reshape(-1, DIM) @ p["w1"] + p["b1"]
        a = np.maximum(z, 0) + h.reshape(-1, DIM)
        return a, (at, cur, q, k, v, s, gap, h, z)

    def log_probs(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of the class that follows each of the last STRIDE inputs.

        The batches share one set of buffers, so scoring allocates next to nothing."""
        p, dh = self.p, DIM // HEADS
        out = np.empty(target.shape, np.float64)
        g = min(GROUP, max(1, len(x)))
        f = np.float32
        heads = [{k: np.ascontiguousarray(p[k][:, h * dh:(h + 1) * dh]) for k in "qkv"} for h in range(HEADS)]
        q, k, v = np.empty((g, STRIDE, dh), f), np.empty((g, WINDOW, dh), f), np.empty((g, WINDOW, dh), f)
        s, o = np.empty((g, STRIDE, WINDOW), f), np.empty((g, STRIDE, dh), f)
        h_, z = np.empty((g * STRIDE, DIM), f), np.empty((g * STRIDE, DIM), f)
        logits, extra = np.empty((g * STRIDE, self.classes), f), np.empty((g * STRIDE, self.classes), f)
        gap = np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW)[None]
        bias = np.where(gap >= 0, p["near"][:, np.maximum(gap, 0)], f(-1e9)).astype(f)
        ones, ones_w, prior = np.ones(self.classes, f), np.ones(WINDOW, f), (self.prior + p["b2"]).astype(f)
        rows = np.arange(g * STRIDE)
        longest, highest = float(np.sqrt((p["w2"] ** 2).sum(0).max())), float(prior.max())
        for i in range(0, len(x), g):
            part = x[i:i + g]
            n, m = len(part), len(part) * STRIDE
            outside = part < 0
            at = np.where(outside, self.classes, part)
            cur = at[:, -STRIDE:]
            hidden, flat = h_[:m], cur.ravel()
            np.take(p["u"], flat, axis=0, out=hidden, mode="clip")
            for j in range(HEADS):
                np.take(heads[j]["q"], cur, axis=0, out=q[:n], mode="clip")
                np.take(heads[j]["k"], at, axis=0, out=k[:n], mode="clip")
                np.take(heads[j]["v"], at, axis=0, out=v[:n], mode="clip")
                w = s[:n]
                np.matmul(q[:n], k[:n].transpose(0, 2, 1), out=w)
                w += bias[j]
                np.minimum(w, f(60), out=w)
                if outside.any():
                    w += np.where(outside, f(-1e9), f(0))[:, None, :]
                np.exp(w, out=w)
                np.matmul(w, v[:n], out=o[:n])
                o[:n] /= (w @ ones_w)[:, :, None] + f(1e-30)
                hidden[:, j * dh:(j + 1) * dh] += o[:n].reshape(m, dh)
            a = z[:m]
            np.matmul(hidden, p["w1"], out=a)
            a += p["b1"]
            np.maximum(a, 0, out=a)
            a += hidden
            y = logits[:m]
            np.matmul(a, p["w2"], out=y)
            np.take(prior, flat, axis=0, out=extra[:m], mode="clip")
            y += extra[:m]
            if np.sqrt(np.einsum("ij,ij->i", a, a).max()) * longest + highest > 59:  # else no sum reaches the bound
                np.minimum(y, f(60), out=y)  # the sum stays finite without taking the largest off
            t = target[i:i + g].ravel()
            mine = y[rows[:m], np.maximum(t, 0)]
            np.exp(y, out=y)
            out[i:i + g] = (mine - np.log(y @ ones)).reshape(n, STRIDE)
        return out

    def _buffers(self, n: int, kind) -> tuple[np.ndarray, np.ndarray]:
        """Two tables of ``n`` rows over the classes; batches of one size share them."""
        if self._kept is None or self._kept[0].shape != (n, self.classes) or self._kept[0].dtype != kind:
            self._kept = np.empty((n, self.classes), kind), np.empty((n, self.classes), kind)
        return self._kept

    def loss_gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean negative log probability over targets >= 0, and its gradients."""
        p, b, dh = self.p, len(x), DIM // HEADS
        a, (at, cur, q, k, v, s, gap, h, z) = self.hidden(x)
        t = target.ravel()
        use = (t >= 0).astype(np.float32)
        n = max(1.0, float(use.sum()))
        logits, e = self._buffers(len(t), a.dtype)
        np.matmul(a, p["w2"], out=logits)
        logits += p["b2"]
        logits += np.take(self.prior, cur.ravel(), axis=0, out=e if e.dtype == self.prior.dtype else None, mode="clip")
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=e)
        total = e.sum(1, keepdims=True)
        rows = np.arange(len(t))
        loss = float((use * (np.log(total[:, 0]) - logits[rows, np.maximum(t, 0)])).sum() / n)
        g = np.divide(e, total, out=e)
        g[rows, np.maximum(t, 0)] -= 1
        g *= (use / n)[:, None]
        out = {"w2": a.T @ g, "b2": g.sum(0)}
        da = g @ p["w2"].T
        dz = da * (z > 0)
        out["w1"], out["b1"] = h.reshape(-1, DIM).T @ dz, dz.sum(0)
        dh_ = (da + dz @ p["w1"].T).reshape(b, STRIDE, DIM)
        do = dh_.reshape(b, STRIDE, HEADS, dh).transpose(0, 2, 1, 3)
        ds = np.matmul(do, v.transpose(0, 1, 3, 2))
        dv = np.matmul(s.transpose(0, 1, 3, 2), do)
        ds = s * (ds - (ds * s).sum(-1, keepdims=True))
        dq = np.matmul(ds, k.transpose(0, 1, 3, 2))
        dk = np.matmul(ds.transpose(0, 1, 3, 2), q)
        near = np.zeros_like(p["near"])
        by_gap = ds.sum(0)
        for i in range(HEADS):
            np.add.at(near[i], gap[gap >= 0], by_gap[i][gap >= 0])
        out["near"] = near
        c = self.classes + 1

        def back(ids, *grads):
            hot = np.zeros((c, len(grads) * DIM), np.float32)
            flat, rows_ = ids.ravel().astype(np.int16), np.hstack([g.reshape(-1, DIM) for g in grads])  # 16 bits sort by digits
            o = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(flat[o]) > 0])
            hot[flat[o][first]] = np.add.reduceat(rows_[o], first, axis=0)
            return np.hsplit(hot, len(grads))
        out["u"], out["q"] = back(cur, dh_, dq.transpose(0, 2, 1, 3))
        out["k"], out["v"] = back(at, dk.transpose(0, 2, 1, 3), dv.transpose(0, 2, 1, 3))
        return loss, out

    def fit(self, x: np.ndarray, target: np.ndarray, steps: int = 500, batch: int = BATCH, rate: float = 0.01,
            seed: int = 7) -> "AttentionLM":
        """Adam over batches of windows, in an order that the seed fixes."""
        if not len(x):
            return self
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        w = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, at = r.permutation(len(x)), 0
        for step in range(1, steps + 1):
            if at >= len(x):
                order, at = r.permutation(len(x)), 0
            pick = order[at:at + batch]
            at += batch
            _, g = self.loss_gradients(x[pick], target[pick])
            lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for k in self.p:
                m[k] += 0.1 * (g[k] - m[k])
                w[k] += 0.01 * (g[k] ** 2 - w[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(w[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        self._kept = None
        return self


def windows(classes: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts that follow each other in ``classes`` (text r is ``bounds[r]:bounds[r + 1]``).

    Returns inputs (-1 before a text), targets (-1 after its end) and, for every target,
    its place in ``classes``. Input 0 of a text is ``start``, input j + 1 its class j."""
    n = np.diff(bounds)
    blocks = -(-n // STRIDE)
    row = np.repeat(np.arange(len(n)), blocks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    last = (nth * STRIDE)[:, None]
    at = last + np.arange(STRIDE)[None]  # predictions of the block
    place = np.where(at < n[row][:, None], bounds[:-1][row][:, None] + at, -1)
    back = last + np.arange(STRIDE - WINDOW, STRIDE)[None]  # inputs; input i is class i - 1
    x = classes[np.clip(bounds[:-1][row][:, None] + back - 1, 0, max(0, len(classes) - 1))]
    x = np.where(back == 0, start, np.where((back < 0) | (back > n[row][:, None]), -1, x))
    return x, np.where(place >= 0, classes[place], -1), place
