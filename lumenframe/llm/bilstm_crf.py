"""A character-level bidirectional LSTM with a linear-chain CRF, in numpy: training and decoding."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone", "secret")
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Characters told apart: ASCII, then one for other letters, one for the rest and one for padding.
LETTER, REST, PAD = 128, 129, 130
SYMBOLS = 131


def codes(text: str, size: int) -> np.ndarray:
    """Symbol numbers of ``text``, padded to ``size``."""
    out = np.full(size, PAD, np.int64)
    out[: len(text)] = [o if (o := ord(c)) < 128 else LETTER if c.isalpha() else REST for c in text[:size]]
    return out


def allowed() -> np.ndarray:
    """Which tag may follow which: an inside only after its own begin or inside."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        begin, inside = 1 + 2 * k, 2 + 2 * k
        ok[:, inside] = False
        ok[[begin, inside], inside] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Parameters and the passes over batches of equally long windows."""

    def __init__(self, width: int = 12, hidden: int = 20, seed: int = 11):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"emb": make(SYMBOLS, width), "out": make(2 * hidden, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "lr":
            self.p |= {f"{d}x": make(width, 4 * hidden), f"{d}h": make(hidden, 4 * hidden), f"{d}b": np.zeros(4 * hidden, np.float32)}
            self.p[f"{d}b"][hidden : 2 * hidden] = 1.0
        self.ban = np.where(allowed(), 0.0, -1e4).astype(np.float32)
        self.ban_first = np.array([0.0] + [0.0, -1e4] * len(KINDS), np.float32)

    def _run(self, d: str, ids: np.ndarray) -> tuple[np.ndarray, list]:
        p, h = self.p, self.hidden
        table = p["emb"] @ p[f"{d}x"] + p[f"{d}b"]
        n, t = ids.shape
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.empty((t, n, h), np.float32), []
        for i in range(t) if d == "l" else range(t - 1, -1, -1):
            z = table[ids[:, i]] + state @ p[f"{d}h"]
            gate = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            before, was = cell, state
            cell = gate[:, h : 2 * h] * cell + gate[:, :h] * new
            squashed = np.tanh(cell)
            state = gate[:, 2 * h :] * squashed
            out[i] = state
            kept.append((i, gate, new, before, was, squashed))
        return out, kept

    def scores(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Emissions as (time, window, tag)."""
        left, kl = self._run("l", ids)
        right, kr = self._run("r", ids)
        both = np.concatenate([left, right], axis=2)
        return both @ self.p["out"] + self.p["out_b"], (both, kl, kr)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The negative log-likelihood per window, and its gradients."""
        p, h = self.p, self.hidden
        e, (both, kl, kr) = self.scores(ids)
        t, n, _ = e.shape
        trans, first = p["trans"] + self.ban, p["first"] + self.ban_first
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0] + first
        for i in range(1, t):
            a[i] = e[i] + _lse(a[i - 1][:, :, None] + trans, 1)
        for i in range(t - 2, -1, -1):
            b[i] = _lse((e[i + 1] + b[i + 1])[:, None, :] + trans, 2)
        z = _lse(a[-1], 1)
        de = np.exp(a + b - z[None, :, None])
        dt = np.zeros_like(trans)
        # exp(a + trans + e + b - z) summed over windows and places, as one product scaled by each place's top.
        ends = e[1:] + b[1:]
        top_a, top_b = a[:-1].max(axis=2, keepdims=True), ends.max(axis=2, keepdims=True)
        scale = np.exp(np.minimum(top_a + top_b - z[None, :, None], 60.0))
        dt += np.tensordot(np.exp(a[:-1] - top_a) * scale, np.exp(ends - top_b), ((0, 1), (0, 1))) * np.exp(trans)
        gold = np.zeros(n, np.float64)
        rows = np.arange(n)
        for i in range(t):
            gold += e[i][rows, tags[:, i]]
            de[i][rows, tags[:, i]] -= 1
            if i:
                gold += trans[tags[:, i - 1], tags[:, i]]
        dt -= np.bincount((tags[:, :-1] * TAGS + tags[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        gold += first[tags[:, 0]]
        g = {"first": de[0].sum(axis=0), "trans": dt, "out_b": de.sum(axis=(0, 1)), "out": np.tensordot(both, de, ((0, 1), (0, 1)))}
        dboth = de @ p["out"].T
        g["emb"] = np.zeros_like(p["emb"])
        one_hot = np.eye(SYMBOLS, dtype=np.float32)[ids]
        for d, kept, dh_all in (("l", kl, dboth[:, :, :h]), ("r", kr, dboth[:, :, h:])):
            gx, gh, gb = np.zeros((SYMBOLS, 4 * h), np.float32), np.zeros_like(p[f"{d}h"]), 0
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for i, gate, new, before, was, squashed in reversed(kept):
                dh = dh + dh_all[i]
                dc = dc + dh * gate[:, 2 * h :] * (1 - squashed**2)
                dgate = np.concatenate([dc * new, dc * before, dh * squashed], axis=1) * gate * (1 - gate)
                dz = np.concatenate([dgate, dc * gate[:, :h] * (1 - new**2)], axis=1)
                gx += one_hot[:, i].T @ dz
                gh += was.T @ dz
                dh, dc = dz @ p[f"{d}h"].T, dc * gate[:, h : 2 * h]
            gb = gx.sum(axis=0)
            g |= {f"{d}x": p["emb"].T @ gx, f"{d}h": gh, f"{d}b": gb}
            g["emb"] += gx @ p[f"{d}x"].T
        return float((z - gold).mean()), {k: (v / n).astype(np.float32) for k, v in g.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 16, batch: int = 64, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, history = 0, []
        for epoch in range(epochs):
            losses = []
            order = rng.permutation(len(ids))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                value, g = self.loss(ids[rows], tags[rows])
                losses.append(value)
                step += 1
                norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                scale = min(1.0, 5.0 / (norm + 1e-9)) * 1.0
                lr = rate * (1 - epoch / (epochs + 1))
                for k in self.p:
                    x = g[k] * scale
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v2[k] = 0.999 * v2[k] + 0.001 * x * x
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            history.append(float(np.mean(losses)))
        return history

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        e, _ = self.scores(ids)
        t, n, _ = e.shape
        trans = self.p["trans"] + self.ban
        best, back = e[0] + self.p["first"] + self.ban_first, np.zeros((t, n, TAGS), np.int8)
        for i in range(1, t):
            step = best[:, :, None] + trans
            back[i] = step.argmax(axis=1)
            best = step.max(axis=1) + e[i]
        tags = np.empty((n, t), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i][rows, tags[:, i]]
        return tags


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of one window's tags."""
    found, at, kind = [], None, None
    for i, t in enumerate([*tags.tolist(), 0]):
        if at is not None and t != 2 + 2 * kind:
            found.append((kind, at, i))
            at = None
        if t and t % 2 == 1:
            at, kind = i, (t - 1) // 2
    return found
