"""A character-level bidirectional LSTM with CRF transitions, in numpy."""
from __future__ import annotations

import numpy as np

#: Tags: outside, then begin and inside of each kind.
KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
_SIGNS = "@.-_+()[]{} \n\t,:;/\\#%=\"'*|<>&!?$~^`"
PAD, OTHER, DIGIT = 0, 1, 2
_ASCII = np.full(128, OTHER, np.int64)
for _i, _c in enumerate(_SIGNS):
    _ASCII[ord(_c)] = 3 + _i
for _i in range(26):
    _ASCII[97 + _i] = 3 + len(_SIGNS) + _i
    _ASCII[65 + _i] = 3 + len(_SIGNS) + 26 + _i
_ASCII[48:58] = DIGIT
SYMBOLS = 3 + len(_SIGNS) + 52


def symbols(text: str) -> np.ndarray:
    """Input symbol of each character: letters, signs, one for all digits, one
    for the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], OTHER)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsum(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (SYMBOLS, 4 * h))
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, TAGS))
        self.p["ob"] = np.zeros(TAGS)
        self.p["t"] = np.zeros((TAGS, TAGS))
        # an inside tag follows the begin or inside tag of its kind only
        self.barred = np.zeros((TAGS, TAGS))
        for k in range(len(KINDS)):
            ok = np.zeros(TAGS, bool)
            ok[[1 + 2 * k, 2 + 2 * k]] = True
            self.barred[~ok, 2 + 2 * k] = -1e4
        self.first = np.array([0.0] + [0.0, -1e4] * len(KINDS))

    # -- the LSTM
    def _run(self, d: str, ids: np.ndarray, keep: bool):
        h_n, (b, n) = self.hidden, ids.shape
        wh, gates_in = self.p["h" + d], self.p["x" + d][ids] + self.p["c" + d]
        h, c = np.zeros((b, h_n)), np.zeros((b, h_n))
        out, tape = np.empty((b, n, h_n)), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = gates_in[:, t] + h @ wh
            s = _sigmoid(z[:, :3 * h_n])
            i, f, o, g = s[:, :h_n], s[:, h_n:2 * h_n], s[:, 2 * h_n:], np.tanh(z[:, 3 * h_n:])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                tape.append((t, h, before, i, f, o, g, tc))
            h = o * tc
            out[:, t] = h
        return out, tape

    def _back(self, d: str, ids, dout, tape, grad):
        h_n, wh = self.hidden, self.p["h" + d]
        dh, dc = np.zeros(dout[:, 0].shape), np.zeros(dout[:, 0].shape)
        dx, dwh = np.zeros_like(self.p["x" + d]), np.zeros_like(wh)
        for t, h, before, i, f, o, g, tc in reversed(tape):
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o),
                                 dc * i * (1 - g * g)], 1)
            dwh += h.T @ dz
            np.add.at(dx, ids[:, t], dz)
            dh, dc = dz @ wh.T, dc * f
        grad["x" + d], grad["h" + d], grad["c" + d] = dx, dwh, dx.sum(0)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(d, ids, False)[0] for d in "fb"], 2)
        return both @ self.p["o"] + self.p["ob"]

    # -- the CRF
    def _lattice(self, e: np.ndarray):
        trans = self.p["t"] + self.barred
        b, n, k = e.shape
        a, z = np.empty_like(e), np.empty_like(e)
        a[:, 0] = e[:, 0] + self.first
        for t in range(1, n):
            a[:, t] = e[:, t] + _logsum(a[:, t - 1][:, :, None] + trans, 1)
        z[:, -1] = 0
        for t in range(n - 2, -1, -1):
            z[:, t] = _logsum(trans + (e[:, t + 1] + z[:, t + 1])[:, None, :], 2)
        return a, z, _logsum(a[:, -1], 1), trans

    def _loss(self, ids, tags):
        grad: dict[str, np.ndarray] = {}
        runs = {d: self._run(d, ids, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        e = both @ self.p["o"] + self.p["ob"]
        a, z, total, trans = self._lattice(e)
        b, n, k = e.shape
        marginal = np.exp(a + z - total[:, None, None])
        one = np.eye(k)[tags]
        pairs = np.exp(a[:, :-1, :, None] + trans + (e[:, 1:] + z[:, 1:])[:, :, None, :] - total[:, None, None, None])
        seen = np.einsum("btk,btl->kl", one[:, :-1], one[:, 1:])
        path = (e * one).sum((1, 2)) + (trans * 1.0)[tags[:, :-1], tags[:, 1:]].sum(1)
        de = (marginal - one) / b
        grad["t"] = (pairs.sum((0, 1)) - seen) / b
        grad["ob"] = de.sum((0, 1))
        grad["o"] = np.einsum("bth,btk->hk", both, de)
        dboth = de @ self.p["o"].T
        for j, d in enumerate("fb"):
            self._back(d, ids, dboth[:, :, j * self.hidden:(j + 1) * self.hidden], runs[d][1], grad)
        return float((total - path).mean()), grad

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.02,
            seed: int = 5) -> list[float]:
        """Adam on shuffled batches; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, loss = rng.permutation(len(ids)), []
            lr = rate * (1 - 0.8 * epoch / epochs)
            for lo in range(0, len(ids), batch):
                part = order[lo:lo + batch]
                now, grad = self._loss(ids[part], tags[part])
                loss.append(now)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5 / (norm + 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
            losses.append(float(np.mean(loss)))
        return losses

    def decode(self, ids: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Per window the spans (kind, start, end, mean marginal probability)
        of the best path."""
        e = self.emissions(ids)
        b, n, k = e.shape
        a, z, total, trans = self._lattice(e)
        marginal = np.exp(a + z - total[:, None, None])
        best, back = e[:, 0] + self.first, np.empty((b, n, k), np.int8)
        for t in range(1, n):
            cand = best[:, :, None] + trans
            back[:, t] = cand.argmax(1)
            best = e[:, t] + cand.max(1)
        path = np.empty((b, n), np.int8)
        path[:, -1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            path[:, t - 1] = np.take_along_axis(back[:, t], path[:, t][:, None].astype(np.int64), 1)[:, 0]
        out = []
        for w in range(b):
            spans, t = [], 0
            while t < n:
                tag = int(path[w, t])
                if tag % 2 == 1:
                    end = t + 1
                    while end < n and path[w, end] == tag + 1:
                        end += 1
                    sure = marginal[w, np.arange(t, end), path[w, t:end].astype(int)].mean()
                    spans.append(((tag - 1) // 2, t, end, float(sure)))
                    t = end
                else:
                    t += 1
            out.append(spans)
        return out
