"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

import numpy as np

from codefacts.llm.common import ship

HIDDEN, EMBED = 16, 12
#: Characters told apart: printable ASCII; then line feed, other white space, other letters, anything else, padding.
OTHER = 95
SIZE = OTHER + 5


def char_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ids = np.where((code >= 32) & (code < 127), code - 32, OTHER + 3)
    ids[code == 10] = OTHER
    ids[(code == 9) | (code == 13) | (code == 11) | (code == 12)] = OTHER + 1
    ids[(code >= 0xC0) & (code < 0x2000)] = OTHER + 2
    return ids


PAD = SIZE - 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Weights by name; ``tags`` counts the labels, 0 being outside."""

    def __init__(self, tags: int, seed: int = 7):
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.tags = tags
        self.w = {"E": make(SIZE, e), "Wo": make(2 * h, tags), "bo": np.zeros(tags, np.float32), "A": np.zeros((tags, tags), np.float32), "a0": np.zeros(tags, np.float32)}
        for d in "fb":
            self.w |= {f"Wx{d}": make(e, 4 * h), f"Wh{d}": make(h, 4 * h), f"b{d}": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)].astype(np.float32)}

    def _scan(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction, [T, B, H]; x is [T, B]."""
        h = HIDDEN
        inputs = self.w["E"] @ self.w[f"Wx{d}"] + self.w[f"b{d}"]
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        out = np.empty((*x.shape, h), np.float32)
        hid = cell = np.zeros((x.shape[1], h), np.float32)
        saved = {}
        for t in steps:
            z = inputs[x[t]] + hid @ self.w[f"Wh{d}"]
            s = _sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            new = s[:, h : 2 * h] * cell + s[:, :h] * g
            tc = np.tanh(new)
            if keep:
                saved[t] = (s, g, cell, tc, hid)
            cell = new
            hid = s[:, 2 * h :] * tc
            out[t] = hid
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        f, _ = self._scan(x, "f", False)
        b, _ = self._scan(x, "b", False)
        return np.concatenate([f, b], 2) @ self.w["Wo"] + self.w["bo"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of labels y [T, B] and its gradients."""
        T, B = x.shape
        h, w = HIDDEN, self.w
        f, sf = self._scan(x, "f", True)
        b, sb = self._scan(x, "b", True)
        hid = np.concatenate([f, b], 2)
        em = (hid @ w["Wo"] + w["bo"]).astype(np.float64)
        A, a0 = w["A"].astype(np.float64), w["a0"].astype(np.float64)
        sum_exp = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha = np.empty_like(em)
        beta = np.zeros_like(em)
        alpha[0] = a0 + em[0]
        for t in range(1, T):
            alpha[t] = sum_exp(alpha[t - 1][:, :, None] + A, 1) + em[t]
        for t in range(T - 2, -1, -1):
            beta[t] = sum_exp(A + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = sum_exp(alpha[-1], 1)
        rows = np.arange(B)
        gold = a0[y[0]] + em[0, rows, y[0]]
        for t in range(1, T):
            gold += A[y[t - 1], y[t]] + em[t, rows, y[t]]
        d_em = np.exp(alpha + beta - z[None, :, None])
        g = {"A": np.zeros_like(A), "a0": d_em[0].sum(0)}
        np.add.at(g["a0"], y[0], -1)
        for t in range(1, T):
            g["A"] += np.exp(alpha[t - 1][:, :, None] + A + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(g["A"], (y[:-1].ravel(), y[1:].ravel()), -1)
        d_em[np.arange(T)[:, None], rows, y] -= 1
        d_em = d_em.astype(np.float32)
        g["Wo"], g["bo"] = np.einsum("tbh,tbk->hk", hid, d_em), d_em.sum((0, 1))
        d_hid = d_em @ w["Wo"].T
        g["E"] = np.zeros_like(w["E"])
        hot = np.eye(SIZE, dtype=np.float32)[x]
        for d, saved, part in (("f", sf, d_hid[:, :, :h]), ("b", sb, d_hid[:, :, h:])):
            dz_all = np.zeros((SIZE, 4 * h), np.float32)
            g[f"Wh{d}"] = np.zeros_like(w[f"Wh{d}"])
            dh = dc = np.zeros((B, h), np.float32)
            for t in range(T - 1, -1, -1) if d == "f" else range(T):
                s, gg, cell, tc, before = saved[t]
                i, fo, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
                dh = dh + part[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * cell * fo * (1 - fo), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                dz_all += hot[t].T @ dz
                g[f"Wh{d}"] += before.T @ dz
                dh, dc = dz @ w[f"Wh{d}"].T, dc * fo
            g[f"b{d}"] = dz_all.sum(0)
            g[f"Wx{d}"] = w["E"].T @ dz_all
            g["E"] += dz_all @ w[f"Wx{d}"].T
        return float((z - gold).mean()), {k: (v / B).astype(np.float32) for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam over windows x [N, T] with labels y; the mean loss of each epoch."""
        r = np.random.default_rng(seed)
        m, v, losses, step = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, [], 0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, seen = r.permutation(len(x)), []
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                loss, g = self.gradients(x[pick].T, y[pick].T)
                step += 1
                now = rate * (1 - 0.9 * step / total)
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for k, a in g.items():
                    a = a * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    self.w[k] = self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses

    def best(self, em: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Best labels [T, B] by scores [T, B, tags] and the transitions that are allowed."""
        A = np.where(allowed, self.w["A"], -1e4).astype(np.float32)
        first = np.where(allowed[0], self.w["a0"], -1e4)
        score = em[0] + first
        back = np.empty(em.shape, np.int8)
        for t in range(1, len(em)):
            step = score[:, :, None] + A
            back[t] = step.argmax(1)
            score = step.max(1) + em[t]
        out = np.empty(em.shape[:2], np.int8)
        out[-1] = score.argmax(1)
        rows = np.arange(em.shape[1])
        for t in range(len(em) - 1, 0, -1):
            out[t - 1] = back[t, rows, out[t]]
        return out


ship(__name__)
