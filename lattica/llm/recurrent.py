"""A small bidirectional LSTM tagger in numpy, with an optional linear-chain CRF on top."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def lstm_forward(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """Hidden states (T, B, H) from gate inputs (T, B, 4H: in, forget, out, new); padded steps carry the state on."""
    steps, batch, width = gates.shape
    h4 = width // 4
    h, c = np.zeros((batch, h4), F32), np.zeros((batch, h4), F32)
    out = np.zeros((steps, batch, h4), F32)
    cache = []
    for t in range(steps):
        a = gates[t] + h @ u
        s, g = _sigmoid(a[:, : 3 * h4]), np.tanh(a[:, 3 * h4 :])
        i, f, o = s[:, :h4], s[:, h4 : 2 * h4], s[:, 2 * h4 :]
        new = f * c + i * g
        tanh_new = np.tanh(new)
        m = mask[t][:, None]
        if keep:
            cache.append((h, c, s, g, tanh_new, m))
        c, h = np.where(m, new, c), np.where(m, o * tanh_new, h)
        out[t] = h
    return (out, cache) if keep else out


def lstm_backward(d_out: np.ndarray, cache: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``u``."""
    steps, batch, h4 = d_out.shape
    d_gates, d_u = np.zeros((steps, batch, 4 * h4), F32), np.zeros_like(u)
    dh, dc = np.zeros((batch, h4), F32), np.zeros((batch, h4), F32)
    for t in range(steps - 1, -1, -1):
        h, c, s, g, tanh_new, m = cache[t]
        i, f, o = s[:, :h4], s[:, h4 : 2 * h4], s[:, 2 * h4 :]
        dh = dh + d_out[t]
        d_new = np.where(m, dh * o * (1 - tanh_new**2) + dc, 0)
        da = np.concatenate([d_new * g, d_new * c, np.where(m, dh * tanh_new, 0), d_new * i], 1)
        da[:, : 3 * h4] *= s * (1 - s)
        da[:, 3 * h4 :] *= 1 - g**2
        d_gates[t] = da
        d_u += h.T @ da
        dh, dc = np.where(m, da @ u.T, dh), np.where(m, d_new * f, dc)
    return d_gates, d_u


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def crf_gradient(scores: np.ndarray, mask: np.ndarray, tags: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of tag paths, with gradients of scores (T, B, K) and moves (K, K)."""
    steps, batch, k = scores.shape
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = np.where(mask[t][:, None], _log_sum(alpha[t - 1][:, :, None] + moves, 1) + scores[t], alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(mask[t + 1][:, None], _log_sum((beta[t + 1] + scores[t + 1])[:, None, :] + moves, 2), beta[t + 1])
    total = _log_sum(alpha[-1], 1)
    hot = np.eye(k, dtype=F32)[tags] * mask[:, :, None]
    d_scores = np.exp(alpha + beta - total[:, None]) * mask[:, :, None] - hot
    d_moves, gold = np.zeros_like(moves), (scores * hot).sum((0, 2))
    for t in range(1, steps):
        both = np.exp(alpha[t - 1][:, :, None] + moves + (scores[t] + beta[t])[:, None, :] - total[:, None, None]) * mask[t][:, None, None]
        d_moves += both.sum(0)
        np.add.at(d_moves, (tags[t - 1][mask[t]], tags[t][mask[t]]), -1)
        gold = gold + np.where(mask[t], moves[tags[t - 1], tags[t]], 0)
    return float((total - gold).mean()), d_scores / batch, d_moves / batch


def viterbi(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tag path of every sequence, (T, B)."""
    steps, batch, k = scores.shape
    best, back = scores[0], np.zeros((steps, batch, k), np.int8)
    for t in range(1, steps):
        via = best[:, :, None] + moves
        back[t] = np.where(mask[t][:, None], via.argmax(1), np.arange(k))
        best = np.where(mask[t][:, None], via.max(1) + scores[t], best)
    path = np.zeros((steps, batch), np.int64)
    path[-1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t][np.arange(batch), path[t]]
    return path


class Tagger:
    """Embedded symbols (or given vectors) -> bidirectional LSTM -> tag scores -> CRF path.

    With ``symbols`` the input is (T, B) ids; otherwise it is (T, B, width) vectors.
    """

    def __init__(self, width: int, hidden: int, tags: int, symbols: int = 0, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(F32)
        self.symbols, self.hidden = symbols, hidden
        self.p = {"wf": init(width, 4 * hidden), "wb": init(width, 4 * hidden), "uf": init(hidden, 4 * hidden), "ub": init(hidden, 4 * hidden)}
        self.p |= {"bf": np.zeros(4 * hidden, F32), "bb": np.zeros(4 * hidden, F32), "out": init(2 * hidden, tags), "bo": np.zeros(tags, F32), "moves": np.zeros((tags, tags), F32)}
        self.p["bf"][hidden : 2 * hidden] = self.p["bb"][hidden : 2 * hidden] = 1
        if symbols:
            self.p["table"] = rng.normal(0, 0.5, (symbols, width)).astype(F32)

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        p = self.p
        v = p["table"][x] if self.symbols else x
        forward = lstm_forward(v @ p["wf"] + p["bf"], mask, p["uf"], keep)
        backward = lstm_forward((v @ p["wb"] + p["bb"])[::-1], mask[::-1], p["ub"], keep)
        (hf, cf), (hb, cb) = (forward, backward) if keep else ((forward, None), (backward, None))
        h = np.concatenate([hf, hb[::-1]], 2)
        s = h @ p["out"] + p["bo"]
        return (s, (v, h, cf, cb)) if keep else s

    def decode(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return viterbi(self.scores(x, mask), mask, self.p["moves"])

    def gradient(self, x: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, h4 = self.p, self.hidden
        s, (v, h, cf, cb) = self.scores(x, mask, keep=True)
        loss, ds, d_moves = crf_gradient(s, mask, tags, p["moves"])
        ds = ds.astype(F32)
        g = {"moves": d_moves.astype(F32), "out": np.einsum("tbh,tbk->hk", h, ds), "bo": ds.sum((0, 1))}
        dh = ds @ p["out"].T
        df, g["uf"] = lstm_backward(dh[:, :, :h4], cf, p["uf"])
        db, g["ub"] = lstm_backward(dh[::-1, :, h4:], cb, p["ub"])
        db = db[::-1]
        flat = v.reshape(-1, v.shape[2])
        for way, d in (("f", df), ("b", db)):
            d = d.reshape(-1, d.shape[2])
            g["w" + way], g["b" + way] = flat.T @ d, d.sum(0)
        if self.symbols:
            dv = df.reshape(-1, 4 * h4) @ p["wf"].T + db.reshape(-1, 4 * h4) @ p["wb"].T
            g["table"] = np.zeros_like(p["table"])
            np.add.at(g["table"], x.ravel(), dv)
        return loss, g

    def fit(self, x: np.ndarray, mask: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.02, seed: int = 1) -> float:
        """Adam over shuffled batches of sequences, (T, N, ...); returns the last mean loss."""
        rng, n, k, loss = np.random.default_rng(seed), mask.shape[1], 0, 0.0
        m, v = ({a: np.zeros_like(b) for a, b in self.p.items()} for _ in range(2))
        total = epochs * -(-n // batch)
        for _ in range(epochs):
            order, losses = rng.permutation(n), []
            for at in range(0, n, batch):
                pick = order[at : at + batch]
                loss, g = self.gradient(x[:, pick], mask[:, pick], tags[:, pick])
                norm = np.sqrt(sum(float((d**2).sum()) for d in g.values()))
                k += 1
                step = rate * (1 - 0.9 * k / total)
                for a, d in g.items():
                    d = d * min(1.0, 5 / (norm + 1e-9))
                    m[a] = 0.9 * m[a] + 0.1 * d
                    v[a] = 0.99 * v[a] + 0.01 * d * d
                    self.p[a] = (self.p[a] - step * (m[a] / (1 - 0.9**k)) / (np.sqrt(v[a] / (1 - 0.99**k)) + 1e-6)).astype(F32)
                losses.append(loss)
            loss = float(np.mean(losses))
        return loss
