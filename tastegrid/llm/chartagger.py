"""A character-level bidirectional LSTM with a CRF on top, in numpy: training, emissions, decoding."""

from __future__ import annotations

import unicodedata

import numpy as np

from tastegrid.llm.lstmgraph import session, tagger_graph

#: ids 0..127 are ASCII; the rest are classes of characters
PAD, LATIN, DEVANAGARI, BENGALI, LETTER, MARK, SYMBOL, PUNCT, SPACE, OTHER = 0, 128, 129, 130, 131, 132, 133, 134, 135, 136
VOCAB = 137
EMBED = 24


def _class(cp: int) -> int:
    if cp < 128:
        return cp or OTHER
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cat == "Nd":
        return 48 + unicodedata.digit(ch)
    if 0xD800 <= cp < 0xE000:
        return OTHER
    base = unicodedata.normalize("NFKD", ch)[0]
    if ord(base) < 128 and cat[0] in "LNP":
        return ord(base)
    if cat[0] == "M":
        return MARK
    if 0x900 <= cp < 0x980:
        return DEVANAGARI
    if 0x980 <= cp < 0xA00:
        return BENGALI
    if cat[0] == "L":
        return LATIN if cp < 0x250 else LETTER
    return {"P": PUNCT, "Z": SPACE, "S": SYMBOL}.get(cat[0], OTHER)


_TABLE: np.ndarray | None = None


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters as ids, end to end, and the offsets of the texts."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([_class(c) for c in range(0x10000)], dtype=np.uint8)
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ids = np.where(cps < 0x10000, _TABLE[np.minimum(cps, 0xFFFF)], SYMBOL).astype(np.uint8)
    return ids, np.cumsum([0, *map(len, texts)])


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class CharTagger:
    """Labels are 0..k-1. Parameters: character vectors, input and recurrent weights of both directions, output weights, transitions."""

    def __init__(self, labels: int, hidden: int = 32, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        h = hidden
        f = np.float32
        self.h, self.k = h, labels
        self.ordinary: set[str] = set()
        self.graph = None
        self.p = {
            "char": (r.normal(size=(VOCAB, EMBED))).astype(f),
            "w": (r.normal(size=(2, EMBED, 4 * h)) / np.sqrt(EMBED)).astype(f),
            "b": np.zeros((2, 4 * h), f),
            "u": (r.normal(size=(2, h, 4 * h)) / np.sqrt(h)).astype(f),
            "out": (r.normal(size=(2 * h, labels)) / np.sqrt(h)).astype(f),
            "bias": np.zeros(labels, f),
            "trans": np.zeros((labels, labels), f),
            "start": np.zeros(labels, f),
        }
        self.p["b"][:, h : 2 * h] += 1.0  # forget gates open

    # --- the network -----------------------------------------------------------------------------------------
    def _forward(self, ids: np.ndarray, lengths: np.ndarray, keep: bool):
        """ids (B, T), padded right. Returns the hidden states (B, T, 2H)."""
        b, t = ids.shape
        h = self.h
        x = np.stack([ids, ids[:, ::-1]])
        mask = (np.arange(t)[None, :] < lengths[:, None]).astype(np.float32)
        mask = np.stack([mask, mask[:, ::-1]])
        u = self.p["u"]
        table = np.matmul(self.p["char"], self.p["w"]) + self.p["b"][:, None, :]
        hs = np.zeros((t + 1, 2, b, h), np.float32)
        cs = np.zeros((t + 1, 2, b, h), np.float32) if keep else None
        gates = np.empty((t, 2, b, 4 * h), np.float32) if keep else None
        tanhs = np.empty((t, 2, b, h), np.float32) if keep else None
        c = np.zeros((2, b, h), np.float32)
        g = np.empty((2, b, 4 * h), np.float32)
        for s in range(t):
            np.matmul(hs[s], u, out=g)
            g[0] += table[0][x[0, :, s]]
            g[1] += table[1][x[1, :, s]]
            # i, f, o are sigmoids, the last quarter is a tanh: one tanh over all
            g[..., : 3 * h] *= 0.5
            np.tanh(g, out=g)
            g[..., : 3 * h] *= 0.5
            g[..., : 3 * h] += 0.5
            m = mask[:, :, s, None]
            c = (g[..., h : 2 * h] * c + g[..., :h] * g[..., 3 * h :]) * m
            tc = np.tanh(c)
            np.multiply(g[..., 2 * h : 3 * h], tc, out=hs[s + 1])
            hs[s + 1] *= m
            if keep:
                gates[s], tanhs[s], cs[s + 1] = g, tc, c
        out = np.concatenate([hs[1:, 0].transpose(1, 0, 2), hs[1:, 1][::-1].transpose(1, 0, 2)], axis=2)
        return out, (x, mask, hs, cs, gates, tanhs)

    def emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.graph is not None:
            return self.graph.run(None, {"ids": np.ascontiguousarray(ids.T, dtype=np.int32), "lens": lengths.astype(np.int32)})[0].transpose(1, 0, 2)
        out, _ = self._forward(ids, lengths, False)
        return out @ self.p["out"] + self.p["bias"]

    def _backward(self, dout: np.ndarray, saved) -> dict[str, np.ndarray]:
        x, mask, hs, cs, gates, tanhs = saved
        t, _, b, _ = gates.shape
        h = self.h
        u = self.p["u"]
        dh_all = np.stack([dout[:, :, :h].transpose(1, 0, 2), dout[:, ::-1, h:].transpose(1, 0, 2)], axis=1)
        dg_all = np.empty_like(gates)
        dh, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        ut = u.transpose(0, 2, 1)
        for s in range(t - 1, -1, -1):
            m = mask[:, :, s, None]
            g, tc = gates[s], tanhs[s]
            i, f, o, z = g[..., :h], g[..., h : 2 * h], g[..., 2 * h : 3 * h], g[..., 3 * h :]
            dh = (dh + dh_all[s]) * m
            dcs = (dc + dh * o * (1 - tc * tc)) * m
            dg = dg_all[s]
            dg[..., :h] = dcs * z * i * (1 - i)
            dg[..., h : 2 * h] = dcs * cs[s] * f * (1 - f)
            dg[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
            dg[..., 3 * h :] = dcs * i * (1 - z * z)
            dc = dcs * f
            dh = np.matmul(dg, ut)
        du = np.empty_like(u)
        dw, db, dchar = np.empty_like(self.p["w"]), np.empty_like(self.p["b"]), np.zeros_like(self.p["char"])
        for d in range(2):
            dg = dg_all[:, d].reshape(-1, 4 * h)
            du[d] = hs[:-1, d].reshape(-1, h).T @ dg
            flat = x[d].T.ravel()
            dw[d] = self.p["char"][flat].T @ dg
            db[d] = dg.sum(0)
            order = np.argsort(flat, kind="stable")
            found, first = np.unique(flat[order], return_index=True)
            dchar[found] += np.add.reduceat((dg @ self.p["w"][d].T)[order], first, axis=0)
        return {"u": du, "w": dw, "b": db, "char": dchar}

    # --- the CRF ---------------------------------------------------------------------------------------------
    def _crf_grad(self, e: np.ndarray, y: np.ndarray, lengths: np.ndarray):
        """Negative log-likelihood a sequence and gradients of emissions, transitions, start."""
        b, t, k = e.shape
        trans, start = self.p["trans"], self.p["start"]
        et = np.exp(trans)
        alpha = np.empty((t, b, k), np.float32)
        scale = np.zeros((t, b), np.float32)
        live = np.arange(t)[:, None] < lengths[None, :]
        top = e.max(axis=2)
        ee = np.exp(e - top[:, :, None])
        a = np.exp(start)[None] * ee[:, 0]
        z = a.sum(1)
        alpha[0], scale[0] = a / z[:, None], z
        for s in range(1, t):
            a = (alpha[s - 1] @ et) * ee[:, s]
            z = a.sum(1)
            alpha[s], scale[s] = np.where(live[s][:, None], a / z[:, None], alpha[s - 1]), np.where(live[s], z, 1.0)
        beta = np.ones((b, k), np.float32)
        de = np.zeros_like(e)
        dtrans = np.zeros_like(trans)
        for s in range(t - 1, -1, -1):
            post = alpha[s] * beta
            post /= post.sum(1, keepdims=True)
            de[:, s] = post * live[s][:, None]
            if s:
                w = beta * ee[:, s] / scale[s][:, None]
                share = live[s] / ((alpha[s - 1] @ et) * w).sum(1)
                dtrans += et * ((alpha[s - 1] * share[:, None]).T @ w)
                beta = np.where(live[s][:, None], w @ et.T, beta)
        dstart = de[:, 0].sum(0)
        log_z = np.log(scale).sum(0) + (top * live.T).sum(1)
        valid = live.T
        gold = start[y[:, 0]] + (np.take_along_axis(e, y[:, :, None].astype(np.int64), 2)[:, :, 0] * valid).sum(1) + (trans[y[:, :-1], y[:, 1:]] * valid[:, 1:]).sum(1)
        np.add.at(dstart, y[:, 0], -1)
        r, c = np.nonzero(valid)
        de[r, c, y[r, c]] -= 1
        pairs = y[:, :-1].astype(np.int64) * k + y[:, 1:]
        dtrans -= np.bincount(pairs[valid[:, 1:]], minlength=k * k).reshape(k, k)
        return log_z - gold, de, dtrans, dstart

    def fit(self, ids: np.ndarray, lengths: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.012, seed: int = 7) -> list[float]:
        """Adam over shuffled batches of windows of similar length; returns the loss a character of each epoch."""
        self.graph = None
        r = np.random.default_rng(seed)
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v = {n: np.zeros_like(x) for n, x in self.p.items()}
        step, losses = 0, []
        n = len(ids)
        total = epochs * -(-n // batch)
        for _ in range(epochs):
            order = np.argsort(lengths + r.random(n) * 8, kind="stable")
            blocks = [order[i : i + batch] for i in range(0, n, batch)]
            r.shuffle(blocks)
            loss = 0.0
            for at in blocks:
                t = int(lengths[at].max())
                x, ls, ys = ids[at, :t], lengths[at], y[at, :t]
                out, saved = self._forward(x, ls, True)
                e = out @ self.p["out"] + self.p["bias"]
                nll, de, dtrans, dstart = self._crf_grad(e, ys, ls)
                loss += float(nll.sum())
                flat = de.reshape(-1, self.k)
                grads = {"out": out.reshape(-1, 2 * self.h).T @ flat, "bias": flat.sum(0), "trans": dtrans, "start": dstart}
                grads |= self._backward(de @ self.p["out"].T, saved)
                size = float(len(at))
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / size
                clip = min(1.0, 5.0 / (norm + 1e-9)) / size
                step += 1
                lr = rate * min(1.0, step / 20) * (1 - step / (total + 1)) ** 0.7
                for name, g in grads.items():
                    g = g * clip
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(loss / float(lengths.sum()))
        return losses

    def compile(self) -> None:
        """From now on emissions come from onnxruntime, where it is installed. Training ends it."""
        self.graph = session(tagger_graph(self.p, self.h, self.k))

    # --- whole texts -----------------------------------------------------------------------------------------
    def tag(self, texts: list[str], window: int = 128, overlap: int = 32, batch: int = 512) -> list[np.ndarray]:
        """The best label sequence of each text. Emissions of overlapping windows are blended with weights that fall
        towards a window's inner edges; one Viterbi pass a text then reconciles all its windows."""
        ids, at = encode(texts)
        k = self.k
        scores = np.zeros((len(ids), k), np.float32)
        weight = np.zeros(len(ids), np.float32)
        assert 2 * overlap <= window
        begins, sizes, turns = [], [], []
        for i in range(len(texts)):
            a, z = int(at[i]), int(at[i + 1])
            while True:
                begins.append(a)
                sizes.append(min(window, z - a))
                turns.append(len(turns) & 1)
                if a + window >= z:
                    break
                a += window - overlap
        begins, sizes, turn = np.array(begins, dtype=np.int64), np.array(sizes, dtype=np.int64), np.array(turns, dtype=np.int8)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        for i in range(0, len(order), batch):
            w = order[i : i + batch]
            t = int(sizes[w].max())
            pos = begins[w][:, None] + np.arange(t)[None, :]
            ok = np.arange(t)[None, :] < sizes[w][:, None]
            x = np.where(ok, ids[np.minimum(pos, len(ids) - 1)], PAD)
            e = self.emissions(x, sizes[w])
            edge = np.minimum(np.arange(t)[None, :], sizes[w][:, None] - 1 - np.arange(t)[None, :]) + 1.0
            wt = np.minimum(edge, overlap).astype(np.float32)
            flat, part, share = pos[ok], e[ok] * wt[ok][:, None], wt[ok]
            for parity in (0, 1):  # windows of equal parity never overlap, as the overlap is less than half a window
                on = np.broadcast_to(turn[w][:, None] == parity, ok.shape)[ok]
                scores[flat[on]] += part[on]
                weight[flat[on]] += share[on]
        scores /= np.maximum(weight, 1e-6)[:, None]
        return self._viterbi(scores, at, batch)

    def _viterbi(self, scores: np.ndarray, at: np.ndarray, batch: int) -> list[np.ndarray]:
        trans, start = self.p["trans"], self.p["start"]
        n = len(at) - 1
        sizes = np.diff(at)
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * n
        # a text whose label 0 leads everywhere by more than what transitions can ever make up has no other label
        gain = 2 * max(0.0, float((trans - trans[0, 0]).max()), float((start - start[0]).max()))
        open_at = np.concatenate([[0], np.cumsum(scores[:, 1:].max(1) + gain >= scores[:, 0])])
        plain = open_at[at[1:]] == open_at[at[:-1]]
        for i in np.flatnonzero(plain):
            out[i] = np.zeros(sizes[i], np.int8)
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes[order] > 0) & ~plain[order]]
        for i in range(0, len(order), batch):
            w = order[i : i + batch]
            t = int(sizes[w].max())
            if t > 4096 and len(w) > 8:  # few long texts at a time
                parts = [w[j : j + 8] for j in range(0, len(w), 8)]
            else:
                parts = [w]
            for w in parts:
                t = int(sizes[w].max())
                b = len(w)
                back = np.zeros((t, b, self.k), np.int8)
                best = start[None] + scores[at[w]]
                for s in range(1, t):
                    cand = best[:, :, None] + trans[None]
                    arg = cand.argmax(1)
                    live = (s < sizes[w])[:, None]
                    new = np.take_along_axis(cand, arg[:, None, :], 1)[:, 0] + scores[np.minimum(at[w] + s, len(scores) - 1)]
                    best = np.where(live, new, best)
                    back[s] = np.where(live, arg, np.arange(self.k)[None])
                lab = best.argmax(1)
                path = np.empty((t, b), np.int8)
                rows = np.arange(b)
                for s in range(t - 1, -1, -1):
                    path[s] = lab
                    lab = back[s][rows, lab]
                for j, doc in enumerate(w):
                    out[doc] = path[: sizes[doc], j]
        return out
