"""A small causal self-attention language model in numpy: tables from counts, training by passes over texts, and batched scoring.

A token's probability is that of its class given the tokens before it, from one layer of causal self-attention, times its
share of the class after the previous token.  That share is counted, and drawn towards the share after a token of the previous
one's class, which is drawn towards the share at large.  Keys are merged into the queries and values into the output; inputs and
queries of an id are rows of tables, so scoring gathers instead of multiplying.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32
#: How many counts the wider share weighs.
PULL = 8.0


def _softmax(x):
    x = x - x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _exp(x):
    """Exponentials, in place, of numbers held to a range where no row of floats runs over or sums to nothing."""
    np.clip(x, -80, 80, out=x)
    return np.exp(x, out=x)


class Room:
    """Arrays that one batch after the other uses again, by name."""

    def __init__(self, kind=F32):
        self.kind, self.held = np.dtype(kind), {}

    def __call__(self, name: str, *shape: int, kind=None) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self.held or self.held[name].size < n:
            self.held[name] = np.empty(n, kind or self.kind)
        return self.held[name][:n].reshape(shape)


class Adam:
    """Steps of Adam on weights that lie in one array, so that a step is few calls."""

    def __init__(self, p: dict[str, np.ndarray]):
        ends = np.cumsum([x.size for x in p.values()])[:-1]
        self.flat = np.concatenate([x.ravel() for x in p.values()]).astype(F32)
        self.g, self.m, self.v, self.room = (np.zeros_like(self.flat) for _ in range(4))
        self.p, self.places = ({k: y.reshape(x.shape) for (k, x), y in zip(p.items(), np.split(flat, ends))} for flat in (self.flat, self.g))
        self.done = 0

    def step(self, gradient: dict[str, np.ndarray], rate: float) -> None:
        g, m, v, room = self.g, self.m, self.v, self.room
        self.done += 1
        for k, x in gradient.items():
            self.places[k][...] = x
        m *= F32(0.9)
        m += np.multiply(g, F32(0.1), out=room)
        v *= F32(0.98)
        g *= g
        v += np.multiply(g, F32(0.02), out=room)
        np.sqrt(v, out=room)
        room += F32(1e-8 * (1 - 0.98**self.done) ** 0.5)
        np.divide(m, room, out=room)
        room *= F32(rate * (1 - 0.98**self.done) ** 0.5 / (1 - 0.9**self.done))
        self.flat -= room


def _sums(x):
    """Sums along the last axis, which is kept, as a product."""
    return x @ np.ones((x.shape[-1], 1), F32)


class Pairs:
    """Counts of pairs of ids, found by an open hash."""

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.counts = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, F32)
        keys = keys.astype(np.uint64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            self.keys[at[free]] = keys[left[free]]  # of several for one slot the last stays
            put = self.keys[at] == keys[left]
            self.counts[at[put]] = counts[left[put]]
            left, at = left[~put], (at[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.counts[at], F32(0))
        left = np.flatnonzero((held != keys) & (held != self.EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.counts[at[left[hit]]]
            left = left[~hit & (held != self.EMPTY)]
        return out


class Model:
    """Windows of `window` inputs; the last `stride` of each predict their successor, so every token is scored once."""

    def __init__(self, vocabulary: int, window: int = 24, stride: int = 16, dim: int = 24, classes: int = 64, rows: int = 4096, seed: int = 7):
        self.vocabulary, self.window, self.stride, self.dim, self.classes, self.rows = vocabulary, window, stride, dim, classes, rows
        self.rng = np.random.default_rng(seed)
        self.pad = None

    # -- what counts say about ids

    def rank(self, count: np.ndarray) -> None:
        """Rows from the counts of all ids: frequent ids have their own, all others share one."""
        order = np.lexsort((np.arange(self.vocabulary), -count))
        self.own = own = order[: self.rows][count[order[: self.rows]] > 1]
        self.row = np.full(self.vocabulary, len(own), np.int32)
        self.row[own] = np.arange(len(own))
        self.pad = len(own) + 1
        #: predecessors that are told apart when classes are formed
        self.before = min(512, len(own) + 1)

    def group(self, count: np.ndarray, pair: np.ndarray) -> None:
        """Classes from pair[row, predecessor's row]: frequent ids with like predecessors; the rest is a class of its own."""
        own, k, before = self.own, self.classes - 1, self.before
        pair = pair.astype(F32)
        x = np.sqrt(pair / np.maximum(pair.sum(1, keepdims=True), 1)) if len(own) else pair
        weight = count[own].astype(F32)
        if len(own) > k:
            q = np.linalg.qr(x @ (x.T @ (x @ self.rng.standard_normal((before, 24)).astype(F32))))[0]
            u = (q.T @ x).T
            y = x @ np.linalg.qr(u)[0]
            centre = y[self.rng.choice(len(own), k, replace=False, p=weight / weight.sum())]
            for _ in range(12):
                near = ((y**2).sum(1)[:, None] - 2 * y @ centre.T + (centre**2).sum(1)).argmin(1)
                mass = np.bincount(near, weight, minlength=k)
                for c in np.flatnonzero(mass):
                    centre[c] = (y[near == c] * weight[near == c, None]).sum(0) / mass[c]
        else:
            near = np.arange(len(own))
        self.cls = np.full(self.vocabulary, self.classes - 1, np.int32)
        self.cls[own] = near

    def shares(self, count: np.ndarray, pair: np.ndarray) -> None:
        """Shares within a class from pair[predecessor's class, id], drawn towards the share at large."""
        smooth = count + 0.5
        share = smooth / np.bincount(self.cls, smooth, minlength=self.classes)[self.cls]
        total = np.stack([np.bincount(self.cls, x, minlength=self.classes) for x in pair])[:, self.cls]
        self.share = ((pair + PULL * share) / (total + PULL)).astype(F32)

    def pairs(self, before: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Counts of ids after single predecessors; what is not listed is left to the shares after classes."""
        self.held = Pairs(before * self.vocabulary + ids, counts)
        self.total = np.bincount(before * self.classes + self.cls[ids], counts, minlength=self.vocabulary * self.classes).astype(F32)

    def pairs_by_row(self, before: np.ndarray, ids: np.ndarray):
        """(which, places in pair[row, predecessor's row]) of ids that have a row of their own."""
        r = self.row[ids]
        own = np.flatnonzero(r < len(self.own))
        return own, r[own].astype(np.int64) * self.before + np.minimum(self.row[before[own]], self.before - 1)

    def pairs_by_class(self, before: np.ndarray, ids: np.ndarray):
        """(which, places in pair[predecessor's class, id])."""
        return slice(None), self.cls[before].astype(np.int64) * self.vocabulary + ids

    def _tables(self, ids: np.ndarray, starts: np.ndarray) -> None:
        """All tables from some ids alone."""
        count = np.bincount(ids, minlength=self.vocabulary)
        follow = np.ones(len(ids), bool)
        follow[starts] = False
        i = np.flatnonzero(follow)
        key, n = np.unique(ids[i - 1] * self.vocabulary + ids[i], return_counts=True)
        x, y = np.divmod(key, self.vocabulary)
        tally = lambda places, size: (lambda own, at: np.bincount(at, n[own], minlength=size))(*places(x, y))
        self.rank(count)
        self.group(count, tally(self.pairs_by_row, len(self.own) * self.before).reshape(-1, self.before))
        self.shares(count, tally(self.pairs_by_class, self.classes * self.vocabulary).reshape(self.classes, -1))
        self.pairs(x, y, n)

    def _windows(self, flat: np.ndarray, sizes: np.ndarray):
        """(rows of inputs[window], target ids[stride], their predecessors, owner) for texts given as input ids one after another.

        Each text's first id is the begin mark; the targets are its other ids.
        """
        t, s = self.window, self.stride
        steps = sizes - 1
        n = -(-steps // s)
        padded = n * s + t  # room before the first input, and up to a whole window after the last
        at = np.cumsum(padded) - padded
        total = int(padded.sum())
        rows = np.full(total, self.pad, np.int32)
        ids = np.full(total, -1, np.int64)
        place = np.repeat(at + (t - s), sizes) + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows[place] = self.row[flat]
        ids[place] = flat
        owner = np.repeat(np.arange(len(sizes)), n)
        begin = at[owner] + s * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        win = rows[begin[:, None] + np.arange(t)]
        target = ids[begin[:, None] + np.arange(t - s + 1, t + 1)]
        return win, target, ids[begin[:, None] + np.arange(t - s, t)], owner

    # -- training

    def fit(self, texts: list[np.ndarray], epochs: int = 2, batch: int = 64, rate: float = 0.015) -> "Model":
        """Adam on the windows of some texts, which start with the begin mark or the id before their first.

        Tables that were not set from the counts of a corpus come from these texts.
        """
        self._freeze(self.weights(texts, epochs, batch, rate))
        return self

    def weights(self, texts: list[np.ndarray], epochs: int = 2, batch: int = 64, rate: float = 0.015) -> dict[str, np.ndarray]:
        """What fit() finds, before it is put into tables."""
        texts = [x for x in texts if len(x) > 1] or [np.zeros(2, np.int64)]
        flat, sizes = np.concatenate(texts).astype(np.int64), np.array([len(x) for x in texts])
        if self.pad is None:
            self._tables(flat, np.cumsum(sizes) - sizes)
        d, c, t, s = self.dim, self.classes, self.window, self.stride
        g = lambda *shape, scale=0.1: (self.rng.standard_normal(shape) * scale).astype(F32)
        p = {"e": g(self.pad + 1, d), "p": g(t, d), "q": g(d, d, scale=0.3), "k": g(d, d, scale=0.3), "v": g(d, d, scale=0.3), "o": g(d, d, scale=0.3), "c": g(d, c), "b": np.zeros(c, F32)}
        win, target, _, _ = self._windows(flat, sizes)
        valid = target >= 0
        goal = np.where(valid, self.cls[np.maximum(target, 0)], 0)
        mass = np.bincount(goal[valid], minlength=c) + 1.0
        p["b"] = np.log(mass / mass.sum()).astype(F32)
        adam, room = Adam(p), Room()
        total = max(1, epochs * (-(-len(win) // batch)))
        for _ in range(epochs):
            order = self.rng.permutation(len(win))
            for i in range(0, len(order), batch):
                j = order[i : i + batch]
                adam.step(self._gradient(adam.p, win[j], goal[j], valid[j], room), rate * (1 - 0.9 * (adam.done + 1) / total))
        return adam.p

    def goes_on(self, p: dict[str, np.ndarray], parts, batch: int = 256, rate: float = 0.002) -> tuple[dict[str, np.ndarray], int]:
        """(weights, targets seen) after one pass of Adam, from p on, over the windows of all parts (flat ids, sizes)."""
        adam, room, seen = Adam(p), Room(), 0
        for flat, sizes in parts:
            win, target, _, _ = self._windows(flat, sizes)
            valid = target >= 0
            goal = np.where(valid, self.cls[np.maximum(target, 0)], 0)
            for i in range(0, len(win), batch):
                j = slice(i, i + batch)
                seen += int(valid[j].sum())
                adam.step(self._gradient(adam.p, win[j], goal[j], valid[j], room), rate)
        return adam.p, seen

    def _mask(self):
        t, s = self.window, self.stride
        return np.where(np.arange(t)[None, :] <= np.arange(t - s, t)[:, None], 0, -1e9).astype(F32)

    def _merged(self, p):
        """(what takes an input to its query for inputs, what takes a mean of inputs to the output): one head needs no keys and values of its own."""
        return p["q"] @ p["k"].T * F32(1 / np.sqrt(self.dim)), p["v"] @ p["o"]

    def _gradient(self, p, win, goal, valid, room=None):
        """What the mean loss of some windows changes by, for each weight; products are of whole matrices where they can be."""
        t, s, d, n = self.window, self.stride, self.dim, len(win)
        room = room or Room(p["e"].dtype)
        kind = room.kind
        rows = n * s
        apart = lambda u: u.reshape(n, -1, d)
        to_q, to_h = self._merged(p)
        x = p["e"].take(win, axis=0, out=room("x", n, t, d), mode="clip")
        x += p["p"]
        across = x.transpose(0, 2, 1)
        last = room("last", rows, d)
        apart(last)[...] = x[:, t - s :]
        q = np.matmul(last, to_q, out=room("q", rows, d))
        # shares of inputs and what these change by, and what each is multiplied with, lie one after the other: a product gives both sums
        both, pair = room("both", n, 2 * s, t), room("pair", n, 2 * s, d)
        a, ds = both[:, :s], both[:, s:]
        pair[:, s:] = apart(q)
        np.matmul(apart(q), across, out=a)
        a += self._mask()
        self._without_pads(a, win)
        a = _exp(a)
        a /= a @ np.ones((t, 1), kind)
        z = np.matmul(a, x, out=room("z", n, s, d)).reshape(rows, d)
        h = np.matmul(z, to_h, out=room("h", rows, d))
        h += last
        y = np.matmul(h, p["c"], out=room("y", rows, self.classes))
        y += p["b"]
        y = _exp(y)
        share = valid.ravel() / kind.type(max(1, int(valid.sum())))
        y *= share[:, None] / (y @ np.ones((self.classes, 1), kind))
        y[np.arange(rows), goal.ravel()] -= share
        out = {"c": h.T @ y, "b": np.ones(rows, kind) @ y}
        dh = np.matmul(y, p["c"].T, out=room("dh", rows, d))
        d_h = z.T @ dh
        dz = np.matmul(dh, to_h.T, out=room("dz", rows, d))
        pair[:, :s] = apart(dz)
        np.matmul(apart(dz), across, out=ds)
        ds -= np.einsum("ij,ij->i", dz, z).reshape(n, s, 1)
        ds *= a
        dq = np.matmul(ds, x, out=room("dq", n, s, d)).reshape(rows, d)
        d_q = last.T @ dq * kind.type(1 / np.sqrt(d))
        out["q"], out["k"], out["v"], out["o"] = d_q @ p["k"], d_q.T @ p["q"], d_h @ p["o"].T, p["v"].T @ d_h
        dx = np.matmul(both.transpose(0, 2, 1), pair, out=room("dx", n, t, d))
        dh += np.matmul(dq, to_q.T, out=q)
        dx[:, t - s :] += apart(dh)
        out["p"] = (np.ones(n, kind) @ dx.reshape(n, -1)).reshape(t, d)
        cells = np.arange(p["e"].size).reshape(-1, d).take(win, axis=0, out=room("cells", n, t, d, kind=np.int64), mode="clip")
        out["e"] = np.zeros_like(p["e"])
        np.add.at(out["e"].reshape(-1), cells.ravel(), dx.ravel())
        out["e"][self.pad] = 0
        return out

    def _without_pads(self, a, win) -> None:
        """Hides what stands for no id, in the windows that hold such."""
        pads = win == self.pad
        own = np.flatnonzero(pads.any(axis=1))
        if len(own):
            a[own] += np.where(pads[own], F32(-1e9), F32(0))[:, None, :]

    def _freeze(self, p) -> None:
        """Tables for scoring."""
        t, s = self.window, self.stride
        to_q, self.to_h = self._merged(p)
        self.x, self.px = p["e"], p["p"]
        self.q, self.pq = p["e"] @ to_q, p["p"][t - s :] @ to_q
        self.c, self.b = p["c"], p["b"]
        self.mask = self._mask()
        del self.rng, self.own

    # -- scoring

    def score(self, flat: np.ndarray, sizes: np.ndarray, windows: int = 256) -> np.ndarray:
        """log10 probability of each text's ids after its begin mark."""
        win, target, before, owner = self._windows(flat, sizes)
        t, s, d = self.window, self.stride, self.dim
        out, room = np.zeros(len(sizes)), Room()
        for i in range(0, len(win), windows):
            w, y, last = win[i : i + windows], target[i : i + windows], before[i : i + windows]
            n, ok = len(w), y >= 0
            x = self.x.take(w, axis=0, out=room("x", n, t, d), mode="clip")
            x += self.px
            q = self.q.take(w[:, t - s :], axis=0, out=room("q", n, s, d), mode="clip")
            q += self.pq
            a = np.matmul(q, x.transpose(0, 2, 1), out=room("a", n, s, t))
            a += self.mask
            self._without_pads(a, w)
            a = _exp(a)
            z = np.matmul(a, x, out=room("z", n, s, d))
            z /= _sums(a)
            h = np.matmul(z.reshape(-1, d), self.to_h, out=q.reshape(-1, d))
            h.reshape(n, s, d)[...] += x[:, t - s :]
            logit = np.matmul(h, self.c, out=room("y", n * s, self.classes))
            logit += self.b
            logit = _exp(logit)
            id_, last = np.where(ok, y, 0).ravel(), np.where(ok, last, 0).ravel()
            cls = self.cls[id_]
            got = np.log(logit[np.arange(len(logit)), cls] / _sums(logit)[:, 0])
            wide = self.share[self.cls[last], id_] * F32(PULL)
            got += np.log((self.held.get(last * self.vocabulary + id_) + wide) / (self.total[last * self.classes + cls] + F32(PULL)))
            per = np.where(ok, got.reshape(ok.shape), 0).sum(axis=1, dtype=np.float64)
            out += np.bincount(owner[i : i + windows], per, minlength=len(sizes))
        return out / np.log(10)
