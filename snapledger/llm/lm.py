"""A small causal self-attention language model in numpy on subword ids.

A text is its words, lower-cased, cut into subwords by a public vocabulary, and one end. From the subwords before it the
model gives the next subword's class, and the subword within that class: two softmaxes, each of a prior's logarithm plus the
output of one layer of causal self-attention. The prior is a table of counts of pairs over all training texts, so
the net, which starts at nothing, learns what the pair doesn't say. The two levels are exact, for every subword has one class, and cost
about twice the root of the vocabulary instead of all of it. Long texts are scored in overlapping windows: every window after the
first scores only what the one before hasn't.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np

from .words import Places

#: Ids of the vocabulary, then the end of a text, which also stands before its beginning.
END = 50_256
SIZE = 50_257
WINDOW, STRIDE = 32, 24
WIDTH, HIDDEN = 24, 32
#: Cells of the prior's table: rows for what stands before, columns for what follows. PRIOR: weight of a subword's frequency against a row's counts.
TABLE, PRIOR = 4_000_000, 8.0
#: What the net adds to a prior's logarithm lies between minus this and this.
LIMIT = 30


#: White space beyond ASCII's, which the vocabulary's pattern splits at; such words are cut one by one.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words that are remembered.
KNOWN = 500_000


class Subwords:
    """Cuts words, given as bytes, into ids of a public byte-level vocabulary, and remembers them."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path) as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
        self.encode = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        (self.stop,) = self.encode("\n")
        self.forget()

    @property
    def keys(self) -> np.ndarray:
        return self.places.keys

    def forget(self) -> None:
        self.places = Places()
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.begin, self.n = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, spelled: list[str]) -> None:
        """Many words are cut at once, a line each: a line feed is one id, and no word holds one."""
        lines = "\n ".join(spelled)
        odd = [bool(ODD.search(w)) for w in spelled] if ODD.search(lines) else []
        if odd:
            lines = "\n ".join("-" if o else w for w, o in zip(spelled, odd, strict=True))
        ids = np.array(self.encode(f" {lines}\n -"), np.int32)
        stops = np.flatnonzero(ids == self.stop)
        if len(stops) != len(spelled):
            raise RuntimeError("a word holds a line feed")
        if not odd:
            n = np.diff(np.r_[-1, stops]) - 1
            flat = np.delete(ids[: stops[-1] + 1], stops)
        else:
            pieces = [np.array(self.encode(" " + w), np.int32) if o else p[p != self.stop] for p, w, o in zip(np.split(ids, stops)[:-1], spelled, odd, strict=True)]
            n, flat = np.array([len(p) for p in pieces], np.int64), np.concatenate(pieces)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        first = len(self.keys)
        while first + len(n) > len(self.n):
            self.n, self.begin = np.concatenate([self.n, np.empty_like(self.n)]), np.concatenate([self.begin, np.empty_like(self.begin)])
        self.n[first : first + len(n)] = n
        self.begin[first : first + len(n)] = self.used + np.cumsum(n) - n
        self.used += len(flat)

    def cut(self, h: np.ndarray, spelled) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with hashes h, one after another, and where each word's begin. ``spelled`` gives the words with some numbers."""
        if len(self.keys) > KNOWN:
            self.forget()
        where = self.places.find(h)
        new = np.flatnonzero(where < 0)
        if len(new):
            own, at = np.unique(h[new], return_index=True)
            self._learn(spelled(new[at]))
            self.places.add(own)
            where[new] = self.places.find(h[new])
        counts = self.n[where]
        first = np.r_[0, np.cumsum(counts)]
        return self.pool[np.repeat(self.begin[where] - first[:-1], counts) + np.arange(first[-1])], first


def windows(ids: np.ndarray, first: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts that lie one after another, as matrices: the ids before each place, and the place of what is to be scored (-1: nothing). A text's ids are each scored once; what a window shares with the one before is context only."""
    n = np.diff(first)
    count = np.where(n <= WINDOW, 1, 1 + -(-(n - WINDOW) // stride)) * (n > 0)
    of = np.repeat(np.arange(len(n)), count)
    k = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
    step = np.arange(WINDOW, dtype=np.int32)[None, :]
    place = k[:, None] * np.int32(stride) + step
    inside = place < n[of].astype(np.int32)[:, None]
    start = first[of].astype(np.int32)[:, None]
    x = ids.astype(np.int32).take(np.where(inside & (place > 0), place + start - 1, 0))
    x[~inside | (place == 0)] = END
    inside &= (k[:, None] == 0) | (step >= WINDOW - stride)
    return x, np.where(inside, place + start, np.int32(-1))


@dataclass
class Lexicon:
    """The ids that training texts hold, in classes. ``place`` of an id is its position in order of class; all ids that training lacks share one place. ``row``: by place, the row of the prior for what follows it; ``begin``: where
    classes begin among places, and one more at the end; ``of``: the class of a place; ``lacking``: how many ids share the place of those that training lacks."""

    place: np.ndarray
    row: np.ndarray
    rows: int
    begin: np.ndarray
    of: np.ndarray
    lacking: np.ndarray

    @property
    def size(self) -> int:
        return len(self.of)


def ranked(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """From counts by id: the rank of each by frequency (ids that never stand share the last), rows by rank, and how many rows there are. Ranks beyond what the table has room for share rows."""
    known = np.flatnonzero(counts)
    order = known[np.lexsort((known, -counts[known]))]
    rank = np.full(SIZE, len(order), np.int64)
    rank[order] = np.arange(len(order))
    size = len(order) + 1
    rows = max(1, min(size, TABLE // size))
    shared = rows // 4 + 1 if rows < size else 0
    at = np.arange(size)
    return rank, np.where(at < rows - shared, at, rows - shared + at % max(1, shared)), rows


def pairs(rank: np.ndarray, row: np.ndarray, rows: int, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts of (row of the id before, rank) in texts that lie one after another, an END before each."""
    before = np.r_[END, ids[:-1]]
    before[first[:-1][np.diff(first) > 0]] = END
    return np.bincount(row[rank[before]] * len(row) + rank[ids], minlength=rows * len(row))


def lexicon(rank: np.ndarray, row: np.ndarray, counts: np.ndarray, rounds: int = 8, seed: int = 9) -> tuple[Lexicon, np.ndarray]:
    """Classes by k-means on what stands before each id, about as many as the root of the number of ids; and P(id | row) by place, smoothed.

    counts: of (row, rank).
    """
    size, rows = len(row), counts.shape[0]
    alone = counts.sum(0, dtype=np.float64) + 0.02
    prior = counts + (PRIOR * alone / alone.sum()).astype(np.float32)
    prior /= prior.sum(1, keepdims=True)
    f = np.sqrt(counts / np.maximum(counts.sum(0), 1)).T
    f /= np.maximum(np.sqrt((f * f).sum(1, keepdims=True)), 1e-9)
    weight = np.sqrt(alone).astype(np.float32)
    n = max(1, round(size**0.5))
    center = f[np.random.default_rng(seed).choice(size, n, replace=False, p=weight / weight.sum(dtype=np.float64))]
    for _ in range(rounds):
        to = np.argmax(f @ center.T, 1)
        for c in range(n):
            mine = to == c
            if mine.any():
                m = weight[mine] @ f[mine]
                center[c] = m / max(float(np.sqrt(m @ m)), 1e-9)
    to = np.unique(np.argmax(f @ center.T, 1), return_inverse=True)[1]
    order = np.lexsort((np.arange(size), to))
    to_place = np.empty(size, np.int64)
    to_place[order] = np.arange(size)
    sizes = np.bincount(to)
    return Lexicon(to_place[rank], row[order], rows, np.r_[0, np.cumsum(sizes)], to[order], np.where(order == size - 1, max(1, int((rank == size - 1).sum())), 1)), prior[:, order]


@dataclass
class Net:
    """Weights: embeddings of places in the lexicon, of positions in a window; query, key and value side by side; hidden layer; output to classes, and to places within their class."""

    e: np.ndarray
    p: np.ndarray
    a: np.ndarray
    w: np.ndarray
    c: np.ndarray
    o: np.ndarray
    r: np.ndarray

    @staticmethod
    def fresh(lex: Lexicon, seed: int = 5) -> Net:
        """Random but for the output, which starts at nothing: so the model starts as its prior."""
        rng = np.random.default_rng(seed)
        g = lambda scale, *s: (rng.normal(size=s) * scale).astype(np.float32)
        zero = lambda *s: np.zeros(s, np.float32)
        return Net(g(0.3, lex.size, WIDTH), g(0.1, WINDOW, WIDTH), g(0.3 * WIDTH**-0.5, WIDTH, 3 * WIDTH), g(0.45 * WIDTH**-0.5, 3 * WIDTH, HIDDEN), zero(HIDDEN), zero(HIDDEN, len(lex.begin) - 1), zero(lex.size, HIDDEN))

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.p, self.a, self.w, self.c, self.o, self.r]

    def forward(self, x: np.ndarray) -> tuple:
        """Of windows of places: all that gradients need, the last one the hidden layer, a row for each position.

        The hidden layer sees the embedding of the subword before, of the one before that, and what attention gathers from all up to here.
        """
        m, n = x.shape
        h = self.e.take(x, axis=0)
        h += self.p[:n]
        every = h.reshape(-1, WIDTH) @ self.a
        q, k, v = (np.ascontiguousarray(every[:, i * WIDTH : (i + 1) * WIDTH]).reshape(m, n, WIDTH) for i in range(3))
        q *= SCALE
        a = np.matmul(q, k.transpose(0, 2, 1))
        np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        a *= SEEN[:n, :n]
        a /= (a.reshape(-1, n) @ ONES[:n]).reshape(m, n, 1)
        u = np.empty((m, n, 3 * WIDTH), h.dtype)
        u[..., :WIDTH] = h
        u[:, 0, WIDTH : 2 * WIDTH] = 0
        u[:, 1:, WIDTH : 2 * WIDTH] = h[:, :-1]
        u[..., 2 * WIDTH :] = np.matmul(a, v)
        z = u.reshape(-1, 3 * WIDTH) @ self.w
        z += self.c
        return h, q, k, v, a, u, np.maximum(z, 0, out=z)


class Known:
    """What of a net's hidden layer depends on one place alone, for all places and positions: scoring, whose weights stand, looks it up instead of computing it at each place of each window.

    Query, key, and the hidden layer's shares of the value, of the subword before and of the one before that; the same sums as in ``forward``, in another order.
    """

    def __init__(self, net: Net):
        q, k, v = (net.a[:, i * WIDTH : (i + 1) * WIDTH] for i in range(3))
        last, earlier, seen = (net.w[i * WIDTH : (i + 1) * WIDTH] for i in range(3))
        self.at = [(net.e @ m, net.p @ m) for m in (q * SCALE, k, v @ seen, last, earlier)]
        self.at[3] = self.at[3][0], self.at[3][1] + net.c

    def hidden(self, x: np.ndarray, skip: int = 0) -> np.ndarray:
        """The hidden layer of windows of places, a row for each position but the first ``skip``, which are context only."""
        n = x.shape[1]
        q, k, v, last, earlier = self.at
        look = lambda by, begin, end: by[0].take(x[:, begin:end], axis=0) + by[1][begin:end]
        a = np.matmul(look(q, skip, n), look(k, 0, n).transpose(0, 2, 1))
        np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        a *= SEEN[skip:n, :n]
        z = np.matmul(a, look(v, 0, n))
        z /= (a.reshape(-1, n) @ ONES[:n]).reshape(len(x), n - skip, 1)
        z += look(last, skip, n)
        begin = max(skip, 1)
        z[:, begin - skip :] += earlier[0].take(x[:, begin - 1 : n - 1], axis=0)
        z[:, begin - skip :] += earlier[1][begin - 1 : n - 1]
        z = z.reshape(-1, HIDDEN)
        return np.maximum(z, 0, out=z)


def _weighed(logits: np.ndarray, prior: np.ndarray, row: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In place, prior times exp(logits), which are held within LIMIT: totals of rows, y's, and where y's lie among all."""
    np.clip(logits, -LIMIT, LIMIT, out=logits)
    np.exp(logits, out=logits)
    logits *= prior.take(row, axis=0)
    at = np.arange(0, logits.size, logits.shape[1]) + y
    return logits @ np.ones(logits.shape[1], logits.dtype), logits.reshape(-1).take(at), at


def _errors(logits: np.ndarray, prior: np.ndarray, row: np.ndarray, y: np.ndarray, n: int) -> float:
    """In place, gradients of the mean cross-entropy over n; gives the sum of the cross-entropy."""
    total, picked, at = _weighed(logits, prior, row, y)
    logits *= (1 / (n * total))[:, None]
    logits.reshape(-1)[at] = picked / (n * total) - logits.dtype.type(1 / n)
    return float(np.log(total / picked).sum())


@dataclass
class Model:
    """P(place | before) = P(class | before) P(place | class, before); each factor is the prior times the exponential of what the net adds, made to sum to one. ``prior``: by class, rows times places; ``of_class``: rows times classes."""

    lex: Lexicon
    net: Net
    prior: list[np.ndarray]
    of_class: np.ndarray

    @staticmethod
    def start(lex: Lexicon, prior: np.ndarray) -> Model:
        parts = [np.ascontiguousarray(prior[:, a:b]) for a, b in zip(lex.begin[:-1], lex.begin[1:], strict=True)]
        return Model(lex, Net.fresh(lex), parts, np.stack([p.sum(1) for p in parts], 1))

    def _each_class(self, y: np.ndarray):
        """The classes of y, the order that sorts them, and for each class that stands: itself, its first place and one past the last, and its slice of that order."""
        cls = self.lex.of[y]
        order = np.argsort(cls.astype(np.int16), kind="stable")
        at = np.searchsorted(cls[order], np.arange(len(self.lex.begin)))
        return cls, order, [(c, self.lex.begin[c], self.lex.begin[c + 1], slice(at[c], at[c + 1])) for c in np.flatnonzero(np.diff(at))]

    def logs(self, x: np.ndarray, y: np.ndarray, on: np.ndarray, known: Known, skip: int = 0) -> np.ndarray:
        """Natural logarithms of P(y) where ``on``, in order; y and on lack the first ``skip`` places of the windows x."""
        at = np.flatnonzero(on)
        y, row = y.ravel()[at], self.lex.row[x[:, skip:].ravel()[at]]
        cls, order, groups = self._each_class(y)
        z, out, begin = np.empty((len(at), HIDDEN), self.net.e.dtype), np.empty(len(at)), 0
        for i in range(0, len(x), FORWARD):
            own = known.hidden(x[i : i + FORWARD], skip).take(np.flatnonzero(on[i : i + FORWARD]), axis=0)
            end = begin + len(own)
            total, picked, _ = _weighed(own @ self.net.o, self.of_class, row[begin:end], cls[begin:end])
            z[begin:end], out[begin:end] = own, picked / total
            begin = end
        z, y, row, within = z.take(order, axis=0), y[order], row[order], np.empty(len(at), np.float32)
        for c, begin, end, of in groups:
            total, picked, _ = _weighed(z[of] @ self.net.r[begin:end].T, self.prior[c], row[of], y[of] - begin)
            within[of] = picked / total
        out[order] *= within
        return np.log(out)

    def gradients(self, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], float]:
        """Of the mean cross-entropy of y where ``on``: the places whose embeddings x holds, gradients in order of the net's parts (the embeddings' for those places), and the loss."""
        net, (m, t) = self.net, x.shape
        chunks = [slice(i, i + BACKWARD) for i in range(0, m, BACKWARD)]
        passed = [net.forward(x[c]) for c in chunks]
        every = np.concatenate([p[-1] for p in passed])
        at = np.flatnonzero(on)
        n = max(1, len(at))
        cls, order, groups = self._each_class(y.ravel()[at])
        at, cls = at[order], cls[order]
        z, y, row = every.take(at, axis=0), y.ravel()[at], self.lex.row[x.ravel()[at]]
        do, dz, dr, loss = np.zeros_like(net.o), np.empty_like(z), np.zeros_like(net.r), 0.0
        for i in range(0, len(at), BACKWARD * WINDOW):
            of = slice(i, i + BACKWARD * WINDOW)
            logits = z[of] @ net.o
            loss += _errors(logits, self.of_class, row[of], cls[of], n)
            do += z[of].T @ logits
            np.matmul(logits, net.o.T, out=dz[of])
        for c, begin, end, of in groups:
            own = net.r[begin:end]
            logits = z[of] @ own.T
            loss += _errors(logits, self.prior[c], row[of], y[of] - begin, n)
            dr[begin:end] = logits.T @ z[of]
            dz[of] += logits @ own
        dz *= z > 0
        full = np.zeros_like(every)
        full[at] = dz
        dw, dc, dattend, dh = np.zeros_like(net.w), np.ones(len(full), full.dtype) @ full, np.zeros_like(net.a), np.empty((m, t, WIDTH), full.dtype)
        for c, (h, q, k, v, a, u, _) in zip(chunks, passed, strict=True):
            own = full[c.start * t : c.stop * t]
            dw += u.reshape(-1, 3 * WIDTH).T @ own
            du = (own @ net.w.T).reshape(-1, t, 3 * WIDTH)
            dt = np.ascontiguousarray(du[..., 2 * WIDTH :])
            da, dv = np.matmul(dt, v.transpose(0, 2, 1)), np.matmul(a.transpose(0, 2, 1), dt)
            da -= ((da * a).reshape(-1, t) @ np.ones(t, da.dtype)).reshape(-1, t, 1)
            da *= a
            dall = np.empty_like(du)
            dall[..., :WIDTH] = np.matmul(da, k)
            dall[..., :WIDTH] *= SCALE
            dall[..., WIDTH : 2 * WIDTH] = np.matmul(da.transpose(0, 2, 1), q)
            dall[..., 2 * WIDTH :] = dv
            dall = dall.reshape(-1, 3 * WIDTH)
            dattend += h.reshape(-1, WIDTH).T @ dall
            into = dh[c]
            np.matmul(dall, net.a.T, out=into.reshape(-1, WIDTH))
            into += du[..., :WIDTH]
            into[:, :-1] += du[:, 1:, WIDTH : 2 * WIDTH]
        dp = np.zeros_like(net.p)
        dp[:t] = dh.sum(0)
        place = x.ravel()
        by = np.argsort(place.astype(np.uint16), kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(place[by]) != 0])
        return place[by][begin], [np.add.reduceat(dh.reshape(-1, WIDTH).take(by, axis=0), begin, axis=0), dp, dattend, dw, dc, do, dr], loss / n

    def score(self, ids: np.ndarray, first: np.ndarray, batch: int = 1024) -> np.ndarray:
        """log10 probability of each id of texts that lie one after another."""
        x, target = windows(ids, first)
        x, y, out, known = self.lex.place[x], self.lex.place[ids], np.zeros(len(ids)), Known(self.net)
        for skip, some in (0, target[:, 0] >= 0), (WINDOW - STRIDE, target[:, 0] < 0):
            some = np.flatnonzero(some)
            for i in range(0, len(some), batch):
                own = some[i : i + batch]
                to = target[own, skip:]
                on = to >= 0
                out[to[on]] = self.logs(x[own], y[np.maximum(to, 0)], on, known, skip)
        return (out - np.log(self.lex.lacking[y])) / np.log(10)


class Trainer:
    """Adam, in place, its state kept between calls; embeddings move only where they stand."""

    def __init__(self, model: Model):
        self.model, self.step = model, 0
        self.means = [np.zeros_like(p) for p in model.net.parts()[1:]]
        self.squares = [np.zeros_like(p) for p in model.net.parts()]

    def train(self, ids: np.ndarray, first: np.ndarray, rate, rounds: int = 1, seed: int = 3, batch: int = 128) -> float:
        """Over windows of all ids, each standing in one, shuffled; ``rate(step, share of this call's steps)``. The mean loss of the last round."""
        x, target = windows(ids, first, WINDOW)
        lex, net = self.model.lex, self.model.net
        x, y, on = lex.place[x], lex.place[ids][np.maximum(target, 0)] if len(ids) else target, target >= 0
        rng, total, losses, done = np.random.default_rng(seed), max(1, rounds * -(-len(x) // batch)), [], 0
        for _ in range(rounds):
            order, losses = rng.permutation(len(x)), []
            for i in range(0, len(x), batch):
                own = order[i : i + batch]
                places, grads, loss = self.model.gradients(x[own], y[own], on[own])
                losses.append(loss)
                self.step += 1
                done += 1
                lr = np.float32(rate(self.step, done / total))
                squares = self.squares[0][places]
                squares += 0.05 * (grads[0] ** 2 - squares)
                self.squares[0][places] = squares
                net.e[places] -= lr * grads[0] / (np.sqrt(squares) + 1e-7)
                for p, g, m, s in zip(net.parts()[1:], grads[1:], self.means, self.squares[1:], strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= lr * (m / np.float32(1 - 0.9**self.step)) / (np.sqrt(s / np.float32(1 - 0.99**self.step)) + np.float32(1e-8))
        return float(np.mean(losses)) if losses else 0.0


#: Windows whose hidden layers are computed at once when scoring, and when training, where more is kept of each; few enough for the processor's cache.
FORWARD, BACKWARD = 64, 32
ONES = np.ones(WINDOW, np.float32)
SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
SCALE = np.float32(WIDTH**-0.5)
