"""A gated recurrent language model in numpy: truncated backpropagation over parallel lanes, a softmax factored by classes.

Outcomes are ``head`` words, each in a class, and ``tail`` classes, which stand for all other words (their shares within a class are counted
elsewhere). The probability of a head word is that of its class times its own within the class; classes hold about the same mass of the training text.
"""

from __future__ import annotations

import heapq

import numpy as np

WIDTH = 16  # units of the state
LANES = 512  # sequences side by side
STEPS = 32  # steps of a window: gradients reach back this far, the state goes on
SEGMENT = 2048  # longer sequences are trained on in parts of this size, side by side; they are scored whole
RATE = 0.08
ROWS = 512  # of outputs worked on at once: 200 KB of the classes' scores


class Layout:
    """Classes of the head words (by falling count, cut at equal mass) and of the tail."""

    def __init__(self, counts: np.ndarray, tail: np.ndarray, classes: int):
        """``counts``: of the head words, falling; ``tail``: of each tail class."""
        mass = np.cumsum(counts) - counts / 2
        self.of = np.minimum((mass * classes / max(counts.sum(), 1)).astype(np.int64), classes - 1) if len(counts) else np.zeros(0, np.int64)
        self.of = np.unique(self.of, return_inverse=True)[1].astype(np.int64)  # no empty class
        self.n_head = int(self.of[-1]) + 1 if len(counts) else 0
        self.first = np.append(np.searchsorted(self.of, np.arange(self.n_head)), len(counts))
        self.words, self.n_tail = len(counts), len(tail)
        self.classes = self.n_head + self.n_tail
        own = np.append(np.add.reduceat(counts, self.first[:-1]) if self.n_head else np.zeros(0), tail) + 0.5
        self.class_bias = np.log(own / own.sum()).astype(np.float32)
        within = np.log(np.maximum(counts, 1) / np.maximum(own[self.of] - 0.5, 1)) if len(counts) else np.zeros(0)
        self.word_bias = within.astype(np.float32)
        # class of each outcome: head words, then tail classes
        self.class_of = np.append(self.of, self.n_head + np.arange(self.n_tail))


NAMES = ("inputs", "hidden", "hidden_bias", "classes", "class_bias", "words", "word_bias")


def fresh(layout: Layout, width: int = WIDTH, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters before training: the outputs start at the counted shares. The last row of ``inputs`` stands for the start of a document."""
    rng = np.random.default_rng(seed)
    f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "inputs": f(layout.words + layout.n_tail + 1, 3 * width, scale=0.5), "hidden": f(width, 3 * width, scale=width**-0.5), "hidden_bias": np.zeros(3 * width, np.float32),
        "classes": f(width, layout.classes, scale=0.05), "class_bias": layout.class_bias.copy(), "words": f(layout.words, width, scale=0.05), "word_bias": layout.word_bias.copy(),
    }


def lanes(lengths: np.ndarray, n: int) -> list[np.ndarray]:
    """Sequences dealt to at most ``n`` lanes of about the same length, the longest lane first."""
    heap = [(0, k) for k in range(min(n, len(lengths)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, k = heapq.heappop(heap)
        dealt[k].append(i)
        heapq.heappush(heap, (size + int(lengths[i]), k))
    return [np.array(dealt[k], np.int64) for _, k in sorted(heap, key=lambda x: (-x[0], x[1]))]


class Feed:
    """Windows over lanes of sequences ids[start : start + length]."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int):
        rows = lanes(lengths, n)
        self.sizes = np.array([int(lengths[r].sum()) for r in rows], np.int64)
        order = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        size = lengths[order]
        self.where = np.arange(int(size.sum())) + np.repeat(starts[order] - (np.cumsum(size) - size), size)  # of all lanes, one after another
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids = ids
        self.opens = np.zeros(len(ids) + 1, bool)
        self.opens[starts[lengths > 0]] = True

    def windows(self, steps: int):
        """``place (t, lanes), active (t)``: positions in ``ids`` of a window's steps; lanes that ended are at the back, and few lanes take longer windows."""
        top, lo = int(self.sizes.max(initial=0)), 0
        while lo < top:
            n = int(np.searchsorted(-self.sizes, -lo, "left"))  # lanes longer than lo
            t = min(max(steps, 4096 // n), top - lo)
            step = np.arange(lo, lo + t)[:, None]
            if self.sizes[n - 1] >= lo + t:
                place = self.where[self.first[:n] + step]
            else:
                place = np.where(step < self.sizes[:n], self.where[np.minimum(self.first[:n] + step, len(self.where) - 1)], -1)
            yield place, (place >= 0).sum(axis=1)
            lo += t


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # 1 / inf is the limit
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    def __init__(self, layout: Layout, params: dict[str, np.ndarray]):
        self.layout, self.p = layout, params
        self.width = len(params["hidden"])
        self.start = len(params["inputs"]) - 1

    # --- recurrence

    def forward(self, seen: list[np.ndarray], opens: list[np.ndarray], h: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
        """States after each step; ``seen[t]`` the inputs of the lanes active at t (a prefix of those at t - 1); a state is zero where ``opens``.

        Within, units are rows and lanes columns, so that every gate is one run of memory.
        """
        w, p, out, h = self.width, self.p, [], h.T
        hidden, bias = np.ascontiguousarray(p["hidden"].T), p["hidden_bias"][:, None]
        for ids, fresh_ in zip(seen, opens, strict=True):
            h = h[:, : len(ids)]
            if fresh_.any():
                h = np.where(fresh_, h.dtype.type(0), h)
            g = hidden @ h
            g += bias
            x = np.ascontiguousarray(p["inputs"].take(ids, axis=0).T)
            gates, c = x[: 2 * w], x[2 * w :]
            gates += g[: 2 * w]
            _sigmoid(gates)
            r, z = gates[:w], gates[w:]
            c += r * g[2 * w :]
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if keep is not None:
                keep.append((ids, h, r, z, c, g[2 * w :], fresh_))
            h = new
            out.append(h.T)
        return out

    def backward(self, keep: list, dout: list[np.ndarray], grad: dict) -> None:
        w, p = self.width, self.p
        after = np.zeros((w, 0), np.float32)
        inputs, gates = [], []
        for (ids, h, r, z, c, gc, fresh_), d in zip(reversed(keep), reversed(dout), strict=True):
            own = np.empty((4 * w, len(ids)), h.dtype)  # candidate, reset, update, and the candidate's part of the state
            dc, dr, dz, drc = own[:w], own[w : 2 * w], own[2 * w : 3 * w], own[3 * w :]
            d = d.T.copy()
            d[:, : after.shape[1]] += after
            on = d * z
            np.subtract(d, on, out=dc)
            np.subtract(h, c, out=dz)
            dz *= z
            dz *= dc
            slope = c * c
            np.subtract(1, slope, out=slope)
            dc *= slope
            np.multiply(dc, r, out=drc)
            np.subtract(1, r, out=dr)
            dr *= drc
            dr *= gc
            grad["hidden"] += h @ own[w:].T
            grad["hidden_bias"] += own[w:].sum(axis=1)
            after = p["hidden"] @ own[w:]
            after += on
            if fresh_.any():
                after[:, fresh_] = 0
            inputs.append(ids)
            gates.append(np.ascontiguousarray(own[: 3 * w].T))
        rows, g = summed_rows(np.concatenate(inputs), np.concatenate(gates))
        grad["inputs"] = rows, np.roll(g, -w, axis=1)

    # --- outputs

    def outputs(self, h: np.ndarray, told: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P of each outcome told after state h; with ``grad`` also the gradient on h of the sum of -ln P, and the outputs' own.

        A last unit of one carries the biases. Rows are taken as many at a time as a core's cache holds.
        """
        lay, p, w = self.layout, self.p, self.width
        of, n = lay.class_of[told], len(told)
        one = np.empty((n, w + 1), h.dtype)
        one[:, :w], one[:, w] = h, 1
        classes, back = np.vstack([p["classes"], p["class_bias"]]), np.ascontiguousarray(p["classes"].T)
        logp, dh = np.empty(n, h.dtype), None if grad is None else np.empty((n, w), h.dtype)
        ones, each = np.ones(max(lay.classes, int(np.diff(lay.first).max(initial=1))), h.dtype), np.arange(ROWS)
        for lo in range(0, n, ROWS):
            x, which = one[lo : lo + ROWS], of[lo : lo + ROWS]
            e = x @ classes
            own = e[each[: len(x)], which]
            np.exp(e, out=e)  # states are within (-1, 1) and weights bounded (``Trainer``), so this can't overflow
            total = e @ ones[: lay.classes]
            np.subtract(own, np.log(total), out=logp[lo : lo + ROWS])
            if grad is not None:
                e *= (1 / total)[:, None]
                e[each[: len(x)], which] -= 1
                np.matmul(e, back, out=dh[lo : lo + ROWS])
                g = x.T @ e
                grad["classes"] += g[:w]
                grad["class_bias"] += g[w]
        order = np.argsort(of.astype(np.uint16), kind="stable")  # a radix sort
        cut = np.searchsorted(of[order], np.arange(lay.n_head + 1))
        order = order[: cut[-1]]  # by class, without the tail
        one, place = one[order], told[order] - lay.first[of[order]]
        logit, total, dwords = np.zeros(len(order), h.dtype), np.ones(len(order), h.dtype), None if grad is None else np.zeros((len(order), w), h.dtype)
        words = np.column_stack([p["words"], p["word_bias"]])
        for k in range(lay.n_head):
            a, b = lay.first[k], lay.first[k + 1]
            if b - a < 2:
                continue
            weight = np.ascontiguousarray(words[a:b].T)
            for lo in range(cut[k], cut[k + 1], ROWS):
                hi = min(lo + ROWS, cut[k + 1])
                x, which, mine = one[lo:hi], place[lo:hi], each[: hi - lo]
                e = x @ weight
                logit[lo:hi] = e[mine, which]
                np.exp(e, out=e)
                total[lo:hi] = sums = e @ ones[: b - a]
                if grad is not None:
                    e *= (1 / sums)[:, None]
                    e[mine, which] -= 1
                    np.matmul(e, p["words"][a:b], out=dwords[lo:hi])
                    g = e.T @ x
                    grad["words"][a:b] += g[:, :w]
                    grad["word_bias"][a:b] += g[:, w]
        logp[order] += logit - np.log(total)
        if grad is not None:
            dh[order] += dwords
        return logp, dh


def summed_rows(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows."""
    order = np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")  # a radix sort
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def _window(net: Network, feed: Feed, place: np.ndarray, active: np.ndarray) -> tuple[list, list, list]:
    """Inputs, starts and outcomes of a window's steps. The input of a step is the token before it, or the start of a document."""
    at = place[place >= 0]
    start = feed.opens[at]
    seen = np.where(start, net.start, feed.ids[np.maximum(at - 1, 0)])
    cut = np.cumsum(active)[:-1]
    return np.split(seen, cut), np.split(start, cut), np.split(feed.ids[at].astype(np.int64), cut)


class Trainer:
    """Adagrad steps, a window each, from given parameters."""

    def __init__(self, layout: Layout, params: dict[str, np.ndarray], rate: float = RATE):
        self.net = Network(layout, {k: v.copy() for k, v in params.items()})
        self.rate = rate
        self.seen = {k: np.full(v.shape if v.ndim == 1 or k == "hidden" or k == "classes" else (len(v), 1), 1e-3, np.float32) for k, v in params.items()}
        self.tokens, self.loss = 0, 0.0

    def step(self, grad: dict, n: int) -> None:
        p = self.net.p
        for k, g in grad.items():
            if k == "inputs":
                rows, g = g
                g = g * np.float32(1 / n)
                self.seen[k][rows] += np.square(g).mean(axis=1, keepdims=True) * n
                p[k][rows] -= self.rate * g * np.float32(n**0.5) / np.sqrt(self.seen[k][rows])
                continue
            g = g * np.float32(1 / n)
            self.seen[k] += (np.square(g) if self.seen[k].shape == g.shape else np.square(g).mean(axis=1, keepdims=True)) * n
            p[k] -= self.rate * g * np.float32(n**0.5) / np.sqrt(self.seen[k])
        np.clip(p["classes"], -4, 4, out=p["classes"])
        np.clip(p["words"], -4, 4, out=p["words"])

    def fit(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n_lanes: int = LANES, steps: int = STEPS) -> None:
        """One pass over sequences ids[start : start + length]."""
        parts = -(-lengths // SEGMENT)
        of = np.repeat(np.arange(len(lengths)), parts)
        into = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        starts, lengths = starts[of] + into, np.minimum(lengths[of] - into, SEGMENT)
        feed, net = Feed(ids, starts, lengths, n_lanes), self.net
        h = np.zeros((len(feed.sizes), net.width), np.float32)
        for place, active in feed.windows(steps):
            seen, opens, told = _window(net, feed, place, active)
            keep: list = []
            states = net.forward(seen, opens, h, keep)
            grad = {k: np.zeros_like(net.p[k]) for k in NAMES if k != "inputs"}
            every = np.concatenate(states)
            logp, dh = net.outputs(every, np.concatenate(told), grad)
            net.backward(keep, np.split(dh, np.cumsum(active)[:-1]), grad)
            self.step(grad, len(every))
            self.tokens += len(every)
            self.loss -= float(logp.sum(dtype=np.float64))
            h = states[-1]


def log_likelihood(net: Network, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n_lanes: int = LANES, steps: int = STEPS) -> np.ndarray:
    """ln P of each sequence as a whole: the state goes on from window to window."""
    feed = Feed(ids, starts, lengths, n_lanes)
    out = np.zeros(len(ids), np.float32)
    h = np.zeros((len(feed.sizes), net.width), np.float32)
    for place, active in feed.windows(steps):
        seen, opens, told = _window(net, feed, place, active)
        states = net.forward(seen, opens, h)
        out[place[place >= 0]] = net.outputs(np.concatenate(states), np.concatenate(told))[0]
        h = states[-1]
    upto = np.append(0, np.cumsum(out, dtype=np.float64))
    return upto[starts + lengths] - upto[starts]
