"""A gated recurrent language model in numpy with a class-factored output softmax."""

from __future__ import annotations

import numpy as np

HIDDEN, CLASS_WORDS = 16, 48
#: Steps of a truncated window in training, sequences that train together, and the step size.
WINDOW, STREAMS, RATE = 16, 256, 0.1
#: A longer text is trained on in pieces of so many ids, each after the id before it, so that no stream outlasts the others by far.
PIECE = 512
#: Hidden states that are held before their outputs are scored.
SCORE_ROWS = 1 << 15
#: Rows whose outputs are scored together; their logits stay in a core's cache.
BLOCK = 1024


def _sums(rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of runs of rows that begin at ``begins``; a run of one row, as most are, costs no call."""
    out = rows[begins]
    ends = np.append(begins[1:], len(rows))
    long = np.flatnonzero(ends - begins > 1)
    if len(long):
        cuts = np.stack([begins[long], ends[long]], 1).ravel()
        out[long] = np.add.reduceat(rows, cuts[:-1] if cuts[-1] == len(rows) else cuts, axis=0)[::2]
    return out


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.append(0, np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1)


def _softmax(x: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log p of each row's ``spot``; exp of the rows and its sums, whose quotient is p. Spoils x."""
    picked = x.take(np.arange(0, x.size, x.shape[1]) + spot)
    ones = np.ones(x.shape[1], x.dtype)
    e = np.exp(x)
    total = e @ ones
    if len(x) and not (total.min() > 1e-30 and total.max() < 1e30):  # too far from 1 to go without the maximum
        top = x.max(1, keepdims=True)
        x -= top
        picked = picked - top[:, 0]
        e = np.exp(x)
        total = e @ ones
    return picked - np.log(total), e, total


def _slope(e: np.ndarray, total: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Gradient of -log p by the logits, from what _softmax returns; spoils e."""
    e /= total[:, None]
    e[np.arange(len(e)), spot] -= 1
    return e


class GatedModel:
    """Ids 0 .. n-1; an id's class is id // CLASS_WORDS, so ids ordered by frequency share classes.

    log p(id | h) = log p(class | h) + log p(id | class, h). Biases, the last rows of "class" and "word", start at the given counts, so that
    the untrained model is the unigram model of all that was counted.
    """

    def __init__(self, counts: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        n, h = len(counts), HIDDEN
        classes = -(-n // CLASS_WORDS)
        share = np.zeros(classes * CLASS_WORDS)
        share[:n] = counts + 1.0
        share = share.reshape(classes, CLASS_WORDS)
        self.weights = {
            "input": rng.normal(0, 0.1, (n, 3 * h)),
            "state": rng.normal(0, 0.3, (h, 3 * h)),
            "class": np.vstack([rng.normal(0, 0.05, (h, classes)), np.log(share.sum(1) / share.sum())]),
            "word": np.concatenate([rng.normal(0, 0.05, (classes, h, CLASS_WORDS)), np.log(np.maximum(share, 1e-30) / share.sum(1, keepdims=True))[:, None]], 1),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        self.start = 1  # the end of a text is also what comes before its first word

    def packed(self) -> bytes:
        return b"".join(self.weights[k].tobytes() for k in sorted(self.weights))

    def unpack(self, data: bytes) -> GatedModel:
        at = 0
        for k in sorted(self.weights):
            old = self.weights[k]
            self.weights[k] = np.frombuffer(data, np.float32, old.size, at).reshape(old.shape).copy()
            at += old.nbytes
        return self

    def output(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log p of each id after its state, to which a one is joined; with ``grads`` also the loss gradient by the states."""
        w, kind = self.weights, ids // CLASS_WORDS
        order = np.argsort(kind.astype(np.int16), kind="stable")
        kind, h = kind.take(order), h.take(order, axis=0)
        spot = ids.take(order) - kind * CLASS_WORDS
        found = np.empty(len(ids), np.float32)
        slope = None if grads is None else np.empty((len(ids), HIDDEN), np.float32)
        if grads is not None:
            grads |= {name: np.zeros_like(w[name]) for name in ("class", "word")}
        for at in range(0, len(ids), BLOCK):  # rows of many classes: one softmax over all, only the products by class
            own = slice(at, at + BLOCK)
            part, rows = kind[own], h[own]
            outer, d, total = _softmax(rows @ w["class"], part)
            if grads is not None:
                d = _slope(d, total, part)
                back = np.matmul(d, w["class"][:-1].T, out=slope[own])
                grads["class"] += rows.T @ d
            cuts = _runs(part).tolist()
            runs = list(zip(part[cuts].tolist(), cuts, [*cuts[1:], len(part)]))
            logits = np.empty((len(part), CLASS_WORDS), np.float32)
            for c, a, b in runs:
                np.matmul(rows[a:b], w["word"][c], out=logits[a:b])
            inner, d, total = _softmax(logits, spot[own])
            np.add(outer, inner, out=found[own])
            if grads is not None:
                d = _slope(d, total, spot[own])
                for c, a, b in runs:
                    back[a:b] += d[a:b] @ w["word"][c, :-1].T
                    grads["word"][c] += rows[a:b].T @ d[a:b]
        out = np.empty_like(found)
        out[order] = found
        if grads is None:
            return out, None
        back = np.empty_like(slope)
        back[order] = slope
        return out, back

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each whole sequence of ids; the state runs through all windows."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        total = np.zeros(len(texts))
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        steps = int(sizes[0]) if len(sizes) else 0
        live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
        offset = np.concatenate([[0], np.cumsum(live)]).astype(np.int64)
        flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
        rank = np.empty(len(texts), np.int32)
        rank[order] = np.arange(len(texts))
        begins = np.cumsum(lengths) - lengths
        at = np.arange(len(flat), dtype=np.int32)
        at -= np.repeat(begins.astype(np.int32), lengths)
        at = offset.astype(np.int32).take(at)
        at += np.repeat(rank, lengths)
        ids, source = np.empty((2, len(flat)), np.int32)  # in the order of steps: what comes, and what came before it
        ids[at] = flat
        source[at[1:]] = flat[:-1]
        source[at[begins[lengths > 0]]] = self.start
        del at, flat
        n, bounds = HIDDEN, offset.tolist()
        gate_input, gate_state = (-self.weights[k][:, : 2 * n] for k in ("input", "state"))
        new_input, new_state = (np.ascontiguousarray(self.weights[k][:, 2 * n :]) for k in ("input", "state"))
        h, t = np.zeros((len(texts), n), np.float32), 0
        with np.errstate(over="ignore"):
            while t < steps:
                first, until = t, max(t + 1, int(np.searchsorted(offset, bounds[t] + SCORE_ROWS, side="right")) - 1)
                begun, done = bounds[t], bounds[until]
                gates, cand = (part.take(source[begun:done], axis=0) for part in (gate_input, new_input))
                states = np.ones((done - begun, n + 1), np.float32)
                for t in range(first, until):
                    a, b = bounds[t] - begun, bounds[t + 1] - begun
                    h, x, y = h[: b - a], gates[a:b], cand[a:b]
                    x += h @ gate_state
                    np.exp(x, out=x)
                    x += 1
                    np.reciprocal(x, out=x)
                    q = h @ new_state
                    q *= x[:, n:]
                    y += q
                    np.tanh(y, out=y)
                    h = h - y
                    h *= x[:, :n]
                    h += y
                    states[a:b, :n] = h
                t = until
                found, _ = self.output(states, ids[begun:done])
                who = np.arange(begun, done) - np.repeat(offset[first:until], live[first:until])
                total[: live[first]] += np.bincount(who, found, live[first])
        return total[rank]

    def train(self, texts: list[np.ndarray]) -> int:
        """One pass of truncated backpropagation over whole sequences, steps by AdaGrad; tokens seen."""
        pieces = [(text[a : a + PIECE], text[a - 1] if a else self.start) for text in texts for a in range(0, len(text), PIECE)]
        streams: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(STREAMS)]
        load = [0] * STREAMS
        for piece in sorted(pieces, key=lambda p: len(p[0]), reverse=True):
            k = load.index(min(load))
            streams[k].append(piece)
            load[k] += len(piece[0])
        steps = max(load)
        ids = np.full((steps, STREAMS), -1, np.int64)
        fresh = np.full((steps, STREAMS), -1, np.int64)
        for k, own in enumerate(streams):
            if own:
                ids[: load[k], k] = np.concatenate([p for p, _ in own])
                fresh[np.cumsum([0, *(len(p) for p, _ in own[:-1])]), k] = [before for _, before in own]
        new = fresh >= 0
        source = np.where(new, fresh, np.vstack([np.full((1, STREAMS), self.start), ids[:-1]]))
        source = np.maximum(source, 0)  # beyond the end of a stream, where nothing is learnt
        sums = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.weights.items()}
        h = np.zeros((HIDDEN, STREAMS), np.float32)
        with np.errstate(over="ignore"):
            for t in range(0, steps, WINDOW):
                own = slice(t, t + WINDOW)
                h = self._window(ids[own], source[own], new[own], h, sums)
        return sum(load)

    def _window(self, ids, source, new, h, sums):
        n, w = HIDDEN, self.weights  # here states and gates have a row a unit and a column a stream, so that gates are whole blocks
        steps, streams = ids.shape
        resets, zero = new.any(1).tolist(), np.float32(0)
        turned = w["state"].T.copy()
        turned[: 2 * n] *= -1
        held = np.ascontiguousarray(w["input"].take(source.ravel(), axis=0).reshape(steps, streams, 3 * n).transpose(0, 2, 1))
        gates, cand = held[:, : 2 * n], held[:, 2 * n :]
        np.negative(gates, out=gates)
        q, before, states = np.empty_like(held), np.empty_like(cand), np.empty((steps, n, streams), np.float32)
        for t in range(steps):
            if resets[t]:
                h = np.where(new[t], zero, h)
            before[t] = h
            np.matmul(turned, h, out=q[t])
            x, y = gates[t], cand[t]
            x += q[t, : 2 * n]
            np.exp(x, out=x)
            x += 1
            np.reciprocal(x, out=x)
            y += x[n:] * q[t, 2 * n :]
            np.tanh(y, out=y)
            h = h - y
            h *= x[:n]
            h += y
            states[t] = h
        target = ids.ravel()
        live = np.flatnonzero(target >= 0)
        rows = np.ones((steps, streams, n + 1), np.float32)
        rows[:, :, :n] = states.transpose(0, 2, 1)
        rows, grads = rows.reshape(-1, n + 1), {}
        if len(live) == len(target):
            _, back = self.output(rows, target, grads)
        else:
            back = np.zeros((len(target), n), np.float32)
            back[live] = self.output(rows[live], target[live], grads)[1]
        d = np.ascontiguousarray(back.reshape(steps, streams, n).transpose(0, 2, 1))
        # what a state's gradient is multiplied with on its way to the three inputs; all but the sums over time is done for the whole window
        z, r, left = gates[:, :n], gates[:, n:], 1 - gates
        slope = np.empty((steps, 3, n, streams), np.float32)
        np.multiply(before - cand, z, out=slope[:, 0])
        slope[:, 0] *= left[:, :n]
        np.multiply(cand, cand, out=slope[:, 2])
        np.subtract(1, slope[:, 2], out=slope[:, 2])
        slope[:, 2] *= left[:, :n]
        np.multiply(slope[:, 2], q[:, 2 * n :], out=slope[:, 1])
        slope[:, 1] *= r
        slope[:, 1] *= left[:, n:]
        inner = slope.copy()
        inner[:, 2] *= r
        d_h = None
        for t in range(steps - 1, -1, -1):
            if d_h is not None:
                d[t] += d_h
            inner[t] *= d[t]
            d_h = w["state"] @ inner[t].reshape(3 * n, streams)
            d_h += d[t] * z[t]
            if resets[t]:
                d_h = np.where(new[t], zero, d_h)
        slope *= d[:, None]
        grads["state"] = np.matmul(before, inner.reshape(steps, 3 * n, streams).transpose(0, 2, 1)).sum(0)
        source = source.ravel()
        order = np.argsort(source.astype(np.uint16), kind="stable")
        source = source.take(order)
        begins = _runs(source)
        by_source = _sums(np.ascontiguousarray(slope.reshape(steps, 3 * n, streams).transpose(0, 2, 1)).reshape(-1, 3 * n).take(order, axis=0), begins)
        count = max(1, len(live)) / streams

        def move(name, at, grad):
            grad = np.clip(grad / count, -1, 1)
            total = sums[name][at] + grad * grad
            sums[name][at] = total
            grad *= RATE
            w[name][at] -= grad / np.sqrt(total)

        move("input", source[begins], by_source)
        for name in ("state", "class", "word"):
            move(name, slice(None), grads[name])
        return h
