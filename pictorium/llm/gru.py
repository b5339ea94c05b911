"""A gated recurrent unit with a class-factored softmax, in numpy.

A token is predicted from the state before it: ``P(w | h) = P(class | h) * P(w | class, h)``, so a
prediction costs ``classes + members`` products instead of their product.  Token t of
class c and member s has the id ``c * members + s``."""

from __future__ import annotations

import heapq

import numpy as np

WINDOW = 32


def start_parameters(counts: np.ndarray, classes: int, members: int, state: int, inputs: int, seed: int = 11) -> dict[str, np.ndarray]:
    """Small random weights; the biases reproduce the token frequencies."""
    rng = np.random.default_rng(seed)
    c = counts.reshape(classes, members).astype(float) + 0.01
    f4 = np.float32

    def rand(*shape):
        return (rng.normal(size=shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(f4)

    return {
        "embed": (0.3 * rng.normal(size=(classes * members, inputs))).astype(f4),
        "w_in": rand(inputs, 3 * state),
        "b_in": np.zeros(3 * state, f4),
        "w_state": rand(state, 3 * state),
        "w_class": np.zeros((classes, state), f4),
        "b_class": np.log(c.sum(1) / c.sum()).astype(f4),
        "w_member": np.zeros((classes, members, state), f4),
        "b_member": np.log(c / c.sum(1, keepdims=True)).astype(f4),
    }


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def restore(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def lay_out(documents: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another in at most ``lanes`` lanes of nearly equal length: ids and
    document numbers (-1 where a lane has ended), both (time, lane), longest lane first.

    A lane is as long as the longest document at least, so few documents take few lanes."""
    sizes = [len(d) for d in documents]
    longest = max(sizes, default=0)
    lanes = max(1, min(lanes, -(-sum(sizes) // max(longest, 1))))
    heap, own = [(0, lane) for lane in range(lanes)], [[] for _ in range(lanes)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        filled, lane = heap[0]
        own[lane].append(i)
        heapq.heapreplace(heap, (filled + sizes[i], lane))
    lengths = {lane: filled for filled, lane in heap}
    order = sorted(range(lanes), key=lambda lane: -lengths[lane])
    ids = np.zeros((lanes, max(lengths.values())), np.int32)
    owner = np.full(ids.shape, -1, np.int32)
    for k, lane in enumerate(order):
        if own[lane]:
            n = lengths[lane]
            ids[k, :n] = np.concatenate([documents[i] for i in own[lane]])
            owner[k, :n] = np.repeat(own[lane], [sizes[i] for i in own[lane]])
    return np.ascontiguousarray(ids.T), np.ascontiguousarray(owner.T)


def first_tokens(owner: np.ndarray) -> np.ndarray:
    """Where a document begins in its lane."""
    begins = np.ones(owner.shape, bool)
    begins[1:] = owner[1:] != owner[:-1]
    return begins


class Gru:
    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters
        self.state = parameters["w_state"].shape[0]
        self.classes, self.members, _ = parameters["w_member"].shape
        self.tame = self.is_tame()

    def is_tame(self) -> bool:
        """States lie in [-1, 1], so logits have a bound; below it exp needs no shift."""
        bound = [np.abs(self.p[f"w_{k}"]).sum(-1) + np.abs(self.p[f"b_{k}"]) for k in ("class", "member")]
        return bool(max(b.max() for b in bound) < 60)

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Output weights of classes and members with their biases as last column."""
        return tuple(np.concatenate([self.p[f"w_{k}"], self.p[f"b_{k}"][..., None]], axis=-1) for k in ("class", "member"))

    def steps(self, ids: np.ndarray, h: np.ndarray, keep: bool = False, begins: np.ndarray | None = None):
        """Runs ``ids`` (time, lanes) from states ``h`` (lanes, state): the states before every token (time, state, lanes), the last
        states, and with ``keep`` what the backward pass needs.  Where a document ``begins`` the state is zero.

        Inside, lanes are the last axis, so each gate of a step is one run of memory."""
        d = self.state
        x = self.p["w_in"].T @ self.p["embed"][ids].transpose(0, 2, 1)
        x += self.p["b_in"][:, None]
        h = np.ascontiguousarray(h.T)
        before = np.empty((len(ids), *h.shape), x.dtype)
        cache = (np.empty_like(x[:, : 2 * d]), np.empty_like(before), np.empty_like(before)) if keep else None
        fresh = begins.any(1) if begins is not None else np.zeros(len(ids), bool)
        w = np.ascontiguousarray(self.p["w_state"].T)
        for t in range(len(ids)):
            if fresh[t]:
                h = np.where(begins[t], x.dtype.type(0), h)
            before[t] = h
            a = w @ h
            gates = np.add(x[t, : 2 * d], a[: 2 * d], out=cache[0][t] if keep else None)
            _sigmoid(gates)
            n = gates[d:] * a[2 * d :]
            n += x[t, 2 * d :]
            np.tanh(n, out=n)
            if keep:
                cache[1][t] = n
                cache[2][t] = a[2 * d :]
            h = h - n
            h *= gates[:d]
            h += n
        return before, h.T, cache

    def log_probabilities(self, h: np.ndarray, ids: np.ndarray, chunk: int = 8192) -> np.ndarray:
        """Natural logarithm of P(id | h) for rows of states and ids."""
        by_class, by_member = self.outputs()
        order = _sorted(ids, self.classes * self.members)
        h, ids = _with_one(h[order]), ids[order]
        cls, member = ids // self.members, ids % self.members
        part = np.empty(len(ids))
        for at in range(0, len(ids), chunk):
            here = slice(at, at + chunk)
            own, rows = h[here], np.arange(len(h[here]))
            outer, inner = own @ by_class.T, _by_run(own, by_member, list(_runs(cls[here])))
            picked = outer[rows, cls[here]] + inner[rows, member[here]]
            part[here] = picked - _log_sum(outer, self.tame) - _log_sum(inner, self.tame)
        out = np.empty(len(ids))
        out[order] = part
        return out

    def score(self, documents: list[np.ndarray], window: int = 64, lanes: int = 512) -> np.ndarray:
        """Log-likelihood of whole documents: the state is carried from window to
        window; in a lane the next document begins with a fresh one."""
        total = np.zeros(len(documents))
        ids, owner = lay_out(documents, lanes)
        begins, sizes = first_tokens(owner), (owner >= 0).sum(0)
        h = np.zeros((ids.shape[1], self.state), np.float32)
        for at in range(0, len(ids), window):
            live = int((sizes > at).sum())
            here = (slice(at, at + window), slice(0, live))
            before, h, _ = self.steps(ids[here], h[:live], begins=begins[here])
            own = owner[here].ravel()
            rows = np.flatnonzero(own >= 0)
            logs = self.log_probabilities(_by_token(before)[rows], ids[here].ravel()[rows])
            total += np.bincount(own[rows], weights=logs, minlength=len(total))
        return total


class Trainer:
    """Truncated backpropagation through time with AdaGrad steps."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float = 0.1):
        self.net, self.rate = Gru({k: v.copy() for k, v in parameters.items()}), rate
        self.seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in parameters.items()}
        self.tokens = 0

    def _step(self, name: str, g: np.ndarray, at=slice(None)) -> None:
        acc = self.seen[name]
        acc[at] += g * g
        self.net.p[name][at] -= self.rate * g / np.sqrt(acc[at])

    def train(self, documents: list[np.ndarray], stride: int, phase: int, lanes: int = 128, window: int = WINDOW) -> None:
        """Carries the state through whole documents, and learns from every
        ``stride``-th window (gradients end at its borders and where a document begins)."""
        ids, owner = lay_out(documents, lanes)
        begins, sizes = first_tokens(owner), (owner >= 0).sum(0)
        h = np.zeros((ids.shape[1], self.net.state), np.float32)
        for k, at in enumerate(range(0, len(ids), window)):
            live = int((sizes > at).sum())
            here = (slice(at, at + window), slice(0, live))
            if (k + phase) % stride:
                _, h, _ = self.net.steps(ids[here], h[:live], begins=begins[here])
            else:
                h = self._learn(ids[here], owner[here] >= 0, h[:live], begins[here])

    def _learn(self, ids: np.ndarray, mask: np.ndarray, h: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
        net, p, d = self.net, self.net.p, self.net.state
        before, last, (gates, n, a) = net.steps(ids, h, keep=True, begins=begins)
        rows = np.flatnonzero(mask.ravel())
        self.tokens += len(rows)
        net.tame = net.is_tame()
        d_before = np.zeros((ids.size, d), before.dtype)
        d_before[rows] = self._output(_by_token(before)[rows], ids.ravel()[rows], 1.0 / len(rows))
        d_before = np.ascontiguousarray(d_before.reshape(*ids.shape, d).transpose(0, 2, 1))
        # what the gradient of a state is multiplied by, for all steps at once: update gate, reset gate, new state
        z, r = gates[:, :d], gates[:, d:]
        by_x = np.empty((len(ids), 3, *before.shape[1:]), before.dtype)
        by_n = np.multiply(1 - z, 1 - n * n, out=by_x[:, 2])
        np.multiply((before - n) * z, 1 - z, out=by_x[:, 0])
        np.multiply(a * r * (1 - r), by_n, out=by_x[:, 1])
        da = by_x.copy()
        da[:, 2] *= r
        dh, every = np.zeros_like(before[0]), np.empty_like(before)
        fresh = begins.any(1) if begins is not None else np.zeros(len(ids), bool)
        for t in range(len(ids) - 1, -1, -1):
            every[t] = dh
            da[t] *= dh
            dh *= z[t]
            dh += p["w_state"] @ da[t].reshape(3 * d, -1)
            dh += d_before[t]
            if fresh[t]:
                dh[:, begins[t]] = 0
        by_x *= every[:, None]
        flat_ids, flat_dx = ids.ravel(), _by_token(by_x.reshape(len(ids), 3 * d, -1))
        g_state = (before @ da.reshape(len(ids), 3 * d, -1).transpose(0, 2, 1)).sum(0)
        # summed by token first: an embedding meets the input weights once
        order = _sorted(flat_ids, net.classes * net.members)
        ordered = flat_ids[order]
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        token, sums = ordered[first], np.add.reduceat(flat_dx[order], first, axis=0)
        g_in = p["embed"][token].T @ sums
        d_embed = np.zeros_like(p["embed"])
        d_embed[token] = sums @ p["w_in"].T
        self._step("embed", d_embed)
        self._step("w_in", g_in)
        self._step("b_in", sums.sum(0))
        self._step("w_state", g_state)
        return last

    def _output(self, h: np.ndarray, ids: np.ndarray, scale: float) -> np.ndarray:
        """Gradient of the mean loss with respect to the states; steps the output weights."""
        m, tame, d = self.net.members, self.net.tame, self.net.state
        by_class, by_member = self.net.outputs()
        order = _sorted(ids, self.net.classes * m)  # by class, and in it by member
        h, ids = _with_one(h[order]), ids[order]
        cls, member = ids // m, ids % m
        runs = list(_runs(cls))
        g = _soft_error(h @ by_class.T, cls, scale, tame)
        dh = g @ by_class[:, :d]
        g_class = g.T @ h
        g = _soft_error(_by_run(h, by_member, runs), member, scale, tame)
        g_member = np.zeros_like(by_member)
        for c, a, b in runs:
            dh[a:b] += g[a:b] @ by_member[c, :, :d]
            np.matmul(g[a:b].T, h[a:b], out=g_member[c])
        self._step("w_class", g_class[:, :d])
        self._step("b_class", g_class[:, d])
        self._step("w_member", g_member[..., :d])
        self._step("b_member", g_member[..., d])
        out = np.empty_like(dh)
        out[order] = dh
        return out


def _by_token(x: np.ndarray) -> np.ndarray:
    """A row per token of (time, numbers, lanes), in the order of ids (time, lanes)."""
    return x.transpose(0, 2, 1).reshape(-1, x.shape[1])


def _with_one(h: np.ndarray) -> np.ndarray:
    """A last column of ones, which biases are multiplied by."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _by_run(h: np.ndarray, weights: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Products of the rows of every run with the weights of its class."""
    out = np.empty((len(h), weights.shape[1]), h.dtype)
    for c, a, b in runs:
        np.matmul(h[a:b], weights[c].T, out=out[a:b])
    return out


def _log_sum(x: np.ndarray, tame: bool) -> np.ndarray:
    """Logarithm of the sum of exp over the rows; overwrites ``x``."""
    top = None if tame else x.max(1)
    if top is not None:
        x -= top[:, None]
    total = np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))
    return total if top is None else total + top


def _soft_error(logits: np.ndarray, target: np.ndarray, scale: float, tame: bool) -> np.ndarray:
    """Softmax minus the one-hot target, times ``scale``; in place."""
    if not tame:
        logits -= logits.max(1, keepdims=True)
    e = np.exp(logits, out=logits)
    e *= (scale / (e @ np.ones(e.shape[1], e.dtype)))[:, None]
    e[np.arange(len(target)), target] -= scale
    return e


def _sorted(ids: np.ndarray, below: int) -> np.ndarray:
    """Order of the ids; 16-bit numbers are sorted in linear time."""
    return np.argsort(ids.astype(np.int16) if below <= 32768 else ids, kind="stable")


def _runs(values: np.ndarray):
    """(value, first, past last) of every run of sorted values."""
    first = np.flatnonzero(np.diff(values, prepend=-1))
    return zip(values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)])
