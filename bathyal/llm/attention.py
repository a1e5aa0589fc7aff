"""A causal self-attention model over subword ids in numpy: forward pass, gradients, local descent.

Each id has rows in four tables: an own vector, a value, a query and a key. At every position of a window the values of all
positions up to it, weighted by softmax(query . key + a bias for each distance), are added to the position's own vector.
The sum predicts the next id by an adaptive softmax: ids are numbered by falling count, the first HEAD compete with one
entry for each further tier, and a tier's ids, GROWTH times as many as those before it, compete among themselves. So the
cost for each position hardly depends on the vocabulary, and the probabilities of all ids still sum to one.
"""

from __future__ import annotations

import numpy as np

WIDTH, KEYS = 16, 4
#: Positions of a window, and how many of them the next window of a text sees again.
WINDOW, OVERLAP = 16, 2
HEAD, GROWTH = 8, 1.4
#: Windows for each step of descent, and its rate.
BATCH, RATE = 1024, 0.25
SLIGHT = 1e-4
_LAG = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
_PAST = _LAG >= 0
_OWN, _VALUE, _QUERY, _KEY = np.split(np.arange(2 * WIDTH + 2 * KEYS), np.cumsum([WIDTH, WIDTH, KEYS]))
_own, _value, _query, _key = (slice(part[0], part[-1] + 1) for part in (_OWN, _VALUE, _QUERY, _KEY))


def tier_ends(size: int) -> np.ndarray:
    """The number of ids up to the end of the head and of each tier."""
    ends = [min(HEAD, size)]
    while ends[-1] < size:
        ends.append(min(size, int(ends[-1] * GROWTH) + 1))
    return np.array(ends)


def _largest(vectors: np.ndarray) -> float:
    """The largest norm of the vectors along the last axis."""
    return float(np.sqrt(np.einsum("...i,...i->...", vectors, vectors).max(initial=0)))


class Attention:
    """A model for as many ids as `shares` has, which holds each id's share of all ids, falling."""

    def __init__(self, shares: np.ndarray):
        size, rng = len(shares), np.random.default_rng(8)
        self.ends = ends = tier_ends(size)
        self.tiers = len(ends) - 1
        self.tier = np.searchsorted(ends, np.arange(size), side="right").astype(np.uint8)
        #: Each id's place in the first softmax: its own or its tier's.
        self.first = np.where(self.tier == 0, np.arange(size), ends[0] + self.tier - 1)
        spans = list(zip(ends[:-1], ends[1:], strict=True))
        mass = [shares[a:b].sum() for a, b in spans]
        table = rng.normal(size=(size, 2 * WIDTH + 2 * KEYS)) * 0.1
        table[:, _own] *= 3
        out = rng.normal(size=(size + self.tiers, WIDTH + 1)) * 0.1
        out[:, WIDTH] = np.log(np.concatenate([shares[: ends[0]], mass, *(shares[a:b] / m for (a, b), m in zip(spans, mass, strict=True))]))
        lag = np.zeros(WINDOW)
        lag[0] = 1.0
        #: table: own vector, value, query and key of each id; out: output vectors and biases; lag: a bias for each distance.
        self.p = {"table": table.astype(np.float32), "out": out.astype(np.float32), "lag": lag.astype(np.float32)}
        self.squares = {k: np.full_like(v, SLIGHT) for k, v in self.p.items()}

    # ---- forward ------------------------------------------------------------------------------------------------------

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Queries, keys, values (with a one behind), weights (not divided by their sums), sums, mixed values (with a one
        behind), and what predicts the next ids: a row for each position of x, with a one behind."""
        n, w = x.shape
        rows = self.p["table"][x.ravel()]
        v = np.ones((n, w, WIDTH + 1), np.float32)
        v[:, :, :WIDTH] = rows[:, _value].reshape(n, w, WIDTH)
        q, k = rows[:, _query].reshape(n, w, KEYS), rows[:, _key].reshape(n, w, KEYS)
        a = q @ k.transpose(0, 2, 1)
        if _largest(q) * _largest(k) > 50:
            np.clip(a, -50, 50, out=a)
        np.exp(a, out=a)
        a *= np.where(_PAST[:w, :w], np.exp(np.clip(self.p["lag"], -25, 25))[np.abs(_LAG[:w, :w])], np.float32(0))
        mixed = a @ v
        total = mixed[:, :, WIDTH:].copy()
        mixed /= total
        h = mixed.reshape(-1, WIDTH + 1).copy()
        h[:, :WIDTH] += rows[:, _own]
        return q, k, v, a, total, mixed, h

    def _by_tier(self, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int, np.ndarray]]]:
        """Positions in use by tier of their target, these targets, and the softmaxes: rows from and to, outputs from and to,
        and each row's target among these."""
        at = np.flatnonzero(use)
        y = y.ravel()[at]
        tier = self.tier[y]
        order = np.argsort(tier, kind="stable")
        at, y = at[order], y[order]
        cuts = np.cumsum(np.bincount(tier, minlength=self.tiers + 1))
        parts = [(0, len(y), 0, self.ends[0] + self.tiers, self.first[y])]
        for i in range(self.tiers):
            a, b = cuts[i], cuts[i + 1]
            if a < b:
                parts.append((a, b, self.tiers + self.ends[i], self.tiers + self.ends[i + 1], y[a:b] - self.ends[i]))
        return at, y, parts

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in use (of x, flat), and the natural logarithm of each one's probability of its target in y."""
        h = self.attend(x)[-1]
        at, y, parts = self._by_tier(y, use.ravel())
        h, out = h[at], np.zeros(len(at), np.float32)
        for a, b, low, high, target in parts:
            z = h[a:b] @ self.p["out"][low:high].T
            out[a:b] += z[np.arange(b - a), target]
            if _largest(h[a:b]) * _largest(self.p["out"][low:high]) > 80 and z.max() > 80:  # beyond the range of exp
                z -= (most := z.max(axis=1, keepdims=True))
                out[a:b] -= most[:, 0]
            np.exp(z, out=z)
            out[a:b] -= np.log(z @ np.ones(high - low, np.float32))
        return at, out

    # ---- descent ------------------------------------------------------------------------------------------------------

    def gradients(self, x: np.ndarray, y: np.ndarray, use: np.ndarray):
        """Yields name, rows and gradient, summed over the targets in use."""
        q, k, v, a, total, mixed, h_all = self.attend(x)
        n, w = x.shape
        at, y, parts = self._by_tier(y, use.ravel())
        h, out = h_all[at], self.p["out"]
        dh, changes = np.zeros((len(at), WIDTH), np.float32), []
        for first, last, low, high, target in parts:
            z = h[first:last] @ out[low:high].T
            if _largest(h[first:last]) * _largest(out[low:high]) > 80:
                np.minimum(z, np.float32(80), out=z)
            np.exp(z, out=z)
            total_z = z @ np.ones(high - low, np.float32)
            z[np.arange(last - first), target] -= total_z  # times the inverse sum, this is the probability less one
            inverse = (1 / total_z)[:, None]
            dh[first:last] += (z @ out[low:high, :WIDTH]) * inverse
            changes.append(("out", slice(low, high), z.T @ (h[first:last] * inverse)))
        full = np.zeros((n * w, WIDTH), np.float32)
        full[at] = dh
        d = full.reshape(n, w, WIDTH)
        u = np.empty((n, w, WIDTH + 1), np.float32)
        u[:, :, :WIDTH] = d
        u[:, :, WIDTH] = -np.einsum("bij,bij->bi", d, mixed[:, :, :WIDTH])
        u /= total
        ds = u @ v.transpose(0, 2, 1)
        ds *= a
        rows = np.empty((n * w, self.p["table"].shape[1]), np.float32)
        rows[:, _own] = full
        rows[:, _value] = (a.transpose(0, 2, 1) @ u)[:, :, :WIDTH].reshape(-1, WIDTH)
        rows[:, _query] = (ds @ k).reshape(-1, KEYS)
        rows[:, _key] = (ds.transpose(0, 2, 1) @ q).reshape(-1, KEYS)
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        yield "table", ids[starts], np.add.reduceat(rows[order], starts, axis=0)
        yield from changes
        past = _PAST[:w, :w]
        lag = np.bincount(_LAG[:w, :w][past], ds.sum(axis=0)[past], WINDOW)
        yield "lag", slice(None), lag.astype(np.float32)

    def step(self, x: np.ndarray, y: np.ndarray, use: np.ndarray) -> None:
        """One step of descent; each parameter's rate falls with the squares of its gradients so far."""
        for name, at, g in list(self.gradients(x, y, use)):
            squares = g * g
            squares += self.squares[name][at]
            self.squares[name][at] = squares
            g /= np.sqrt(squares, out=squares)
            g *= np.float32(RATE)
            self.p[name][at] -= g

    # ---- exchange -----------------------------------------------------------------------------------------------------

    def flat(self) -> np.ndarray:
        """All parameters and the sums of their squared gradients."""
        return np.concatenate([part[k].ravel() for part in (self.p, self.squares) for k in sorted(part)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for part in (self.p, self.squares):
            for k in sorted(part):
                part[k] = flat[at : at + part[k].size].reshape(part[k].shape).astype(np.float32)
                at += part[k].size


def windows(bounds: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First position of each window, the end of its text, and whether the window is its text's first; text i holds positions
    bounds[i] to bounds[i + 1], one at least.

    A text of n ids needs one window, and one more for each further stride.
    """
    lengths = np.diff(bounds)
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(bounds[:-1], n) + place * stride, np.repeat(bounds[1:], n), place == 0


def window_ids(y: np.ndarray, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Inputs and targets of some windows, which of these are a text's own, and their positions."""
    at = start[:, None] + np.arange(WINDOW)
    use = at < end[:, None]
    at = np.minimum(at, len(y) - 1)
    return x[at], y[at], use, at
