"""Near texts of two groups, compared inside a task: cheap lossless bounds, then exact counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def near_texts(threshold: int, every: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of two groups (``a, key, name`` and ``b``) for a cogroup.

    With ``every`` it returns all similar pairs as ``a, key, b, name, indel``, else the ``a, key``
    that have one. A pair passes three bounds before its common subsequence is counted: each
    insertion or deletion changes the counts of characters by one and those of neighbouring
    characters (by hash) by three at most. The helpers are nested so that they travel with it.
    """
    known, pairs_of, buckets = 29, 64, 1024
    at_once, exact_at_once = 1 << 16, 1 << 17

    def allowed(total: np.ndarray) -> np.ndarray:
        doubled = total * (2 * (100 - threshold) + 1)
        return doubled // 200 if threshold % 2 == 0 else -(-doubled // 200) - 1

    class Texts:
        def __init__(self, texts: list[str]):
            size = np.array([len(t) for t in texts], dtype=np.int64)
            order = np.argsort(size, kind="stable")
            self.row, self.size = order, size[order]
            self.texts = [texts[i] for i in order]
            self.flat = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"),
                                      dtype=np.uint32)
            self.start = np.concatenate([[0], np.cumsum(self.size)])
            low = np.arange(128)
            kind = np.where((low >= 97) & (low < 123), low - 97, 37 + low % 27)
            kind[32] = 26
            kind[48:58] = np.arange(27, 37)
            code = np.where(self.flat < 128, kind[np.minimum(self.flat, 127)],
                            37 + self.flat.astype(np.int64) % 27)
            n = len(texts)
            self.one = np.empty((n, pairs_of), dtype=np.uint8)
            self.two = np.empty((n, buckets), dtype=np.uint8)
            self.sign = np.zeros((n, 4), dtype=np.uint64)
            for i in range(0, n, 512):
                j = min(i + 512, n)
                part = code[self.start[i]:self.start[j]]
                owner = np.repeat(np.arange(j - i), self.size[i:j])
                count = np.bincount(owner * pairs_of + part, minlength=(j - i) * pairs_of)
                count = count.reshape(j - i, pairs_of)
                self.one[i:j] = np.minimum(count, 255)
                beside = owner[1:] == owner[:-1]
                hashed = ((part[:-1] * pairs_of + part[1:]) * 2654435761 >> 12) % buckets
                both = np.bincount((owner[1:] * buckets + hashed)[beside],
                                   minlength=(j - i) * buckets)
                self.two[i:j] = np.minimum(both, 255).reshape(j - i, buckets)
                coarse = np.column_stack([count[:, :27], count[:, 27:37].sum(axis=1),
                                          count[:, 37:].sum(axis=1)])
                for c in range(known):              # eight thermometer bits a character
                    bits = (np.uint64(1) << np.minimum(coarse[:, c], 8).astype(np.uint64)) - np.uint64(1)
                    self.sign[i:j, c // 8] |= bits << np.uint64(8 * (c % 8))

    def gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)

    def passing(left: Texts, right: Texts):
        """Pairs of places that pass the bounds, and their distance by neighbours."""
        slack = (100 - threshold + 0.5) / 100
        ratio = (1 - slack) / (1 + slack)
        low, i = right.sign.T.copy(), 0
        widths = (left.size * np.float32(slack) + 1).astype(np.float32)
        heights = (right.size * np.float32(slack) + 1).astype(np.float32)
        while i < len(left.size):
            first = np.searchsorted(right.size, left.size[i] * ratio - 1e-6)
            last = np.searchsorted(right.size, left.size[i] / ratio + 1e-6, "right")
            j = min(i + max(1, at_once // max(last - first, 1)), len(left.size))
            last = np.searchsorted(right.size, left.size[j - 1] / ratio + 1e-6, "right")
            step = max(1, at_once // (j - i))
            for f in range(first, last, step):
                t = min(f + step, last)
                differing = np.zeros((j - i, t - f), dtype=np.uint8)
                for w in range(4):
                    differing += np.bitwise_count(left.sign[i:j, w, None] ^ low[w, None, f:t])
                x, y = np.nonzero(differing <= widths[i:j, None] + heights[None, f:t])
                x, y = x + i, y + f
                for s in range(0, len(x), 4096):
                    u, v = x[s:s + 4096], y[s:s + 4096]
                    limit = allowed(left.size[u] + right.size[v])
                    ok = np.abs(left.size[u] - right.size[v]) <= limit
                    u, v, limit = u[ok], v[ok], limit[ok]
                    ok = gap(left.one[u], right.one[v]) <= limit
                    u, v, limit = u[ok], v[ok], limit[ok]
                    far = gap(left.two[u], right.two[v])
                    ok = far <= 3 * limit
                    yield u[ok], v[ok], far[ok]
            i = j

    def edges_of(j: int, width: int, end: int) -> list[int]:
        """Places in the left text near place ``j`` of the right, where an alignment may be."""
        low, high = max(j - width, 0), min(j + width, end)
        return [*range(low, high, max(16, width // 4)), max(high, low)]

    def one_by_one(x: str, y: str, limit: int) -> int:
        """Indel distance, or more than ``limit``.

        Now and then the common length so far, of each place an alignment within the limit
        can have reached, and what may follow are compared with what is needed.
        """
        masks: dict[str, int] = {}
        for i, ch in enumerate(x):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row, need = full, (len(x) + len(y) - limit + 1) // 2
        width = (limit + abs(len(x) - len(y))) // 2 + 1
        step = max(64, width // 2)
        for j, ch in enumerate(y):
            hit = row & masks.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
            if j % step == step - 1:
                edges = edges_of(j + 1, width, len(x))
                if all(q - (row & ((1 << q) - 1)).bit_count() + min(len(x) - p, len(y) - j - 1)
                       < need for p, q in zip([edges[0], *edges], edges)):
                    return limit + 1
        return len(x) + len(y) - 2 * (len(x) - row.bit_count())

    def side_by_side(left: Texts, right: Texts, u: np.ndarray, v: np.ndarray, words: int,
                     codes: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        """Common length of many pairs whose left texts have up to ``64 * words`` characters.

        Pairs that cannot get near any more are left out on the way, as in ``one_by_one``; 0
        stands for their common length.
        """
        own, place = np.unique(u, return_inverse=True)
        size = left.size[own]
        owner = np.repeat(np.arange(len(own)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        chars = codes[0][np.repeat(left.start[own], size) + at]
        masks = np.zeros((len(own) * codes[2], words), dtype=np.uint64)
        np.add.at(masks, (owner * codes[2] + chars, at // 64),
                  np.uint64(1) << (at % 64).astype(np.uint64))
        longest = int(right.size[v].max())
        steps = np.arange(longest)
        inside = steps[None, :] < right.size[v][:, None]
        text = np.where(inside, codes[1][np.minimum(right.start[v][:, None] + steps[None, :],
                                                    len(codes[1]) - 1)], 0)
        text = (text + (place * codes[2])[:, None]).T.copy()
        rows = [np.full(len(u), ~np.uint64(0)) for _ in range(words)]
        common, live = np.zeros(len(u), dtype=np.int64), np.arange(len(u))
        x, y = left.size[u], right.size[v]
        limit = allowed(x + y)
        need, width = (x + y - limit + 1) // 2, int(((limit + np.abs(x - y)) // 2).max()) + 1

        def so_far(place: int) -> np.ndarray:
            """Common length of the first ``place`` characters of the left text."""
            count = np.zeros(len(live), dtype=np.int64)
            for w in range(min(words, (place + 63) // 64)):
                bits = min(place - 64 * w, 64)
                count += bits - np.bitwise_count(
                    rows[w] & np.uint64((1 << bits) - 1)).astype(np.int64)
            return count

        for j in range(longest):
            mask = masks[text[j]]
            carry = None
            for w in range(words):
                row = rows[w]
                hit = row & mask[:, w]
                total = row + hit
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
                rows[w] = total | (row & ~hit)
            if j % 32 == 31:
                edges = edges_of(j + 1, width, 64 * words)
                ahead = np.maximum(y[live] - j - 1, 0)
                # A right text that has ended is done.
                near, before = ahead == 0, edges[0]
                for q in edges:
                    near |= so_far(q) + np.minimum(
                        np.maximum(x[live] - before, 0), ahead) >= need[live]
                    before = q
                if near.sum() < 0.8 * len(near):
                    live, text = live[near], text[:, near]
                    rows = [row[near] for row in rows]
                    if not len(live):
                        break
        common[live] = so_far(64 * words)
        return common

    def indel_of(left: Texts, right: Texts, u: np.ndarray, v: np.ndarray,
                 codes: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        """Indel distance of pairs, or more than what is allowed."""
        total = left.size[u] + right.size[v]
        out, limit = np.zeros(len(u), dtype=np.int64), allowed(total)
        words = np.maximum((left.size[u] + 63) // 64, 1)
        order = np.lexsort((right.size[v], words))
        edges = np.flatnonzero(np.diff(words[order], prepend=-1, append=-1))
        for f, t in zip(edges[:-1], edges[1:], strict=True):
            w, some = int(words[order[f]]), order[f:t]
            many = max(4096 // w, 1)
            for s in range(0, len(some), many):
                k = some[s:s + many]
                if len(k) > 32 * w:
                    out[k] = total[k] - 2 * side_by_side(left, right, u[k], v[k], w, codes)
                else:
                    for p in k:
                        x, y = left.texts[u[p]], right.texts[v[p]]
                        out[p] = 0 if x == y else one_by_one(x, y, int(limit[p]))
        return out

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if new.num_rows and old.num_rows:
            left, right = Texts(new["a"].to_pylist()), Texts(old["b"].to_pylist())
            alphabet, number = np.unique(np.concatenate([left.flat, right.flat]),
                                         return_inverse=True)
            number = number + 1                     # 0 stands for no character
            codes = (number[:len(left.flat)], number[len(left.flat):], len(alphabet) + 1)
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def settle() -> None:
                u, v, far = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                rounds = [np.arange(len(u))]
                if not every:                       # the nearest of each text, then the rest
                    order = np.lexsort((far, u))
                    nearest = np.diff(u[order], prepend=-1) != 0
                    rounds = [order[nearest], order[~nearest]]
                done = np.zeros(len(left.size), dtype=bool)
                for k in rounds:
                    k = k[~done[u[k]]]
                    indel = indel_of(left, right, u[k], v[k], codes)
                    ok = indel <= allowed(left.size[u[k]] + right.size[v[k]])
                    if not every:
                        done[u[k][ok]] = True
                    found.append((left.row[u[k][ok]], right.row[v[k][ok]], indel[ok]))

            for pairs in passing(left, right):
                held.append(pairs)
                if sum(len(p[0]) for p in held) >= exact_at_once:
                    settle()
            if held:
                settle()
        u, v, indel = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (
            np.zeros(0, np.int64),) * 3
        if not every:
            rows = pa.array(np.unique(u))
            return pa.table({c: new[c].take(rows) for c in ("a", "key")})
        u, v = pa.array(u), pa.array(v)
        return pa.table({"a": new["a"].take(u), "key": new["key"].take(u), "b": old["b"].take(v),
                         "name": new["name"].take(u), "indel": pa.array(indel)})
    return run
