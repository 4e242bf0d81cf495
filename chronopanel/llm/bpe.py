"""Byte-pair encoding of many pieces at once on numpy matrices.

Pieces of like length are rows of a padded matrix. In each round every row merges its leftmost pair of minimum rank,
finished rows leave and the matrix loses a column. Pairs are found in an open-addressed hash table.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np

#: No pair; above any rank.
NONE = np.int32(2**31 - 1)
#: Pieces of more bytes are rows of their own, in which all places of the pair of minimum rank merge in one round.
LONG = 512
#: Pieces that a worker remembers, and bytes in a matrix.
REMEMBERED, CELLS = 1_000_000, 1 << 22


class PairTable:
    """(left id, right id) -> rank of the merged token, by open addressing over a table four times as large."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        bits = max(4, int(4 * len(left)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], rank[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        out, at, open_ = np.full(keys.shape, NONE, np.int32), self._slot(keys), np.flatnonzero((left >= 0) & (right >= 0))
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            at[open_] = (at[open_] + 1) & self.mask
        return out


class Encoder:
    """Ranks of a vocabulary file (base64 token, space, rank on each line); a token's rank is its id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        trio = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int32) for x in zip(*trio, strict=True))
        self.pairs, self._pair_dict = PairTable(left, right, rank), None
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.count = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct pieces: ids of all, and where those of each start and end."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[np.ndarray | None] = [None] * len(pieces)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            width = int(sizes[order[at]])
            if width > LONG:
                for i in order[at:]:
                    out[i] = self._wide(pieces[i])
                break
            top = 1 << max(0, (width - 1).bit_length())  # buckets of widths up to a power of two
            end = int(np.searchsorted(sizes[order], min(top, LONG), "right"))
            end = min(end, at + max(1, CELLS // max(1, top)))
            rows = order[at:end]
            self._matrix([pieces[i] for i in rows], rows, sizes[rows], out)
            at = end
        lens = np.fromiter((len(x) for x in out), np.int64, len(out))
        return (np.concatenate(out) if out else np.empty(0, np.int32)), np.concatenate([[0], np.cumsum(lens)])

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, sizes: np.ndarray, out: list) -> None:
        n, width = len(pieces), int(sizes.max(initial=0))
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((n, width + 1), -1, np.int32)  # a last column of padding, so that each cell has a right neighbour
        ids[np.arange(width + 1)[None, :] < sizes[:, None]] = flat
        lens = sizes.copy()
        ranks = np.full((n, width + 1), NONE, np.int32)
        ranks[:, :-1] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        while True:
            pos = ranks.argmin(1)
            best = ranks[np.arange(len(pos)), pos]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = ids[i, : lens[i]].copy()
                keep = ~done
                ids, ranks, rows, lens, pos, best = ids[keep], ranks[keep], rows[keep], lens[keep], pos[keep], best[keep]
            if not len(rows):
                return
            r = np.arange(len(rows))
            ids[r, pos] = best
            stay = np.ones(ids.shape, bool)
            stay[r, pos + 1] = False
            ids = ids[stay].reshape(len(rows), -1)
            stay[r, pos + 1], stay[r, pos] = True, False
            ranks = ranks[stay].reshape(len(rows), -1)
            lens = lens - 1
            right = np.where(pos + 1 < ids.shape[1], ids[r, np.minimum(pos + 1, ids.shape[1] - 1)], -1)
            ranks[r, pos] = self.pairs.get(ids[r, pos], right)
            has = pos > 0
            ranks[r[has], pos[has] - 1] = self.pairs.get(ids[r[has], pos[has] - 1], ids[r[has], pos[has]])
            most = int(lens.max()) + 1
            if most < ids.shape[1]:
                ids, ranks = np.ascontiguousarray(ids[:, :most]), np.ascontiguousarray(ranks[:, :most])

    def _wide(self, piece: bytes) -> np.ndarray:
        """One long piece: rounds as in a matrix, but from the left all places of the pair merge, of overlapping ones every
        other, up to the first merge that makes a pair of lower rank, which has to come before the rest."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].copy()
        ranks = np.full(len(ids), NONE, np.int32)  # the last has no right neighbour
        ranks[:-1] = self.pairs.get(ids[:-1], ids[1:])
        while len(ids) > 1 and (best := ranks.min()) != NONE:
            pos = np.flatnonzero(ranks == best)
            new = np.ones(len(pos), bool)
            new[1:] = pos[1:] != pos[:-1] + 1
            at = np.arange(len(pos))
            pos = pos[(at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0]
            whole = np.full(len(pos), best, np.int32)
            before = np.where(np.concatenate([[False], pos[1:] == pos[:-1] + 2]), best, np.where(pos > 0, ids[pos - 1], -1)).astype(np.int32)
            after = np.where(pos + 2 < len(ids), ids[np.minimum(pos + 2, len(ids) - 1)], -1).astype(np.int32)
            lower = np.flatnonzero(np.minimum(self.pairs.get(before, whole), self.pairs.get(whole, after)) < best)
            if len(lower):
                pos = pos[: lower[0] + 1]
            ids[pos] = best
            stay = np.ones(len(ids), bool)
            stay[pos + 1] = False
            pos = pos - np.arange(len(pos))  # where the merged tokens come to stand
            ids, ranks = ids[stay], ranks[stay]
            for spot in (pos, pos[pos > 0] - 1):
                spot = spot[spot < len(ids) - 1]
                ranks[spot] = self.pairs.get(ids[spot], ids[spot + 1])
            ranks[-1] = NONE
        return ids

    def _long(self, piece: bytes) -> np.ndarray:
        if self._pair_dict is None:
            used = self.pairs.keys >= 0
            self._pair_dict = dict(zip(self.pairs.keys[used].tolist(), self.pairs.ranks[used].tolist(), strict=True))
        get = self._pair_dict.get
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (q := get((r << 32) | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[nxt[i]]))
            if (p := prv[i]) >= 0 and (q := get((ids[p] << 32) | r)) is not None:
                heapq.heappush(heap, (q, p, ids[p], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def lookup(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in the returned ids those of each distinct piece start and end; what was encoded before is remembered."""
        if len(self.known) > REMEMBERED:
            self.known, self.count = {}, 0
        new = [p for p in pieces if p not in self.known]
        if new:
            flat, starts = self.encode(new)
            n, used = self.count, int(self.starts[self.count])
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
            # Room doubles, so that what is remembered is copied seldom.
            if used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[:used], np.empty(used + 2 * len(flat), np.int32)])
            if n + len(starts) > len(self.starts):
                self.starts = np.concatenate([self.starts[: n + 1], np.zeros(n + 2 * len(starts), np.int64)])
            self.flat[used : used + len(flat)] = flat
            self.starts[n + 1 : n + len(starts)] = starts[1:] + used
            self.count = n + len(new)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        return self.flat, self.starts[at], self.starts[at + 1]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(path)
