"""Problem 3: the k most similar vectors of every vector, by score-aware anisotropic quantisation.

A coarse quantiser of two levels (spherical k-means; the second level is fitted cell by cell, in parallel) divides the
vectors into cells of about ``CELL_ROWS``.  Neighbouring cells form a *shard*, the unit of work: each vector goes once to
the shard of its own cell and, as a query, once to each other shard that holds one of its ``probes`` best cells.  There
every vector is coded once: the residual to its cell's centre by product quantisation with 16 words a subspace, whose
codes and words minimise a loss in which the residual's part parallel to the vector weighs ``eta`` times its orthogonal
part, as that part is what falsifies inner products.  Four-bit table scans score all vectors of a probed cell for a
query, and the best ``rerank`` of them are scored again exactly from the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

K = 5
CELL_ROWS = 2000
#: Cells with so many rows in all are looked into for each vector at least.
PROBED_ROWS = 4000
#: So many of a cell, and at least one of so many of a large one, are scored exactly.
RERANK, RERANK_SHARE = 32, 14
#: The first level and the code words are fitted on so many vectors at most, the first by a hash of their id; all are indexed.
SAMPLE_ROWS = 20_000
#: The second level is fitted on a share of all vectors with so many a centre, taken by the hash, but on this many at least.
CENTRE_ROWS, LEAST_SAMPLE = 32, 4096
#: Cells of the first level at most, and how many of them are looked into for a vector's cells.
COARSE, COARSE_PROBES = 1024, 4
#: Cells at most: their centres are what is sent to every task (0.1 GB).  Beyond ``CELL_ROWS`` times as many vectors cells grow.
MOST_CELLS = 250_000
#: Cells of one shard.
SHARD_CELLS = 8
WORDS = 16
#: Score threshold of the anisotropic loss, from which its weight follows.
THRESHOLD = 0.2
#: Rows of a cell in one group at most, as estimated from the sample: a larger cell is divided among groups.
BLOCK_BASE, BLOCK_QUERIES = 8192, 32768


def probes_for(cells: int, cell_rows: int) -> int:
    """How many cells a vector looks into: more of small cells, and one more each time there are four times as many."""
    return max(4 + int(math.log2(max(cells / 64, 1)) / 2), -(-PROBED_ROWS // cell_rows))


def unit_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 in float32, and which rows have a direction at all."""
    with np.errstate(all="ignore"):
        wide = values.astype(np.float64)
        norm = np.sqrt((wide**2).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        return (wide / np.where(good, norm, 1)[:, None]).astype(np.float32), good


def kmeans(x: np.ndarray, c: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Spherical k-means; a centre that loses all its rows starts again at the row that fits worst."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), c, replace=False)].copy()
    for _ in range(rounds):
        best, near = np.full(len(x), -2, np.float32), np.zeros(len(x), np.int64)
        for at in range(0, len(x), 4096):
            s = x[at : at + 4096] @ centers.T
            near[at : at + 4096] = s.argmax(1)
            best[at : at + 4096] = s.max(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        lost = np.flatnonzero(np.bincount(near, minlength=c) == 0)
        sums[lost] = x[np.argsort(best)[: len(lost)]]
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    return centers.astype(np.float32)


def _largest(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` largest scores of each row, in no order."""
    if n >= scores.shape[1]:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(-scores, n - 1, axis=1)[:, :n]


def children(vectors: np.ndarray, rows: float, cell_rows: int, seed: int) -> np.ndarray:
    """Centres of the second level in one coarse cell, ordered so that like ones stand together."""
    n = int(min(max(1, math.ceil(rows / cell_rows)), max(1, len(np.unique(vectors, axis=0)))))
    centers = kmeans(vectors, n, seed=seed)
    far = centers[(centers @ centers[0]).argmin()]
    return centers[np.argsort(centers @ (far - centers[0]), kind="stable")]


class Quantizer:
    """Cells and anisotropic product codes; fitted on samples, then sent to the workers."""

    def __init__(self, sample: np.ndarray, coarse: np.ndarray, centers: list[np.ndarray], sub: int = 4, rounds: int = 6):
        self.dims = d = sample.shape[1]
        self.coarse = coarse
        self.centers = np.concatenate(centers)
        self.begin = np.concatenate([[0], np.cumsum([len(c) for c in centers])])
        self.sub = sub
        self.m = -(-d // (2 * sub)) * 2  # two codes a byte
        self.eta = max((d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2), 1.0)
        x = self._pad(sample)
        res = x - self._pad(self.centers)[self.nearest(sample, 1)[:, 0]]
        rng = np.random.default_rng(3)
        first = res[rng.choice(len(res), WORDS, replace=len(res) < WORDS)]
        self.words = np.ascontiguousarray(first.reshape(WORDS, self.m, sub).transpose(1, 0, 2))
        for _ in range(rounds):
            codes = self._assign(x, res)
            self._refit(x, res, codes)

    def _pad(self, x: np.ndarray) -> np.ndarray:
        extra = self.m * self.sub - self.dims
        return np.pad(x, ((0, 0), (0, extra))) if extra else x

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` best cells of each row among those of its best coarse cells, best first; -1 where there are fewer."""
        tops = min(COARSE_PROBES, len(self.coarse)) if n < len(self.centers) else len(self.coarse)
        near = _largest(x @ self.coarse.T, tops)
        best, cell = np.full((len(x), n), -np.inf, np.float32), np.full((len(x), n), -1, np.int32)
        for p in range(tops):
            order = np.argsort(near[:, p], kind="stable")
            parts, at = np.unique(near[order, p], return_index=True)
            for c, a, b in zip(parts, at, [*at[1:], len(x)]):
                rows, low, high = order[a:b], self.begin[c], self.begin[c + 1]
                s = x[rows] @ self.centers[low:high].T
                take = _largest(s, n)
                both = np.concatenate([best[rows], np.take_along_axis(s, take, 1)], 1)
                cells = np.concatenate([cell[rows], (take + low).astype(np.int32)], 1)
                top = _largest(both, n)
                best[rows], cell[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(cells, top, 1)
        order = np.lexsort((cell, -best), axis=1)
        return np.take_along_axis(cell, order, 1)

    def _assign(self, x: np.ndarray, res: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes of residuals by coordinate descent: the parallel error is shared by all subspaces."""
        n = len(x)
        xs, rs = x.reshape(n, self.m, self.sub), res.reshape(n, self.m, self.sub)
        own = (self.words**2).sum(2)
        codes = np.zeros((n, self.m), np.uint8)
        chosen = np.zeros((n, self.m), np.float32)  # <x_m, word> of the chosen words
        dist = np.empty((self.m, n, WORDS), np.float32)
        par = np.empty((self.m, n, WORDS), np.float32)
        for j in range(self.m):
            dist[j] = own[j] - 2 * rs[:, j] @ self.words[j].T
            par[j] = xs[:, j] @ self.words[j].T
            codes[:, j] = dist[j].argmin(1)
            chosen[:, j] = par[j][np.arange(n), codes[:, j]]
        left = (x * res).sum(1) - chosen.sum(1)  # the parallel error so far
        for _ in range(passes):
            for j in range(self.m):
                rest = left + chosen[:, j]
                loss = dist[j] + (self.eta - 1) * (rest[:, None] - par[j]) ** 2
                codes[:, j] = loss.argmin(1)
                new = par[j][np.arange(n), codes[:, j]]
                left += chosen[:, j] - new
                chosen[:, j] = new
        return codes

    def _refit(self, x: np.ndarray, res: np.ndarray, codes: np.ndarray) -> None:
        """Words that minimise the loss for these codes, one subspace after the other."""
        n = len(x)
        xs, rs = x.reshape(n, self.m, self.sub), res.reshape(n, self.m, self.sub)
        chosen = np.stack([(xs[:, j] * self.words[j][codes[:, j]]).sum(1) for j in range(self.m)], 1)
        target = (x * res).sum(1)
        eye = np.eye(self.sub, dtype=np.float32)
        for j in range(self.m):
            rest = target - chosen.sum(1) + chosen[:, j]
            for w in range(WORDS):
                own = codes[:, j] == w
                if not own.any():
                    continue
                a, b = xs[own, j], rs[own, j]
                left = own.sum() * eye + (self.eta - 1) * a.T @ a
                right = b.sum(0) + (self.eta - 1) * a.T @ rest[own]
                self.words[j, w] = np.linalg.solve(left, right)
            chosen[:, j] = (xs[:, j] * self.words[j][codes[:, j]]).sum(1)

    def encode(self, x: np.ndarray, cell: int) -> np.ndarray:
        """Two four-bit codes in each byte."""
        padded = self._pad(x)
        codes = self._assign(padded, padded - self._pad(self.centers[cell : cell + 1]))
        return codes[:, ::2] * np.uint8(WORDS) + codes[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each byte of a code and each of its values the score of each query, so scaled that no sum leaves int16."""
        single = np.einsum("mwd,qmd->mwq", self.words, self._pad(queries).reshape(len(queries), self.m, self.sub))
        top = np.abs(single).max(axis=1).sum(axis=0)
        single = np.rint(single * (32000.0 / np.maximum(top, 1e-9))).astype(np.int16)
        return (single[::2, :, None] + single[1::2, None]).reshape(self.m // 2, WORDS * WORDS, len(queries))

    @staticmethod
    def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores (code rows x queries) without the cell's part, which is the same for all: sums of table rows."""
        scores = np.take(tables[0], codes[:, 0], axis=0)
        part = np.empty_like(scores)
        for j in range(1, len(tables)):
            np.take(tables[j], codes[:, j], axis=0, out=part, mode="clip")
            scores += part
        return scores


def search_shard(quant: Quantizer, base: np.ndarray, cells: np.ndarray, queries: np.ndarray, probed: tuple[np.ndarray, np.ndarray], k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k + 1`` vectors of the shard for each query, itself included: (query, base row, similarity).

    ``probed``: (query, cell) pairs.  Of each probed cell ``rerank`` vectors (``RERANK_SHARE``) are scored exactly; the
    similarities of the best are computed again in double precision.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    asks, asked = probed
    order, own = np.argsort(asked, kind="stable"), np.argsort(cells, kind="stable")
    for cell in np.unique(cells).tolist():
        rows = own[np.searchsorted(cells[own], cell) : np.searchsorted(cells[own], cell, "right")]
        who = asks[order[np.searchsorted(asked[order], cell) : np.searchsorted(asked[order], cell, "right")]]
        if not len(who):
            continue
        codes, r = quant.encode(base[rows], cell).astype(np.intp), min(max(rerank, len(rows) // RERANK_SHARE), len(rows))
        for at in range(0, len(who), 256):
            q = who[at : at + 256]
            near = rows[_largest(quant.scan(quant.tables(queries[q]), codes).T, r)]
            exact = np.einsum("qd,qrd->qr", queries[q], base[near])
            top = _largest(exact, k + 3)
            found.append((np.repeat(q, top.shape[1]), np.take_along_axis(near, top, 1).ravel(), np.take_along_axis(exact, top, 1).ravel()))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, b, s = (np.concatenate(x) for x in zip(*found))

    def first(q, b, s, n):
        order = np.lexsort((-s, q))
        q, b, s = q[order], b[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < n
        return q[keep], b[keep], s[keep]

    q, b, s = first(q, b, s, k + 3)
    s = np.minimum(np.einsum("nd,nd->n", queries[q].astype(np.float64), base[b].astype(np.float64)), 1.0)
    return first(q, b, np.round(s, 9), k + 1)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A binary column of fixed width as float32 rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), dims)


def packed(vectors: DataFrame, dims: int) -> DataFrame:
    """``id, vec``: rows of ``dims`` numbers that have a direction, at length 1 in float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(np.diff(batch.column(1).offsets.to_numpy()) == dims)
            batch = batch.take(pa.array(keep))
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            unit, good = unit_rows(flat.reshape(len(keep), dims))
            keep = np.flatnonzero(good)
            unit = np.ascontiguousarray(unit[keep]) + np.float32(0)  # no negative zeros
            vecs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(keep), [None, pa.py_buffer(unit.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), vecs], names=["id", "vec"])

    return vectors.mapInArrow(run, "id string, vec binary")


@dataclass
class Model:
    """What the workers need: the quantiser, how many cells a vector looks into, and the groups that each cell is divided into."""

    quant: Quantizer
    probes: int
    base_parts: np.ndarray
    query_parts: np.ndarray


def _share(fixed: DataFrame, share: float, seed: int) -> DataFrame:
    return fixed.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))


def fit(fixed: DataFrame, dims: int, rows: int, sample_rows: int, cell_rows: int, probes: int | None) -> Model | None:
    """Both levels and the code words.  The first level and the words are fitted on ``sample_rows`` vectors at most, on the
    driver; the second level one coarse cell a task, on a share of all vectors that falls as cells grow."""
    part = _share(fixed, min(1.0, 1.5 * sample_rows / max(rows, 1)), 17)
    taken = part.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(sample_rows).select("vec").toArrow()["vec"]
    if not len(taken):
        return None
    sample = np.unique(_matrix(taken, dims), axis=0)
    sample = sample[np.random.default_rng(1).permutation(len(sample))]
    cell_rows = max(cell_rows, -(-rows // MOST_CELLS))
    coarse = kmeans(sample, int(min(max(1, math.ceil(rows / (SHARD_CELLS * cell_rows))), COARSE, max(1, len(sample) // 16))))
    share = min(1.0, max(CENTRE_ROWS / cell_rows, LEAST_SAMPLE / max(rows, 1)))
    shared = fixed.sparkSession.sparkContext.broadcast(coarse)  # COARSE vectors at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_matrix(batch.column(0), dims) @ shared.value.T).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0)], names=["coarse", "vec"])

    def split(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(sorted(table["vec"].to_pylist())), np.float32).reshape(-1, dims)
        c = table["coarse"][0].as_py()
        centers = children(x, len(x) / share, cell_rows, c)
        own = np.bincount((x @ centers.T).argmax(1), minlength=len(centers))
        return pa.table([pa.array([c], pa.int32()), pa.array([centers.tobytes()], pa.binary()), pa.array([own.tolist()], pa.list_(pa.int64()))], names=["coarse", "centers", "n"])

    placed = _share(fixed, share, 29).select("vec").mapInArrow(place, "coarse int, vec binary")
    fitted = {r.coarse: r for r in placed.groupBy("coarse").applyInArrow(split, "coarse int, centers binary, n array<long>").collect()}
    whole = [np.frombuffer(fitted[c].centers, np.float32).reshape(-1, dims) if c in fitted else coarse[c : c + 1] for c in range(len(coarse))]
    sizes = np.concatenate([np.array(fitted[c].n) if c in fitted else np.zeros(1) for c in range(len(coarse))]) / share
    quant = Quantizer(sample, coarse, whole)
    probes = min(probes or probes_for(len(quant.centers), cell_rows), len(quant.centers))
    base = np.ceil(sizes / BLOCK_BASE).clip(1).astype(np.int64)
    return Model(quant, probes, base, np.ceil(sizes * probes / BLOCK_QUERIES).clip(1).astype(np.int64))


def _send(model: Model, dims: int, k: int):
    """Rows for the shards: ``shard, part, vkey, vec, ids, own, cells``; ``own`` is a vector's cell (-1 for a mere query)."""
    quant, nb, nq = model.quant, model.base_parts, model.query_parts
    whole = (nb == 1) & (nq == 1)
    # cells stand together in shards of SHARD_CELLS, never of two coarse cells; a divided cell is a shard of its own
    shard = np.concatenate([np.arange(n) // SHARD_CELLS + base * 1.0 for n, base in zip(np.diff(quant.begin), quant.begin)]).astype(np.int64)
    shard = np.where(whole, shard, len(nb) + np.arange(len(nb)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # of many copies in a batch the first k + 1 ids go on
            ids, keys, vecs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            copies: dict[bytes, list[str]] = {}
            place: dict[bytes, int] = {}
            for i, key in enumerate(keys):
                copies.setdefault(key, []).append(ids[i])
                place.setdefault(key, i)
            row = np.fromiter(place.values(), np.int64, len(place))
            names = [sorted(set(c))[: k + 1] for c in copies.values()]
            near = quant.nearest(_matrix(vecs.take(pa.array(row)), dims), model.probes)
            number = np.array([int.from_bytes(key[:4], "little") for key in copies], np.int64)
            # (row, cell, part, own) of every visit; a divided cell is visited in each part of its base or of its queries
            out = []
            for p in range(near.shape[1]):
                r = np.flatnonzero(near[:, p] >= 0)
                c = near[r, p].astype(np.int64)
                b, q = number[r] % nb[c], (number[r] >> 8) % nq[c]
                if p == 0:
                    size = nq[c]
                    turn = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    out.append((np.repeat(r, size), np.repeat(c, size), np.repeat(b * nq[c], size) + turn, np.ones(len(turn), bool), turn == np.repeat(q, size)))
                size = nb[c]
                turn = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                keep = turn != np.repeat(b, size) if p == 0 else np.ones(len(turn), bool)
                visit = (np.repeat(r, size), np.repeat(c, size), turn * np.repeat(nq[c], size) + np.repeat(q, size), np.zeros(len(turn), bool), np.ones(len(turn), bool))
                out.append(tuple(v[keep] for v in visit))
            r, c, part, is_base, asks = (np.concatenate(x) for x in zip(*out))
            order = np.lexsort((c, part, shard[c], r))
            r, c, part, is_base, asks = r[order], c[order], part[order], is_base[order], asks[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(r) != 0) | (np.diff(shard[c]) != 0) | (np.diff(part) != 0)]))
            own = np.maximum.reduceat(np.where(is_base, c, -1), first)
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(asks.astype(np.int64), first))]).astype(np.int32)), pa.array(c[asks].astype(np.int32)))
            who = r[first]
            take = pa.array(row[who])
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[c[first]].astype(np.int32)), pa.array(part[first].astype(np.int32)), batch.column(1).take(take), vecs.take(take),
                 pa.array([names[i] if o >= 0 else None for i, o in zip(who.tolist(), own.tolist())], pa.list_(pa.string())), pa.array(own.astype(np.int32)), cells],
                names=["shard", "part", "vkey", "vec", "ids", "own", "cells"],
            )

    return run


def _search(shared, dims: int, k: int, rerank: int):
    """The best of one shard for every vector that visits it: ``vkey, ids, sims``, itself and its copies included."""

    def run(table: pa.Table) -> pa.Table:
        names, kinds = ["vkey", "ids", "sims"], [pa.binary(), pa.list_(pa.string()), pa.list_(pa.float64())]
        table = table.sort_by([("vkey", "ascending"), ("own", "descending")])
        keys, own = table["vkey"].to_pylist(), table["own"].to_numpy()
        # rows of one vector, from several batches, become one: with an own cell first
        first = [i for i, key in enumerate(keys) if not i or key != keys[i - 1]]
        ids: list[list[str]] = [[] for _ in first]
        at = -1
        for i, (key, value) in enumerate(zip(keys, table["ids"].to_pylist())):
            at += i == (first[at + 1] if at + 1 < len(first) else -1)
            ids[at] += value or ()
        ids = [sorted(set(x))[: k + 1] for x in ids]
        part = table.take(pa.array(first))
        x, own = _matrix(part["vec"], dims), own[first]
        cells = part["cells"].combine_chunks()
        base = np.flatnonzero(own >= 0)
        asks = np.repeat(np.arange(len(first)), np.diff(cells.offsets.to_numpy()))
        q, b, s = search_shard(shared.value.quant, x[base], own[base], x, (asks, cells.flatten().to_numpy()), k, rerank)
        out: list[list] = [[], [], []]
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(q) != 0, [True]])).tolist() if len(q) else [0]
        q, b, s = q.tolist(), base[b].tolist(), s.tolist()
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            near = sorted((-v, i) for j, v in zip(b[lo:hi], s[lo:hi]) for i in ids[j])[: k + 1 + len(ids[q[lo]])]
            out[0].append(keys[first[q[lo]]])
            out[1].append([i for _, i in near])
            out[2].append([-v for v, _ in near])
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return run


def _neighbors_of_length(vectors: DataFrame, dims: int, rows: int, k: int, probes: int | None, rerank: int, sample_rows: int, cell_rows: int) -> DataFrame | None:
    fixed = packed(vectors, dims)
    model = fit(fixed, dims, rows, sample_rows, cell_rows, probes)
    if model is None:
        return None
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # MOST_CELLS centres at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _send(shared.value, dims, k)(batches)

    keyed = fixed.select("id", F.unhex(F.md5("vec")).alias("vkey"), "vec")
    sent = keyed.mapInArrow(send, "shard int, part int, vkey binary, vec binary, ids array<string>, own int, cells array<int>")
    found = sent.groupBy("shard", "part").applyInArrow(_search(shared, dims, k, rerank), "vkey binary, ids array<string>, sims array<double>")
    # a few entries of each visited shard a vector
    pairs = F.transform(F.arrays_zip("ids", "sims"), lambda p: F.struct((-p["sims"]).alias("s"), p["ids"].alias("id")))
    best = found.groupBy("vkey").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, k + 1).alias("best"))
    members = keyed.select("vkey", "id").distinct()
    others = F.slice(F.filter("best", lambda p: p["id"] != F.col("id")), 1, k)
    return members.join(best, "vkey").select("id", F.posexplode(others).alias("pos", "n")).select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("n.id").alias("neighbor_id"), (-F.col("n.s")).alias("similarity")
    )


def nearest_neighbors(
    docs: DataFrame, k: int = K, probes: int | None = None, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``id, rank, neighbor_id, similarity``: the ``k`` other ids with the largest cosine to each id.

    Null, empty, all-zero and non-finite embeddings take no part.  Embeddings of one length (number of numbers) are
    compared with each other; each length that occurs has an index of its own.  Vector norms other than 1 make no
    difference.  Equal similarities (to nine digits) rank by id, so of many copies of a vector each gets the first ``k``
    others; copies of an id are one id.  Fewer rows than ``k`` come out where fewer ids exist.  Similarities are exact.
    A neighbour is missed if its cell is not among the ``probes`` best of the query (``probes_for`` by default) or if the
    quantised score ranks it behind ``rerank`` others of its cell (recall is measured in the tests and README).  With as
    many probes as cells and a rerank of all rows nothing is missed: the exact way, whose work is every pair of rows.
    """
    spark = docs.sparkSession
    vectors = docs.select(F.col("id").cast("string").alias("id"), "embedding").where("id is not null and embedding is not null and size(embedding) > 0")
    lengths = vectors.groupBy(F.size("embedding").alias("dims")).count().orderBy("dims").collect()  # one row a length
    parts = [_neighbors_of_length(vectors.where(F.size("embedding") == r.dims), r.dims, r["count"], k, probes, rerank, sample_rows, cell_rows) for r in lengths if r["count"] > 1]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "id string, rank int, neighbor_id string, similarity double")


def similar_pairs(docs: DataFrame, at_least: float = 0.8, **options) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b), once each: one of them is among the ``k`` most similar of the other, with that cosine."""
    near = nearest_neighbors(docs, **options).where(F.col("similarity") >= at_least)
    return near.select(F.least("id", "neighbor_id").alias("id_a"), F.greatest("id", "neighbor_id").alias("id_b")).distinct()
