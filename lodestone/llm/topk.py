"""Exact top-k search by inner product with the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
#: Candidate blocks that one task holds, on average, and the least number of such tasks.
SLOT_BLOCKS = 32
SLOTS = 32
#: A list is read down to this share of what the best conceivable vector has there.
_DOWN = 0.8
#: Once this share of a block is scored, its lists are read to their ends.
_ENOUGH = 0.25
_BLOCK = "dim int, n int, width int, ids binary, vectors binary"


def ceiling(weight: np.ndarray, caps: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The most that weight . y can be for y <= caps and |y| <= radius, for each row, and such a y.

    The best y is min(caps, m * weight) for the m that gives it the length ``radius``. Any m > 0 gives an upper bound by
    duality, so the bound holds although m is found by bisection.
    """
    caps = np.where(weight > 0, caps, 0.0)
    length = np.sqrt((weight * weight).sum(axis=1))
    unit = radius / np.where(length > 0, length, 1.0) if radius > 0 else np.ones(len(weight))
    low, high = unit * 1e-6, unit * 1e6
    for _ in range(26):
        m = np.sqrt(low * high)
        y = np.minimum(caps, m[:, None] * weight)
        over = (y * y).sum(axis=1) > radius * radius
        high, low = np.where(over, m, high), np.where(over, low, m)
    y = np.minimum(caps, low[:, None] * weight)
    dual = (weight * y - y * y / (2 * low[:, None])).sum(axis=1) + radius * radius / (2 * low)
    return np.minimum(dual, (weight * caps).sum(axis=1)), y


class SortedLists:
    """A block of integer vectors with one list per dimension, sorted by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.n, self.dim = ids, len(ids), vectors.shape[1]
        self.wide = vectors.dtype == object
        self.peak = int(np.abs(vectors.astype(object) if self.wide else vectors.astype(np.int64)).max(initial=0))
        self.vectors = vectors
        self.distinct = len(np.unique(ids)) == len(ids)
        if not self.wide and self.n:
            x = vectors.astype(np.float64)
            order = np.argsort(x, axis=0, kind="stable")
            self.order = order.astype(np.uint16 if self.n <= 2**16 else np.int64)
            self.values = np.ascontiguousarray(np.take_along_axis(x, order, axis=0).T.astype(np.float32 if self.peak < 2**24 else np.float64))
            self.radius = float(np.sqrt((x * x).sum(axis=1).max()))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no vector of the block exceeds, for each query."""
        if self.wide or not self.n or not self.dim:
            return np.full(len(queries), np.inf)
        return ceiling(np.abs(queries), np.where(queries > 0, self.values[:, -1], -self.values[:, 0]), self.radius)[0]

    def _depths(self, queries: np.ndarray, target: np.ndarray) -> np.ndarray:
        """How many entries of each list lie beyond the target, read from the end that favours the query's sign."""
        out = np.zeros(queries.shape, dtype=np.int64)
        for j in range(self.dim):
            up = queries[:, j] > 0
            out[:, j] = np.where(up, self.n - np.searchsorted(self.values[j], target[:, j], side="right"), np.searchsorted(self.values[j], -target[:, j], side="left"))
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
        """Improve ``best`` (scores, ids) of every query; returns how many vectors were scored for each.

        In every round a query reads on in the list where an entry read takes most from the bound, down to a share of
        what the best conceivable unseen vector has there. That vector lies under all caps (the components at which
        reading has stopped) and is no longer than the block's longest. The search ends once its score is below the kth
        best; at equality it goes on, as an unseen vector may win by its id. A query that has scored a good part of the
        block all the same reads the lists to their ends, for all such queries in one product.
        """
        scored = np.zeros(len(queries), dtype=np.int64)
        peak = self.peak * int(np.abs(queries.astype(object) if queries.dtype == object else queries.astype(np.int64)).max(initial=0)) * max(1, self.dim)
        if self.wide or queries.dtype == object or peak >= 2**63:
            self._read_all(np.arange(len(queries)), queries.astype(object), self.vectors.astype(object), own, best, k)
            return scored + self.n
        kind = np.float64 if peak < 2**53 else np.int64  # floats hold the products exactly below 2^53
        vectors, exact, q = self.vectors.astype(kind), queries.astype(kind), queries.astype(np.float64)
        if not self.dim or not self.n:
            self._read_all(np.arange(len(q)), exact, vectors, own, best, k)
            return scored + self.n
        weight = np.abs(q)
        caps = np.where(q > 0, self.values[:, -1], -self.values[:, 0])
        depth = np.zeros(q.shape, dtype=np.int64)
        seen: dict[int, np.ndarray] = {}
        late: list[int] = []
        active = np.arange(len(q))
        while len(active):
            bound, y = ceiling(weight[active], caps[active], self.radius)
            kth = _kth([best[i] for i in active.tolist()], k)
            going = bound + 1e-9 * (np.abs(bound) + self.radius) + 1e-6 >= kth
            active, y = active[going], y[going]
            if not len(active):
                break
            target = np.minimum(caps[active], _DOWN * np.maximum(y, 0.0)).astype(self.values.dtype).astype(np.float64)
            to = np.maximum(depth[active], self._depths(q[active], target))
            gain = weight[active] * (np.minimum(caps[active], np.maximum(y, 0.0)) - target)
            worth = gain / (to - depth[active] + 1.0)
            pick = worth.argmax(axis=1)
            on = []
            for r, (i, j) in enumerate(zip(active.tolist(), pick.tolist(), strict=True)):
                if worth[r, j] <= 0:
                    late.append(i)
                    continue
                a, b = depth[i, j], to[r, j]
                new = self.order[self.n - b : self.n - a, j] if q[i, j] > 0 else self.order[a:b, j]
                depth[i, j], caps[i, j] = b, target[r, j]
                mark = seen.setdefault(i, np.zeros(self.n, dtype=bool))
                fresh = new[~mark[new]]
                if len(fresh):
                    mark[fresh] = True
                    scored[i] += len(fresh)
                    best[i] = merge(best[i], (vectors[fresh] @ exact[i]).astype(np.int64), self.ids[fresh], k, own[i])
                (late if scored[i] > _ENOUGH * self.n else on).append(i)
            active = np.array(on, dtype=np.int64)
        if late:
            scored[late] = self.n
            self._read_all(np.array(late), exact, vectors, own, best, k)
        return scored

    def _read_all(self, which: np.ndarray, queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, best: list, k: int) -> None:
        for part in np.array_split(which, max(1, len(which) // 256)):
            scores = vectors @ queries[part].T if self.dim else np.zeros((self.n, len(part)), dtype=np.int64)
            if scores.dtype == np.float64:
                scores = scores.astype(np.int64)
            for c, i in enumerate(part.tolist()):
                s, ids = scores[:, c], self.ids
                if self.distinct and s.dtype != object and len(s) > k + 1:
                    least = np.partition(s, len(s) - k - 1)[len(s) - k - 1]  # one more, as the query's own row may be among them
                    keep = s >= least
                    s, ids = s[keep], ids[keep]
                best[i] = merge(best[i], s, ids, k, own[i])


def _kth(best: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """The kth best score of each query, as far as a double can tell it; without k results nothing is too low."""
    return np.array([float(min(max(s[-1], -(10**300)), 10**300)) if len(s) == k else -np.inf for s, _ in best])


def merge(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, an id once with its highest score, by falling score and rising id."""
    keep = ids != own
    if len(best[0]) == k:
        keep &= (scores >= best[0][-1]).astype(bool)
    if not keep.any():
        return best
    scores, ids = np.concatenate([best[0], scores[keep]]), np.concatenate([best[1], ids[keep]])
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda r: (-scores[r], ids[r])), dtype=np.int64)
    else:
        order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return scores[order], ids[order]


def _scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers of any size; a product beyond the range of doubles is taken exactly."""
    with np.errstate(over="ignore"):
        m = np.floor(scale * x)
    if not m.size or np.abs(m).max() < 2**31:
        return m.astype(np.int64)
    return np.array([math.floor(v) if math.isfinite(v) else math.floor(Fraction(scale) * Fraction(float(c))) for v, c in zip(m.tolist(), x.tolist(), strict=True)], dtype=object)


def _sortable(score: int) -> tuple[int, str, int | None]:
    """(size, digits, score) that sort like the score; for one within a long the first two are empty, else the last is null."""
    if -(2**63) <= score < 2**63:
        return 0, "", score
    text = str(abs(score))
    return (len(text), text, None) if score > 0 else (-len(text), text.translate(str.maketrans("0123456789", "9876543210")), None)


def _usable(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[tuple[int, bool], int, np.ndarray]]:
    """((dimension, wide), id, integer vector) of the rows that take part; wide ones need more than 32 bits."""
    for i, v in zip(ids.to_pylist(), vectors, strict=True):
        if i is None or not v.is_valid or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            m = _scaled(x, scale)
            yield (len(m), m.dtype == object), i, m


def _packed(ids: list[int], rows: list[np.ndarray], dim: int, wide: bool) -> dict:
    own = np.array(ids, dtype="<i8").tobytes()
    if wide:
        return {"dim": dim, "n": len(ids), "width": 0, "ids": own, "vectors": "\n".join(" ".join(map(str, r)) for r in rows).encode()}
    m = np.array(rows, dtype=np.int64).reshape(len(rows), dim)
    width = next(w for w in (1, 2, 4) if not m.size or np.abs(m).max() < 2 ** (8 * w - 1))
    return {"dim": dim, "n": len(ids), "width": width, "ids": own, "vectors": m.astype(f"<i{width}").tobytes()}


def _unpacked(dim: int, n: int, width: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    if width:
        m = np.frombuffer(vectors, f"<i{width}").reshape(n, dim)
    else:
        m = np.array([[int(x) for x in line.split()] for line in vectors.decode().split("\n")], dtype=object).reshape(n, dim)
    return np.frombuffer(ids, "<i8"), m


def _blocks(df: DataFrame, size: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list[int], list[np.ndarray]]] = {}

        def out(key: tuple[int, bool]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_packed(*held.pop(key), *key)], schema=schema)

        schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
        for b in batches:
            for key, i, m in _usable(b.column(0), b.column(1), scale):
                ids, rows = held.setdefault(key, ([], []))
                ids.append(i)
                rows.append(m)
                if len(ids) >= size:
                    yield out(key)
        for key in list(held):
            yield out(key)

    return df.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(build, _BLOCK)


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", with_cost: bool = False
) -> DataFrame:
    """For every query the ``k`` candidates of other ids with the highest integer inner product.

    Returns query_id, rank (from 1), vec_id, score[, n_scored]; ties go to the smaller vec_id. Components become
    floor(scale * x). Rows are packed into blocks. A candidate block moves once, to its slot; the queries, which are the
    few, go to every slot, whose number grows with the candidates. A slot's task sorts the lists of its blocks once and
    keeps them (``SLOT_BLOCKS`` on average); each block of queries visits them by falling bound with the k best that it
    has found so far, skips those whose bound cannot beat the kth, and leaves k rows per query. ``n_scored`` is the
    number of vectors whose scores were computed for the query, over all blocks.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part, nor do
    candidates of another dimension than the query's. Of repeated ids the pair with the highest score counts, once; a
    row with the query's own id is never its result. Components and scores are exact whatever their size; a score that
    a long cannot hold comes back as null in its right rank. Empty tables give no rows; other columns are ignored.
    """
    prepare(queries.sparkSession)
    n_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    n_slots = max(SLOTS, math.ceil(candidates.count() / (CANDIDATE_BLOCK * SLOT_BLOCKS)))
    cand = _blocks(candidates, CANDIDATE_BLOCK, scale, id_col, vector_col).withColumn("slot", F.pmod(F.xxhash64("ids", "vectors"), F.lit(n_slots)))
    dealt = queries.repartition(n_blocks, F.xxhash64(id_col, vector_col))
    asked = _blocks(dealt, QUERY_BLOCK, scale, id_col, vector_col)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slots - 1).cast("long"))).alias("slot"))
    # a merge join reads the left side once and keeps the right side of the slot: all pairs of a block of queries come together
    pairs = asked.join(cand.hint("merge"), "slot").where(F.col("dim") == F.col("q_dim"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[bytes, bytes], SortedLists] = {}

        def answered(asked: tuple, blocks: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            ids, qs = _unpacked(*asked)
            best = [(np.array([], dtype=np.int64), np.array([], dtype=np.int64))] * len(ids)
            scored = np.zeros(len(ids), dtype=np.int64)
            plain = qs.astype(np.float64) if qs.dtype != object else None
            bound = {b: lists[b].bounds(plain) if plain is not None else np.full(len(ids), np.inf) for b in blocks}
            for b in sorted(blocks, key=lambda b: -float(bound[b].mean())):
                may = np.flatnonzero(bound[b] + 1e-9 * np.abs(bound[b]) + 1e-6 >= _kth(best, k))
                part = [best[i] for i in may.tolist()]
                scored[may] += lists[b].search(qs[may], ids[may], part, k)
                for i, x in zip(may.tolist(), part, strict=True):
                    best[i] = x
            out = [(int(i), int(c), *_sortable(int(s)), int(n) * (j == 0)) for i, (ss, cs), n in zip(ids, best, scored, strict=True) for j, (s, c) in enumerate(zip(ss, cs, strict=True))]
            kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "size": pa.int32(), "digits": pa.string(), "score": pa.int64(), "n_scored": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds.values())], list(kinds))

        slot, at, blocks = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                now = (r["slot"], *(r[f"q_{c}"] for c in ("dim", "n", "width", "ids", "vectors")))
                if now != at:
                    if at is not None:
                        yield from answered(at[1:], blocks)
                    if r["slot"] != slot:
                        slot = r["slot"]
                        lists.clear()
                    at, blocks = now, []
                own = (r["ids"], r["vectors"])
                if own not in lists:
                    lists[own] = SortedLists(*_unpacked(*(r[c] for c in ("dim", "n", "width", "ids", "vectors"))))
                blocks.append(own)
        if at is not None:
            yield from answered(at[1:], blocks)

    cols = ["slot", "dim", "n", "width", "ids", "vectors", "q_dim", "q_n", "q_width", "q_ids", "q_vectors"]
    part = pairs.select(*cols).mapInArrow(search, "query_id long, vec_id long, size int, digits string, score long, n_scored long")
    once = part.groupBy("query_id", "vec_id").agg(F.max(F.struct("size", "digits", "score")).alias("s"), F.sum("n_scored").alias("n_scored"))
    own = Window.partitionBy("query_id")
    ranked = once.withColumn("rank", F.row_number().over(own.orderBy(F.desc("s"), F.asc("vec_id"))))
    if with_cost:
        ranked = ranked.withColumn("n_scored", F.sum("n_scored").over(own))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("s.score").alias("score"), *["n_scored"] * with_cost)
