"""Approximate nearest neighbours by cosine: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is indexed.  How
many cells a query probes is learnt from the sample by how near its nearest centroid is, so
that queries inside a tight group look into few cells.  Within a cell, asymmetric tables give
every vector's estimated cosine; those that may still be among the nearest, given the size
of their own quantisation error, are reranked on the original vectors.  Cells and the queries
that probe them are dealt out in blocks of bounded size, so a cell that holds a third of all
vectors spreads over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

SAMPLE = 20_000
MAX_LISTS = 4096
CODES = 256
CELL_ROWS, QUERY_ROWS = 20_000, 2_000
#: Reranked side by side; queries with more candidates are reranked against whole blocks.
RERANK = 64
#: Standard deviations of the quantisation error that a candidate may be off.
SURE = 3.0
#: Share of a sample's own nearest neighbours that must lie in probed cells, for each of BINS kinds of queries, and the
#: standard deviations by which the measured share may be off: few queries to measure by call for more probes.
TARGET, OFF, BINS = 0.95, 3.0, 16
#: Numbers of a distance matrix held at once.
MATRIX = 2_000_000


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), size=int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, max(len(x), 1), 4096)])


def length_one(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Fitted centroids and codebooks; vectors are compared by direction, so they are scaled to length 1."""

    def __init__(self, sample: np.ndarray, total: int, queries: int, probes: int | None):
        dim = sample.shape[1]
        every = length_one(sample)
        unit = np.unique(every, axis=0)  # a vector with many copies must not take the centroids, nor pass for easy queries
        self.centroids = kmeans(unit, max(1, min(MAX_LISTS, int(math.sqrt(total) / 2), len(unit))), 8, 1)
        parts = max(d for d in range(1, min(16, dim) + 1) if dim % d == 0)
        self.width = dim // parts
        rest = unit - self.centroids[nearest(unit, self.centroids)]
        self.books = [kmeans(rest[:, p * self.width : (p + 1) * self.width], CODES, 6, 2 + p) for p in range(parts)]
        self.edges, self.probes = (np.zeros(0), np.array([probes])) if probes else self.enough(unit)
        self.probes = np.minimum(self.probes, len(self.centroids))
        # Blocks of each cell, from the sample's share of vectors and of probes: a size to expect, no limit.
        cells = len(self.centroids)
        share = np.bincount(nearest(every, self.centroids), minlength=cells) / len(every)
        probed, n = self.probed(every[:: max(1, len(every) // 2000)])
        asked = np.bincount(probed, minlength=cells) / len(n)
        self.blocks = np.maximum(1, np.ceil(np.stack([share * total / CELL_ROWS, asked * queries / QUERY_ROWS]))).astype(np.int64)
        self.scanned = float((np.bincount(probed, weights=share[probed], minlength=cells)).sum() / len(n))

    def enough(self, unit: np.ndarray, queries: int = 6144, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(borders, probes): by similarity to the nearest centroid, the probes that reach TARGET of the sample's own neighbours.

        These are farther off than those among all rows, so the share reached is higher there.
        """
        q = unit[np.random.default_rng(3).choice(len(unit), min(queries, len(unit)), replace=False)]
        order, best = self.order(q)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        near = np.concatenate([self.closest(q[i : i + 256], unit, k + 1)[:, 1:] for i in range(0, len(q), 256)])
        ranks = np.take_along_axis(place, nearest(unit, self.centroids)[near], axis=1)
        edges = np.unique(np.quantile(best, np.arange(1, BINS) / BINS))
        kind = np.searchsorted(edges, best)
        return edges, np.array([self.bound(np.sort(ranks[kind == b], axis=None)) for b in range(len(edges) + 1)])

    @staticmethod
    def closest(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """Rows of the k vectors nearest to each query, nearest first."""
        score = q @ x.T
        some = np.argpartition(-score, min(k, len(x)) - 1, axis=1)[:, :k]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, axis=1), axis=1), axis=1)

    def bound(self, ranks: np.ndarray) -> int:
        """Probes that hold TARGET of the neighbours of which ranks is a sample, in rising order."""
        n = len(ranks)
        at = math.ceil(n * TARGET + OFF * math.sqrt(n * TARGET * (1 - TARGET)))
        return int(ranks[min(at, n) - 1]) + 1 if n else len(self.centroids)

    def order(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells from the nearest to the farthest, similarity to the nearest) of each query."""
        near = unit @ self.centroids.T - (self.centroids**2).sum(axis=1)[None, :] / 2
        order = np.argsort(-near, axis=1, kind="stable")
        best = self.centroids[order[:, 0]]
        return order, (unit * best).sum(axis=1) / np.maximum(np.linalg.norm(best, axis=1), 1e-12)

    def probed(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the probed cells of one query after another, how many each has)."""
        order, best = self.order(length_one(q))
        n = self.probes[np.searchsorted(self.edges, best)]
        return order[np.arange(order.shape[1])[None, :] < n[:, None]], n

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, length of what the codes leave out) of each vector."""
        unit = length_one(x)
        cell = nearest(unit, self.centroids)
        rest, codes = unit - self.centroids[cell], []
        for p, b in enumerate(self.books):
            part = slice(p * self.width, (p + 1) * self.width)
            codes.append(nearest(rest[:, part], b))
            rest[:, part] -= b[codes[-1]]
        return cell, np.stack(codes, axis=1).astype(np.uint8), np.linalg.norm(rest, axis=1)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Inner products of queries' parts with every codeword: the asymmetric tables, one a part."""
        return [q[:, p * self.width : (p + 1) * self.width] @ b.T for p, b in enumerate(self.books)]


def in_order(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis, added from the first component to the last."""
    return np.cumsum(a, axis=-1)[..., -1]


def search(index: Index, cell: int, k: int, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, off: np.ndarray, x: np.ndarray):
    """(query id, id, cosine) of each query's k nearest within one block of a cell; cosines are exact."""
    order = np.argsort(ids, kind="stable")
    ids, codes, off, x = ids[order], codes[order], off[order], x[order]
    length, unit, out = np.sqrt(in_order(x * x)), length_one(x), []
    slack = SURE * off / math.sqrt(x.shape[1])
    step, few = max(1, MATRIX // len(ids)), min(k, len(ids))
    for i in range(0, len(qid), step):
        one, v = qid[i : i + step], q[i : i + step]
        own_unit = length_one(v)
        near = np.repeat((own_unit @ index.centroids[cell])[:, None], len(ids), axis=1)
        for p, t in enumerate(index.tables(own_unit)):
            near += t[:, codes[:, p]]
        near[one[:, None] == ids[None, :]] = -np.inf
        least = np.partition(near - slack, len(ids) - few, axis=1)[:, len(ids) - few]
        near += slack
        many = (near >= least[:, None]).sum(axis=1) > RERANK
        if many.any():  # what the codes cannot tell apart is settled by the vectors
            exact = own_unit[many] @ unit.T
            near[many] = np.where(near[many] >= least[many, None], exact, -np.inf)
        some = np.argsort(-near, axis=1, kind="stable")[:, :RERANK] if len(ids) > RERANK else np.broadcast_to(np.arange(len(ids)), near.shape)
        score = np.empty(some.shape)
        for j in range(0, len(one), 64):
            part = slice(j, j + 64)
            own = v[part][:, None, :]
            score[part] = in_order(x[some[part]] * own) / (length[some[part]] * np.sqrt(in_order(own * own)))
        found = ids[some]
        score[found == one[:, None]] = -np.inf
        best = np.lexsort((found, -score), axis=1)[:, :k]
        found, score = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
        good = np.isfinite(score)
        out.append((np.broadcast_to(one[:, None], found.shape)[good], found[good], score[good]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v as doubles) of the vectors that take part: no nulls, all finite, not zero."""
    v = F.col("v")
    rows = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("v"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & good)


def nearest_neighbours(df: DataFrame, k: int = 5, every: int = 50, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest of every row whose id is divisible by ``every``.

    ``probes`` cells are searched for each query; by default as many as reach TARGET of the
    neighbours within the fitting sample of SAMPLE vectors, for queries of its kind.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do
    those of another length than most.  Ties go to the smaller id; rows with the query's own
    id are never its neighbours; repeated rows are candidates each.  Other columns are
    ignored; an empty table, or one without queries, gives an empty result.
    """
    spark = prepare(df.sparkSession)
    good = vectors(df, id_col, vec_col)
    sizes = sorted(good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect())
    answer = "query_id long, rank int, `" + id_col + "` long, score double"
    if not sizes:
        return spark.createDataFrame([], answer)
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    good = good.filter(F.size("v") == dim)
    sample = good.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, math.ceil(1e6 * min(1.0, SAMPLE / total)))).select("v").toArrow()
    if not sample.num_rows:
        sample = good.orderBy("id").limit(CODES).select("v").toArrow()
    fitted = np.array(sample.column("v").combine_chunks().flatten()).reshape(-1, dim)
    fitted = fitted[np.lexsort(fitted.T)]  # the same order, however rows are spread over files
    shared = spark.sparkContext.broadcast(Index(fitted, total, -(-total // every), probes))

    def matrix(column: pa.Array) -> np.ndarray:
        return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)

    def packed(a: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in a], pa.binary())

    def mixed(ids: np.ndarray) -> np.ndarray:
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)

    def dealt(cell: np.ndarray, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, i, j): a row's own block of its cell, by its id, with every block of the other side."""
        blocks = index_of().blocks
        mine = (mixed(ids) % blocks[own, cell].astype(np.uint64)).astype(np.int32)
        times = blocks[1 - own, cell]
        rows = np.repeat(np.arange(len(cell)), times)
        other = (np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32)
        return (rows, mine[rows], other) if own == 0 else (rows, other, mine[rows])

    def index_of() -> Index:
        return shared.value

    def place(batches):
        for b in batches:
            x, ids = matrix(b.column(1)), b.column(0).to_numpy()
            cell, codes, off = index_of().encode(x)
            rows, i, j = dealt(cell, ids, 0)
            row = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(cell[rows], pa.int32()), pa.array(i), pa.array(j), pa.array(ids[rows]), packed(codes).take(row), pa.array(off[rows]), packed(x).take(row)], names=["cell", "i", "j", "id", "codes", "off", "v"])

    def probe(batches):
        for b in batches:
            q, ids = matrix(b.column(1)), b.column(0).to_numpy()
            cells, n = index_of().probed(q)
            who = np.repeat(np.arange(len(q)), n)
            rows, i, j = dealt(cells, ids[who], 1)
            yield pa.RecordBatch.from_arrays([pa.array(cells[rows], pa.int32()), pa.array(i), pa.array(j), pa.array(ids[who[rows]]), packed(q).take(pa.array(who[rows]))], names=["cell", "i", "j", "query_id", "q"])

    left = good.mapInArrow(place, "cell int, i int, j int, id long, codes binary, off double, v binary")
    right = good.filter(F.col("id") % every == 0).mapInArrow(probe, "cell int, i int, j int, query_id long, q binary")

    def block(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        wide = lambda c, d: np.frombuffer(b"".join(c.to_pylist()), d).reshape(len(c), -1)
        one, two, score = search(index_of(), x["cell"][0].as_py(), k, q["query_id"].to_numpy(), wide(q["q"], np.float64), x["id"].to_numpy(), wide(x["codes"], np.uint8), x["off"].to_numpy(), wide(x["v"], np.float64))
        return pa.table({"query_id": pa.array(one.astype(np.int64)), "id": pa.array(two.astype(np.int64)), "score": pa.array(score.astype(np.float64))})

    found = left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInArrow(block, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
