"""Quality by co-training.

Two logistic classifiers see different views: the text's content (byte frequencies, words,
lines) and the page's metadata (language, source, size).  They start from labelled rows.
Over some rounds each hands the rows it is sure of, from the whole table, to the other as
pseudo-labelled ones: a round is one pass that scores every row under both views and adds up
the gradients of those rows, from which the driver takes a Newton step.  Both are then
calibrated on labelled rows that neither was fitted on, and the calibrated views are combined.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, with_kept
from .toxicity import logistic, training_sample

META = ("lang", "source", "n_chars")
LANGS, SOURCES, SIZES = 16, 64, 24
#: Buckets of a text's words.
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
CONTENT, METADATA = 256 + 5 + BUCKETS, LANGS + SOURCES + SIZES
#: Gradients are added up as whole numbers of this unit, so that their order does not matter.
UNIT = 1 << 20


#: Bytes of texts that are looked at side by side; a longer text goes in pieces, cut between words.
PIECE = 1 << 20
SPACE, LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER[65:91] += 32
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE = np.random.default_rng(20240303).integers(1, 1 << 63, 256, dtype=np.uint64)
POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(1023, HASH_BASE, np.uint64))])


def word_counts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces side by side: bytes by value, words by bucket, and (piece, hash) of their distinct words."""
    size = np.array([len(r) for r in raws], np.int64)
    flat = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    owner = np.repeat(np.arange(len(raws)), size + 1)
    spread = np.bincount(owner * 256 + flat, minlength=256 * len(raws)).reshape(-1, 256)
    spread[:, 32] -= 1  # the space between pieces
    gap = SPACE[flat]
    word = ~gap
    first = np.flatnonzero(word & np.concatenate([[True], gap[:-1]]))
    length = np.flatnonzero(gap & np.concatenate([[False], word[:-1]])) - first
    if not len(first):
        return spread, np.zeros((len(raws), BUCKETS)), np.zeros((0, 2), np.uint64)
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    terms = BYTE[LOWER[flat[np.repeat(first, length) + place]]] * POWERS[place % len(POWERS)] + place.astype(np.uint64) // np.uint64(len(POWERS))
    h = np.add.reduceat(terms, np.cumsum(length) - length)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    of = owner[first]
    pairs = np.unique(h ^ of.astype(np.uint64) * HASH_BASE, return_index=True)[1]
    return spread, np.bincount(of * BUCKETS + bucket, minlength=BUCKETS * len(raws)).reshape(-1, BUCKETS).astype(float), np.stack([of[pairs].astype(np.uint64), h[pairs]], axis=1)


def pieces_of(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while len(raw) - at > PIECE:
        cut = max(raw.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t"))
        end = cut if cut > at else at + PIECE
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def content_views(texts: list[str | None]) -> np.ndarray:
    """A row of features a text: shares of bytes, five counts, shares of words by bucket."""
    raws = [(t or "").encode() for t in texts]
    spread, buckets, distinct = np.zeros((len(raws), 256)), np.zeros((len(raws), BUCKETS)), np.zeros(len(raws))
    start = size = 0
    for k, raw in enumerate(raws):
        size += len(raw)
        if size > PIECE or k == len(raws) - 1:
            group, rows = [], []
            for j in range(start, k + 1):
                parts = [raws[j]] if len(raws[j]) <= PIECE else pieces_of(raws[j])
                group += parts
                rows += [j] * len(parts)
            seen: dict[int, list] = {}
            while group:
                n = max(1, int(np.searchsorted(np.cumsum([len(g) for g in group]), 2 * PIECE)))
                one, two, words = word_counts(group[:n])
                np.add.at(spread, rows[:n], one)
                np.add.at(buckets, rows[:n], two)
                row = np.array(rows[:n])[words[:, 0].astype(np.int64)]
                if len(set(rows)) == len(rows):
                    distinct += np.bincount(row, minlength=len(raws))
                else:
                    for j in set(row.tolist()):
                        seen.setdefault(j, []).append(words[row == j, 1])
                group, rows = group[n:], rows[n:]
            for j, hashes in seen.items():
                distinct[j] = len(np.unique(np.concatenate(hashes)))
            start, size = k + 1, 0
    n, total = np.array([len(r) for r in raws], float), buckets.sum(axis=1)
    lines = [[x for x in r.split(b"\n") if x.strip()] for r in raws]
    n_lines, own_lines = (np.array([len(x) for x in side], float) for side in (lines, [set(x) for x in lines]))
    counts = [np.log1p(total) / 10, n / (total + 1) / 20, distinct / (total + 1), own_lines / (n_lines + 1), np.log1p(n / (n_lines + 1)) / 10]
    return np.hstack([np.log1p(1000 * spread / np.maximum(n, 1)[:, None]) / 5, np.stack(counts, axis=1), np.sqrt(buckets / np.maximum(total, 1)[:, None])])


def content_view(text: str | None) -> np.ndarray:
    return content_views([text])[0]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANGS + SOURCES + SIZES)
    out[zlib.crc32(str(lang).encode()) % LANGS] = 1
    out[LANGS + zlib.crc32(str(source).encode()) % SOURCES] = 1
    size = SIZES - 1 if n_chars is None else min(SIZES - 2, int(math.log2(max(0, n_chars) + 1)))
    out[LANGS + SOURCES + size] = 1
    return out


def margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(w[0] + x @ w[1:], -30, 30)


class CoTrained:
    def __init__(self, views: tuple[np.ndarray, np.ndarray], scales: tuple[np.ndarray, np.ndarray], weights: np.ndarray):
        self.views, self.scales, self.weights = views, scales, weights

    def calibrated(self, k: int, x: np.ndarray) -> np.ndarray:
        return margin(self.scales[k], margin(self.views[k], x)[:, None])

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, content, metadata) probabilities of good quality."""
        one, two = self.calibrated(0, content), self.calibrated(1, metadata)
        both = margin(self.weights, np.stack([one, two], axis=1))
        return tuple(1 / (1 + np.exp(-z)) for z in (both, one, two))


def sure_rows(views: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], sure: float) -> list[tuple[int, int, int, np.ndarray]]:
    """(view, label, rows, gradient of the view's likelihood) over the rows of which the other view is sure."""
    p = [1 / (1 + np.exp(-margin(views[k], x[k]))) for k in (0, 1)]
    out = []
    for k in (0, 1):
        for label in (0, 1):
            rows = np.flatnonzero((p[1 - k] if label else 1 - p[1 - k]) >= sure)
            left = label - p[k][rows]
            out.append((k, label, len(rows), np.concatenate([[left.sum()], left @ x[k][rows]])))
    return out


def newton_step(w: np.ndarray, x: np.ndarray, y: np.ndarray, pseudo: dict[int, tuple[int, np.ndarray]], weight: float, l2: float = 1.0) -> np.ndarray:
    """w after a step on labelled rows and, for each label, pseudo-labelled ones of at most ``weight`` times as many."""
    a = np.hstack([np.ones((len(x), 1)), x])
    p = 1 / (1 + np.exp(-margin(w, x)))
    gradient, mass = a.T @ (y - p) - l2 * w, float(len(y))
    for label, (n, g) in pseudo.items():
        if n:
            most = min(float(n), weight * float((y == label).sum()))
            gradient, mass = gradient + g * (most / n), mass + most
    h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a * (mass / len(y)) + l2 * np.eye(len(w))
    return w + np.linalg.solve(h, gradient)


def fit(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, aside: np.ndarray, pool: Callable, rounds: int = 2, weight: float = 0.5) -> CoTrained:
    """Co-train on rows (x, y) that are not aside and on the pool; calibrate on those aside.

    pool(views) gives {(view, label): (rows, gradient)} over all unlabelled rows.
    """
    if len(y) == 0 or y.min() == y.max() or len(set(y[~aside])) < 2:  # nothing to tell apart: everything gets the base rate, good without labels
        rate = (y.sum() + 1.0) / (len(y) + 1.5)
        flat = np.array([math.log(rate / (1 - rate)), 0.0, 0.0])
        return CoTrained(tuple(np.zeros(v.shape[1] + 1) for v in x), (np.zeros(2), np.zeros(2)), flat)
    own, marks = tuple(v[~aside] for v in x), y[~aside]
    views = tuple(logistic(v, marks, l2=1.0) for v in own)
    for _ in range(rounds):
        found = pool(views)
        views = tuple(newton_step(views[k], own[k], marks, {label: found[k, label] for label in (0, 1) if (k, label) in found}, weight) for k in (0, 1))
    test = aside if len(set(y[aside])) == 2 else np.ones(len(y), bool)
    scales = tuple(logistic(margin(views[k], x[k][test])[:, None], y[test], l2=1.0) for k in (0, 1))
    model = CoTrained(views, scales, np.zeros(3))
    model.weights = logistic(np.stack([model.calibrated(k, x[k][test]) for k in (0, 1)], axis=1), y[test], l2=1.0)
    return model


def stacked(rows: list[np.ndarray], width: int) -> np.ndarray:
    return np.array(rows) if rows else np.zeros((0, width))


def with_meta(docs: DataFrame) -> DataFrame:
    """docs with null metadata where a column is missing."""
    return docs.withColumns({c: F.lit(None).cast("string") for c in META if c not in docs.columns})


def pool_gradients(docs: DataFrame, known: set, views: tuple[np.ndarray, np.ndarray], sure: float, id_col: str, text_col: str) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """sure_rows() over all rows of docs whose id is not in known: one pass, of which a few sums a partition are left."""
    shared = docs.sparkSession.sparkContext.broadcast((views, known))

    def run(batches):
        views, known = shared.value
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            free = [k for k, i in enumerate(b.column(0).to_pylist()) if i not in known]
            b = b.take(pa.array(free, pa.int64()))
            if b.num_rows:
                x = content_views(b.column(1).to_pylist()), stacked([metadata_view(*m) for m in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))], METADATA)
                for k, label, n, g in sure_rows(views, x, sure):
                    sums = total.setdefault((k, label), [0, np.zeros(len(g), np.int64)])
                    sums[0] += n
                    sums[1] += np.rint(g * UNIT).astype(np.int64)
        for (k, label), (n, g) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([label], pa.int32()), pa.array([[n, *g.tolist()]], pa.list_(pa.int64()))], names=["view", "label", "sums"])

    sums = docs.select(docs[id_col], docs[text_col], *[docs[c] for c in META]).mapInArrow(run, "view int, label int, sums array<long>")
    rows = sums.select("view", "label", F.posexplode("sums").alias("at", "s")).groupBy("view", "label", "at").agg(F.sum("s").alias("s")).collect()  # a number a weight, however many rows
    out = {}
    for k, label in {(r.view, r.label) for r in rows}:
        s = np.array([r.s for r in sorted((r for r in rows if (r.view, r.label) == (k, label)), key=lambda r: r["at"])], np.float64)
        out[k, label] = int(s[0]), s[1:] / UNIT
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, rounds: int = 2, sure: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> CoTrained:
    """Fit on a bounded sample of labelled rows (max_rows, a parameter, drawn by a hash of the id) and on all other rows of docs.

    As for toxicity, labels of held-out rows are never learnt from.  Null texts count as empty,
    null or missing metadata as a value of its own; without labels of two classes every
    document gets the base rate, good if there are none; an empty table trains that too.
    """
    docs = with_meta(docs)
    y, views, names = [], ([], []), []
    sample = training_sample(docs, labels, "quality", max_rows, id_col, [text_col, *META])
    for r in sample.toLocalIterator():
        names.append(r[0])
        views[0].append(content_view(r[1]))
        views[1].append(metadata_view(*r[2:5]))
        y.append(float(r[5]))
    aside = np.array([zlib.crc32(f"aside {n}".encode()) % 4 == 0 for n in names], bool)
    pool = lambda w: pool_gradients(docs, set(names), w, sure, id_col, text_col)
    return fit((stacked(views[0], CONTENT), stacked(views[1], METADATA)), np.array(y), aside, pool, rounds)


def score_quality(docs: DataFrame, model: CoTrained, threshold: float = 0.5, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """score, content_score, metadata_score and predicted (1: good) of every row.

    Whole texts are read.  Null texts count as empty and null or missing metadata as a value of
    their own; repeated rows and null ids are scored row by row; other columns pass through
    ``keep``, whatever their names; an empty table gives no rows.
    """
    docs = with_meta(docs)
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    keep = [id_col] if keep is None else keep

    def run(batches):
        model = shared.value
        for b in batches:
            meta = [b.column(f"__{c}").to_pylist() for c in META]
            content = content_views(b.column("__text").to_pylist()) if b.num_rows else np.zeros((0, CONTENT))
            scores = model.scores(content, stacked([metadata_view(*m) for m in zip(*meta)], METADATA)) if b.num_rows else (np.zeros(0),) * 3
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + [pa.array(s, pa.float64()) for s in scores] + [pa.array((scores[0] >= threshold).astype(np.int32), pa.int32())], names=[*keep, "score", "content_score", "metadata_score", "predicted"])

    chosen = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text"), *[docs[c].alias(f"__{c}") for c in META])
    return chosen.mapInArrow(run, with_kept(docs, keep, "score double, content_score double, metadata_score double, predicted int"))
