"""Near-duplicate documents through an LSH forest over MinHash signatures.

1. Every document gets the set of its distinct five-word shingles, as 64-bit fingerprints,
   a digest of the set and a MinHash signature.  Equal sets form classes; one document of
   each class goes on, so exact copies are never paired.
2. TREES orders sort the classes by different parts of the signature.  Neighbours with a
   common prefix of BASE_DEPTH values make a region.  Regions up to REGION rows are
   compared in full; larger ones go deeper, value by value, until they fall apart, and on
   the way every row is compared with the region's most central rows (hubs) and its next
   neighbours, which joins a group of near copies without n x n pairs.  A region that holds
   much of the table is dealt to several tasks.
3. Candidates are confirmed on full sets in two rounds: first each document's likeliest
   partners, then all candidates that still join different components.
4. Hubs and neighbours are only the short way.  Larger regions that share rows make clusters,
   and clusters that are not one component by then are compared in full on their sets, block
   against block, apart from pairs of one component; a task of two blocks returns only links
   that join what was apart.  So a link is missed only where two documents share no region.
5. Components spread by smallest id with pointer jumping, in tables of the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, prepare, shared_dir, stored

SHINGLE = 5
SIGNATURE = 128
TREES, BASE_DEPTH, DEPTH = 24, 2, 8
REGION, HUBS, CHUNK = 48, 4, 4096
#: Rows and shingles of a block, by expectation; columns of a matrix product.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 4096
#: Estimated similarity from which a candidate is confirmed: 7.6 standard errors of the sketch below 0.75.
LIKELY = 0.40
SALTS = 8
#: Rounds of labels; paths halve in each, so a few dozen are enough for any table.
ROUNDS = 200
#: Rows of a region from which it is dealt to several tasks, at least; never under a thousandth of all rows, so that few regions are.
HOT, SAMPLED = 200_000, 64
BLOCK_WORDS = 1 << 17

_rng = np.random.default_rng(20240101)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MUL = _rng.integers(1, 1 << 32, SIGNATURE, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint64).astype(np.uint32)
PAIRS_OF_BITS = np.uint64(0x5555555555555555)

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, INVERSE))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the five-word shingles of a whole text."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    out = []
    for i in range(0, max(1, len(w) - SHINGLE + 1), BLOCK_WORDS):
        part = w[i : i + BLOCK_WORDS + SHINGLE - 1]
        size = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        if len(part) >= SHINGLE:
            starts, ends = starts[: len(part) - SHINGLE + 1], ends[SHINGLE - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        line = np.frombuffer(b" ".join(part), np.uint8)
        up, down = powers(len(line) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[line] * up[: len(line)])])
        out.append(mix((total[ends] - total[starts]) * down[starts]))
    return np.unique(np.concatenate(out))


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    sig = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(sig, (MUL[:, None] * x[None, i : i + 2048] + ADD[:, None]).min(axis=1), out=sig)
    return sig


def fixed(a: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of equal widths as a byte matrix."""
    return np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(len(a), width)


def binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows.tobytes())])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, sig) of every row; rows without words have n = 0."""

    def run(batches):
        for b in batches:
            n, digests, sigs = [], [], np.empty((b.num_rows, SIGNATURE), np.uint32)
            for k, t in enumerate(b.column(1)):
                s = shingles(t.as_py())
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs[k] = signature(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), binary(sigs)], names=["id", "n", "digest", "sig"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col]).mapInArrow(run, "id long, n long, digest binary, sig binary")


def orders(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: the region's key, then the deeper values and a two-bit sketch to compare by."""

    def run(batches):
        turn = (np.arange(TREES)[:, None] * (SIGNATURE // TREES) + np.arange(DEPTH)[None, :]) % SIGNATURE
        for b in batches:
            sig = fixed(b.column(1), SIGNATURE * 4).view(np.uint32)
            two = (mix(sig.astype(np.uint64)) & np.uint64(3)).astype(np.uint8)
            sketch = two[:, 0::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6
            for t in range(TREES):
                values = sig[:, turn[t]].astype(np.uint64)
                key = (values[:, 0] << np.uint64(32) | values[:, 1]).view(np.int64)
                deep = np.ascontiguousarray(values[:, BASE_DEPTH:], np.uint64).astype(np.uint16, order="C").view(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), pa.array(key), b.column(0), binary(np.hstack([deep, sketch]))], names=["tree", "key", "id", "row"])

    return classes.select("id", "sig").mapInArrow(run, "tree int, key long, id long, row binary")


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches (last axis: four words)."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & PAIRS_OF_BITS).sum(axis=-1)
    return (1 - differ / SIGNATURE - 0.25) / 0.75


class Regions:
    """Walks sorted rows and gives candidate pairs of row numbers."""

    def __init__(self, deep: np.ndarray, sketch: np.ndarray):
        self.deep, self.sketch, self.found = deep, sketch, []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            s = alike(self.sketch[i], self.sketch[j])
            ok = s >= LIKELY
            self.found.append((i[ok], j[ok], s[ok]))

    def small(self, first: np.ndarray, size: np.ndarray) -> None:
        """All pairs of many regions of up to REGION rows, by distance."""
        group = np.repeat(np.arange(len(first)), size)
        rows = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(group))
        for d in range(1, int(size.max(initial=1))):
            if len(group) <= d:
                break
            same = group[d:] == group[:-d]
            self.add(rows[:-d][same], rows[d:][same])

    def large(self, first: int, size: int, depth: int = 0) -> np.ndarray:
        """Hubs, neighbours, then the regions one value deeper; returns the hubs."""
        rows = np.arange(first, first + size)
        bits = np.unpackbits(self.sketch[rows].view(np.uint8), axis=1)
        middle = np.packbits(bits.mean(axis=0) > 0.5).view(np.uint64)
        hubs = rows[np.argsort(-alike(self.sketch[rows], middle[None, :]), kind="stable")[: HUBS if depth == 0 else 1]]
        for h in hubs:
            self.add(np.full(size - 1, h), rows[rows != h])
        self.add(rows[:-1], rows[1:])
        if depth < self.deep.shape[1]:
            cut = np.flatnonzero(np.concatenate([[True], self.deep[rows[1:], depth] != self.deep[rows[:-1], depth]]))
            sizes = np.diff(np.append(cut, size))
            some = (sizes > 1) & (sizes <= REGION)
            self.small(first + cut[some], sizes[some])
            for c, n in zip(cut[sizes > REGION], sizes[sizes > REGION]):
                self.large(first + int(c), int(n), depth + 1)
        return hubs


def hot_regions(classes: DataFrame) -> DataFrame:
    """(tree, key, parts, centre) of regions with very many rows, found in one row of SAMPLED; only the way of dealing hangs on it.

    At most TREES x 1000 of them: a region counts from a thousandth of all rows on.
    """
    least = max(HOT, classes.count() // 1000)
    some = orders(classes.filter(F.pmod(F.xxhash64("id", F.lit("hot")), F.lit(SAMPLED)) == 0))
    counted = some.groupBy("tree", "key").agg((F.count("*") * SAMPLED).alias("n"), F.min("id").alias("centre"))
    return counted.filter(F.col("n") >= least).select("tree", "key", F.ceil(F.col("n") / (least / 2)).alias("parts"), "centre")


def candidates(forest: DataFrame, hot: DataFrame) -> DataFrame:
    """Distinct pairs (a < b): candidates with their estimated similarity s, and stars (large) around the smallest id of each region over REGION, where s may be -1."""
    parted = forest.join(F.broadcast(hot), ["tree", "key"], "left").select("tree", "key", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), "parts")).otherwise(0).alias("part"), "id", "row", F.coalesce("centre", "id").alias("centre"))
    dealt = parted.repartition("tree", "key", "part").sortWithinPartitions("tree", "key", "part", "row", "id")
    wide = 2 * (DEPTH - BASE_DEPTH)

    def pairs(key, ids, rows, centres, hubs, first):
        """Candidates of whole regions, or of one stretch of a large region and the hubs and the smallest id of its earlier ones.

        centres: of rows of a region dealt to several tasks one common row, of others the row itself.
        """
        walk = Regions(np.ascontiguousarray(rows[:, :wide]).view(np.uint16), np.ascontiguousarray(rows[:, wide:]).view(np.uint64))
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(cut, len(key)))
        some = (sizes > 1) & (sizes <= REGION)
        walk.small(cut[some], sizes[some])
        last, middle = None, {}
        for c, n in zip(cut[sizes > REGION], sizes[sizes > REGION]):
            last = (int(c), walk.large(int(c), int(n)))
            middle[last[0]] = last[1]
        out = [(ids[i], ids[j], s) for i, j, s in walk.found]
        for hub, sketch in hubs:
            s = alike(walk.sketch[: sizes[0]], sketch[None, :])
            ok = np.flatnonzero(s >= LIKELY)
            out.append((np.full(len(ok), hub), ids[ok], s[ok]))
        if last and last[0] == cut[-1]:
            own = [(ids[h], walk.sketch[h]) for h in last[1]]
        else:
            own = []
        given = np.flatnonzero(centres != ids)
        shared = dict(zip(cut[np.searchsorted(cut, given, side="right") - 1].tolist(), centres[given].tolist()))
        for c, centre in shared.items():  # the central rows of each part and the common row are candidates too
            h = ids[middle.get(c, [c])]
            out.append((h, np.full(len(h), centre), np.full(len(h), LIKELY)))
        a, b, s = (np.concatenate([x[k] for x in out]) if out else np.zeros(0) for k in range(3))
        low, high = np.minimum(a, b), np.maximum(a, b)
        keep = low != high
        _, once = np.unique(low.astype(np.int64) * np.int64(0x2545F4914F6CDD1D) + high.astype(np.int64), return_index=True)  # other depths find the same pairs
        keep = once[keep[once]]
        stars = [(low[keep].astype(np.int64), high[keep].astype(np.int64))]
        for c, n in zip(cut, sizes):
            if n > REGION or c in shared or c == 0 and first is not None:
                part = ids[c : c + n] if c or first is None else np.append(ids[:n], first)
                least = part.min()
                others = part[part != least]
                stars.append((np.full(len(others), least), others))
                if c in shared and shared[c] != least:
                    stars.append((np.array([min(least, shared[c])]), np.array([max(least, shared[c])])))
        a, b = (np.concatenate([x[k] for x in stars]) for k in range(2))
        s = np.concatenate([s[keep].astype(np.float64), np.full(len(a) - len(keep), -1.0)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array(np.arange(len(a)) >= len(keep))], names=["a", "b", "s", "large"]), own

    def run(batches):
        held, hubs, first = None, [], None
        for b in batches:
            tree = b.column(0).to_numpy().astype(np.int64)
            new = np.stack([tree, b.column(1).to_numpy(), b.column(2).to_numpy()], axis=1), b.column(3).to_numpy(), fixed(b.column(4), wide + SIGNATURE // 4), b.column(5).to_numpy()
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            while len(held[1]) > CHUNK:
                key = held[0]
                change = np.flatnonzero((key[1 : CHUNK + 1] != key[:CHUNK]).any(axis=1))
                whole = len(change) > 0  # the stretch ends where a region does, if one ends in it
                n = int(change[-1]) + 1 if whole else CHUNK
                code = np.cumsum(np.concatenate([[0], (key[1:n] != key[: n - 1]).any(axis=1)]))
                out, own = pairs(code, *(x[:n] for x in held[1:]), hubs, first)
                hubs = [] if whole else (hubs + own)[: 4 * HUBS]  # a short way only: the region is compared in full later
                first = None if whole else min(held[1][:n].min(), held[1][0] if first is None else first)
                held = tuple(x[n:] for x in held)
                if out.num_rows:
                    yield out
        if held is not None and len(held[1]):
            code = np.cumsum(np.concatenate([[0], (held[0][1:] != held[0][:-1]).any(axis=1)]))
            out, _ = pairs(code, *held[1:], hubs, first)
            if out.num_rows:
                yield out

    return dealt.mapInArrow(run, "a long, b long, s double, large boolean").groupBy("a", "b").agg(F.max("s").alias("s"), F.max("large").alias("large"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 x intersection >= percent x union."""
    right = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    ok[k] = 100 * both >= percent * (len(x) + len(y) - both)
            chosen = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(chosen), b.column(1).filter(chosen)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def common(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets x with sets y, or with each other where y is None (upper triangle).

    Elements of many sets are counted by matrix products, the others pair by pair.
    """
    sets, n = x + (y or []), len(x)
    first, width = (n, len(y)) if y is not None else (0, n)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    much = max(16, len(sets) // 32)
    out = np.zeros(n * width, np.int64)
    column = np.cumsum(often >= much) - 1
    dense = np.flatnonzero(often[code] >= much)
    dense = dense[np.argsort(column[code[dense]], kind="stable")]
    at = column[code[dense]]
    columns = int((often >= much).sum())
    for c in range(0, columns, COLUMNS):
        part = slice(*np.searchsorted(at, [c, c + COLUMNS]))
        m = np.zeros((len(sets), min(COLUMNS, columns - c)), np.float32)
        m[owner[dense[part]], at[part] - c] = 1
        out += (m[:n] @ m[first:].T).astype(np.int64).ravel()
    rare = np.flatnonzero((often[code] > 1) & (often[code] < much))
    rare = rare[np.argsort(code[rare], kind="stable")]
    value, row = code[rare], owner[rare]
    for d in range(1, much - 1):
        same = value[d:] == value[:-d]
        if not same.any():
            break
        i, j = row[:-d][same], row[d:][same]
        across = (i < n) & (j >= first)
        out += np.bincount(i[across] * width + j[across] - first, minlength=n * width)
    return out.reshape(n, width)


def joins(x: tuple[list, list, list], y: tuple[list, list, list] | None, percent: int) -> list[tuple[int, int]]:
    """Links between (ids, labels, sets) x and y, or within x where y is None: as many as join all labels that links join."""
    right = y or x
    n, m = (np.array([len(s) for s in side[2]], np.int64) for side in (x, right))
    both = common(x[2], y and y[2])
    ok = 100 * both >= percent * (n[:, None] + m[None, :] - both)
    ok &= np.array(x[1])[:, None] != np.array(right[1])[None, :]
    root = {}

    def find(k):
        while k in root:
            k = root[k]
        return k

    out = []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(ok, 1) if y is None else ok))):
        a, b = find(x[1][i]), find(right[1][j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((min(x[0][i], right[0][j]), max(x[0][i], right[0][j])))
    return out


def cluster_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between rows (cluster, id, n, label) of one cluster and different labels, as many as join all labels that links join.

    Rows of like sizes, and of one label if it has many, are dealt to blocks by a hash; each two blocks of a cluster whose sizes
    allow a link and that are not of one label are a task's work.
    """
    apart = rows.groupBy("cluster").agg((F.min("label") < F.max("label")).alias("apart")).filter("apart").select("cluster")
    rows = rows.join(apart, "cluster", "left_semi")
    heavy = rows.groupBy("cluster", "label").count().filter(F.col("count") >= BLOCK_ROWS).select("cluster", "label", F.lit(True).alias("heavy"))
    group = F.xxhash64("cluster", F.when(F.col("heavy"), F.col("label")), F.floor(7 * F.log("n")))
    rows = rows.join(heavy, ["cluster", "label"], "left").select("cluster", "id", "n", "label", group.alias("group"))
    parts = rows.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    rows = rows.join(parts, "group").withColumn("block", F.xxhash64("group", F.pmod(F.xxhash64("id"), "parts"))).drop("group", "parts")
    blocks = rows.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("low"), F.max("label").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    sizes = (100 * F.col("x.most") >= percent * F.col("y.least")) & (100 * F.col("y.most") >= percent * F.col("x.least"))
    labels = F.least("x.low", "y.low") < F.greatest("x.high", "y.high")
    two = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block")) & sizes & labels)
    work = two.select(F.col("x.cluster").alias("cluster"), F.xxhash64("x.cluster", "x.block", "y.block").alias("task"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
    spread = rows.join(work, ["cluster", "block"]).select("id", "task", "block", "label").join(sets, "id")
    dealt = spread.select("task", "block", "id", "label", "set").repartition("task").sortWithinPartitions("task", "block")

    def run(batches):
        def links(held):
            sides = list(held.values())
            found = joins(sides[0], sides[1] if len(sides) > 1 else None, percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["a", "b"])

        task, held = None, {}
        for b in batches:
            for t, block, i, label, s in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4)):
                if t != task and held:
                    yield links(held)
                    held = {}
                task = t
                ids, labels, own = held.setdefault(block, ([], [], []))
                ids.append(i)
                labels.append(label)
                own.append(np.frombuffer(s.as_py(), np.uint64))
        if held:
            yield links(held)

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, where: str, name: str) -> DataFrame:
    """(node, label): the smallest node reachable over the edges (a, b), for every node that has one.

    Each round takes the smallest label around every node and then the label's label, so
    paths halve; rounds end when nothing changes, far below ROUNDS, and raise beyond.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), where, f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), where, f"{name}-0")
    for k in range(1, ROUNDS):
        near = both.join(labels.withColumnsRenamed({"node": "b", "label": "other"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "other").alias("to"))
        parent = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        new = stored(hooked.join(parent, "to", "left").select("node", F.least("to", "next").alias("label"), (F.least("to", "next") != F.col("label")).alias("changed")), where, f"{name}-{k}")
        labels = new.select("node", "label")
        drop_stored(both.sparkSession, f"{where}/{name}-{k - 1}")
        if not new.filter("changed").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {ROUNDS} rounds")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links) and kept of every row.

    Links join documents whose shingle sets have 100 x intersection >= percent x union;
    texts under five words are one shingle; null, empty and blank texts have none and link
    with nothing.  Rows with the same id are one document of the links.  A null id has no
    component and is kept.  Extra columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    where = shared_dir(spark)
    prints = stored(fingerprints(docs, id_col, text_col), where, "prints")
    known = prints.filter("n > 0 AND id IS NOT NULL")
    classes = stored(known.groupBy("digest").agg(F.min_by("sig", "id").alias("sig"), F.min("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("copies")), where, "classes")
    near = stored(candidates(orders(classes), hot_regions(classes)), where, "pairs")

    nodes = near.select(F.explode(F.array("a", "b")).alias("__node")).distinct().hint("merge")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).join(nodes, F.col("id") == F.col("__node"), "left_semi")

    def sets_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["id", "set"])

    sets = stored(texts.mapInArrow(sets_of, "id long, set binary"), where, "sets")
    pairs = near.filter("s >= 0")
    likely = pairs.groupBy("b").agg(F.min("a").alias("x"), F.max_by("a", "s").alias("y"))
    first = likely.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b")
    one = stored(confirm(first, sets, percent), where, "links-1")
    found = components(one, where, "first")
    label = {c: found.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"}
    apart = pairs.join(label["a"], "a", "left").join(label["b"], "b", "left").withColumns({f"l{c}": F.coalesce(f"l{c}", c) for c in "ab"}).filter("la <> lb")
    two = stored(confirm(apart, sets, percent), where, "links-2")
    final = components(one.union(two), where, "candidates")
    centres = stored(near.filter("large").groupBy(F.col("b").alias("id")).agg(F.collect_set("a").alias("centres")), where, "centres")
    met = centres.select("centres").distinct().select(F.array_min("centres").alias("a"), F.explode("centres").alias("b")).filter("a < b")
    merged = components(met, where, "clusters").withColumnsRenamed({"node": "centre", "label": "cluster"})
    held = centres.select("id", F.array_min("centres").alias("centre")).union(near.filter("large").select(F.col("a").alias("id"), F.col("a").alias("centre")).distinct())
    clusters = held.join(merged, "centre", "left").select("id", F.coalesce("cluster", "centre").alias("cluster")).distinct()
    named = clusters.join(final.withColumnRenamed("node", "id"), "id", "left").join(classes.select("id", "n"), "id")
    rows = stored(named.select("cluster", "id", "n", F.coalesce("label", "id").alias("label")), where, "rows")
    three = stored(cluster_links(rows, sets, percent), where, "links-3")
    if three.limit(1).count():
        final = components(one.union(two).union(three), where, "all")

    moved = classes.join(final, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("label", "id").alias("component"), (F.col("label").isNotNull() | (F.col("copies") > 1)).alias("linked")).filter("linked").drop("linked")
    salted = moved.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"digest": "d", "salt": "s"})
    rows = prints.select("id", "n", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = rows.join(salted, (rows.digest == salted.d) & (rows.salt == salted.s) & rows.id.isNotNull(), "left")
    component = F.coalesce("component", "id")
    result = joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))
    kept = stored(result, f"{where}-result", "near_duplicates")
    drop_stored(spark, where)  # only the small result stays, for the cluster's cleaner
    return kept
