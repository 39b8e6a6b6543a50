"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

The vocabulary comes from a public model; nothing is trained.  A piece of merge rank r (the
model's score is -r) has weight (r + 1) ** -alpha.  No piece of the model crosses the border
before a word's spaces, so a text's lattice falls apart there; a long run without spaces (a
sentence of Chinese or Thai, an address, base64) is cut at the borders that no piece found
in it crosses, which is exact too.  Forward sums are computed once per distinct unit; the
backward draws run over all units of a batch side by side.  A unit that stays long is
filtered forward in blocks of which only the last sums are kept, and worked out again block
by block on the way back, so memory is bounded by a block.

A draw depends on the seed, the row's key and the place of the unit alone, and cumulated
probabilities are whole numbers, so the same row always gets the same pieces, however rows
are batched and wherever a unit lies in a worker's memory.

Ids stand as little-endian 16-bit numbers in a binary column.  Decoding is lossless:
characters without a piece, and literal word markers, go through byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_stamp, prepare, with_kept

MARK = "▁"
CACHE_UNITS = 180_000
#: Numbers of a lattice array that is filtered at once.
LATTICE = 400_000
#: Weights are multiplied by this for each character, which leaves the distribution and keeps sums in range.
PER_CHAR = 300.0
#: Cumulated probabilities are whole numbers below 2 ** BITS, under the number of their node.
BITS = 36
TABLE_BITS = 18
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Units over this are cut at free borders; what stays longer is drawn block by block.
LONG, BLOCK = 64, 4096
#: Characters of a long run that are looked up at once, and units drawn at once.
RUN, DRAWN = 1 << 16, 1 << 17
#: A word with the spaces before it, spaces at a line's end, or a line feed (which no piece holds).
UNIT = re.compile(" *[^ \\n]+|\\n| +")


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[bytes] = []
        self.weight: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.text.append(b"")
            else:
                self.text.append(piece.replace(MARK, " ").encode())
                self.weight[piece.replace(MARK, " ")] = (max(1.0, -p.get_score(i) + 1) ** -alpha if p.get_score(i) > -1e8 else 1e-6, i)
        self.longest = max(map(len, self.weight), default=1)
        if len(self.bytes) < 256 or len(self.text) > 65536:
            raise ValueError("a model of up to 65,536 pieces with all byte pieces is needed")
        if any("\n" in t or re.search("[^ ] ", t) for t in self.weight):
            raise ValueError("pieces must not reach over the border before a word")


class Sampler:
    """Lattices of distinct units in flat arrays, built for all new units of a length at once.

    Node k of a unit is the border after its k-th character; its incoming edges lie in
    rising order of cumulated probability, as global key node + probability.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        pieces = sorted((self.hash_of(np.array([[ord(c) for c in text]], np.uint64))[0, -1], w, i) for text, (w, i) in vocabulary.weight.items())
        self.hashes = np.array([h for h, _, _ in pieces], np.uint64)
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("pieces with equal hashes; choose another hash base")
        self.weights, self.ids = np.array([w for _, w, _ in pieces]), np.array([i for _, _, i in pieces], np.int32)
        self.spans = sorted({len(t) for t in vocabulary.weight})
        self.tables = []
        left = np.arange(len(self.hashes))
        while len(left):  # direct addressing by multiplied hashes; pieces that collide go to the next table
            table, times = np.full(1 << TABLE_BITS, -1, np.int32), splitmix(np.array([len(self.tables)], np.uint64)) | np.uint64(1)
            slot = (self.hashes[left] * times) >> np.uint64(64 - TABLE_BITS)
            table[slot[::-1]] = left[::-1]
            self.tables.append((times, table))
            left = left[table[slot] != left]
        self.clear()

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 for none."""
        out = np.full(h.shape, -1, np.int32)
        for times, table in self.tables:
            at = table[(h * times) >> np.uint64(64 - TABLE_BITS)]
            out = np.where((at >= 0) & (self.hashes[at] == h), at, out)
        return out

    @staticmethod
    def hash_of(chars: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes of each row (prefix k of k characters)."""
        h = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
        for k in range(chars.shape[1]):
            h[:, k + 1] = h[:, k] * HASH_BASE + chars[:, k] + np.uint64(1)
        return h

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.first, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.key, self.back, self.emit = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int32)
        self.nodes = self.used = 0

    def add(self, units: list[str]) -> None:
        """Forward-filter new distinct units; the edges' arrays grow by doubling."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        firsts, lengths = [self.first], [self.length]
        for n, group in by_length.items():
            step = max(32, LATTICE // (n * len(self.spans)))
            for at in range(0, len(group), step):
                first, length, *edges = self.filter(group[at : at + step], n)
                firsts.append(first)
                lengths.append(length)
                end = self.used + len(edges[0])
                if end > len(self.key):
                    self.key, self.back, self.emit = (np.concatenate([x, np.empty(max(len(x), end - len(x)), x.dtype)]) for x in (self.key, self.back, self.emit))
                for own, new in zip((self.key, self.back, self.emit), edges):
                    own[self.used : end] = new
                self.used = end
        self.first, self.length = np.concatenate(firsts), np.concatenate(lengths)

    def edges(self, chars: np.ndarray, spans: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Weights and piece numbers by end (0 to n), span and row of equally long rows of code points."""
        m, n = chars.shape
        #: By node, span and unit; the unit last, so that every step runs over neighbouring numbers.
        weight, piece = np.zeros((n + 1, len(spans), m)), np.full((n + 1, len(spans), m), -1, np.int32)
        h = np.ascontiguousarray(self.hash_of(chars.astype(np.uint64)).T)
        for k, s in enumerate(spans):
            if s > n:
                break
            with np.errstate(over="ignore"):
                sub = h[s:] - h[: n + 1 - s] * np.uint64(pow(int(HASH_BASE), s, 1 << 64))
            at = self.lookup(sub)
            weight[s:, k] = np.where(at >= 0, self.weights[at] * PER_CHAR**s, 0.0)
            piece[s:, k] = at
        return weight, piece

    def spans_to(self, n: int) -> list[int]:
        """Lengths of pieces up to n, one character included."""
        spans = [s for s in self.spans if s <= n]
        return spans if spans[:1] == [1] else [1, *spans]

    def filter(self, units: list[str], n: int):
        m = len(units)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(m, n)
        spans = self.spans_to(n)
        weight, piece = self.edges(chars, spans)
        emit = self.ids[piece]
        total, share = np.zeros((n + 1, m)), np.zeros_like(weight)
        total[0] = 1.0
        for j in range(1, n + 1):
            for k, s in enumerate(spans):
                if s <= j:
                    weight[j, k] *= total[j - s]
            share[j] = np.cumsum(weight[j], axis=0)  # in order, whatever the number of units
            total[j] = share[j, -1]
            lost = total[j] <= 0  # no piece ends here: the character goes through its bytes
            if lost.any():
                weight[j, 0, lost] = total[j - 1, lost] * 1e-6 * PER_CHAR
                emit[j, 0, lost] = -1 - chars[lost, j - 1].astype(np.int32)
                total[j, lost] = weight[j, 0, lost]
                share[j][:, lost] = total[j, lost]
        steps = np.minimum(share / np.maximum(total, 1e-300)[:, None, :] * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
        unit, node, k = np.nonzero(np.ascontiguousarray(weight.transpose(2, 0, 1)))
        first = self.nodes + np.arange(m, dtype=np.int64) * (n + 1)
        self.nodes += m * (n + 1)
        known = len(self.code)
        self.code.update(zip(units, range(known, known + m)))
        return first, np.full(m, n, np.int32), (first[unit] + node << BITS) + steps[node, k, unit], np.array(spans, np.int8)[k], emit[node, k, unit]

    def free_units(self, run: str) -> list[str]:
        """A long run cut at every border that no piece found in it crosses."""
        n, longest = len(run), self.spans[-1]
        crossed = np.zeros(n + 1, np.int32)  # by border: pieces that start before it less those that end there
        for a in range(0, n, RUN):
            start = max(0, a - longest + 1)
            chars = np.frombuffer(run[start : a + RUN].encode("utf-32-le", "surrogatepass"), "<u4")[None, :]
            spans = self.spans_to(longest)
            piece = self.edges(chars, spans)[1][:, :, 0]
            for k, s in enumerate(spans):
                if s > 1:
                    ends = start + np.flatnonzero(piece[:, k] >= 0)
                    ends = ends[ends > a]
                    np.add.at(crossed, ends - s + 1, 1)
                    np.add.at(crossed, ends, -1)
        borders = np.flatnonzero(np.cumsum(crossed) == 0)
        return [run[a:b] for a, b in zip(borders[:-1], borders[1:])]

    def units_of(self, text: str) -> list[str]:
        """The text's units; they join to the text with a space before it."""
        out = []
        for u in UNIT.findall(" " + text) if text else []:
            if len(u) > LONG:
                out += self.free_units(u)
            else:
                out.append(u)
        return out

    def forward(self, unit: str, a: int, before: list[float], keep: bool):
        """Sums at the ends of the block from a on, given those of the characters before it; keep: also its edges."""
        longest = self.spans[-1]
        start, spans = max(0, a - longest + 1), self.spans_to(longest)
        chars = np.frombuffer(unit[start : a + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")[None, :]
        weight, piece = self.edges(chars, spans)
        weight, piece = weight[a - start + 1 :, :, 0], piece[a - start + 1 :, :, 0]
        node, k = np.nonzero(weight)
        ends = np.searchsorted(node, np.arange(len(weight)), side="right").tolist()
        k, back, w = k.tolist(), np.array(spans)[k].tolist(), weight[node, k].tolist()
        total, at, edge, nodes = list(before), len(before), 0, []
        for j, end in enumerate(ends):
            ways = [w[e] * total[at - back[e]] for e in range(edge, end)]
            here = sum(ways)
            if keep:
                nodes.append((k[edge:end] if here > 0 else [-1], ways if here > 0 else [1.0]))
            here = here or total[at - 1] * 1e-6 * PER_CHAR
            total.append(here)
            at, edge = at + 1, end
            if not 1e-200 < here < 1e200:  # sums count against each other only
                scale = 1 / here
                total[-longest:] = [t * scale for t in total[-longest:]]
        return total[-longest:], (nodes, piece, spans)

    def draw_long(self, unit: str, seed: np.uint64) -> np.ndarray:
        """Emissions of one long unit, drawn block by block from its end."""
        before, saved = [1.0], []
        for a in range(0, len(unit), BLOCK):
            saved.append(before)
            before, _ = self.forward(unit, a, before, False)
        out, pos, n = [], len(unit), 0
        for a in reversed(range(0, len(unit), BLOCK)):
            _, (nodes, piece, spans) = self.forward(unit, a, saved.pop(), True)
            with np.errstate(over="ignore"):
                draws = (splitmix(seed + np.arange(n, n + BLOCK, dtype=np.uint64) * HASH_BASE) >> np.uint64(64 - BITS)).tolist()
            used = 0
            while pos > a:
                kinds, ways = nodes[pos - a - 1]
                goal, run, chosen = draws[used] / (1 << BITS) * sum(ways), 0.0, kinds[-1]
                used += 1
                for k, w in zip(kinds, ways):
                    run += w
                    if run > goal:
                        chosen = k
                        break
                if chosen < 0:
                    out.append(-1 - ord(unit[pos - 1]))
                    pos -= 1
                else:
                    out.append(int(self.ids[piece[pos - a - 1, chosen]]))
                    pos -= spans[chosen]
            n += used
        return np.array(out[::-1], np.int32)

    def draw(self, units: list[str], draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(emissions in the order of the units, how many each unit has)."""
        long = [k for k, u in enumerate(units) if len(u) > LONG]
        if long:
            drawn = {k: self.draw_long(units[k], draw[k]) for k in long}
            short = [k for k in range(len(units)) if k not in drawn]
            ids, counts = self.draw([units[k] for k in short], draw[short]) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            parts = drawn | dict(zip(short, np.split(ids, np.cumsum(counts)[:-1])))
            return np.concatenate([parts[k] for k in range(len(units))]), np.array([len(parts[k]) for k in range(len(units))], np.int64)
        new = [u for u in dict.fromkeys(units) if u not in self.code]
        if len(self.code) + len(new) > CACHE_UNITS:
            self.clear()
            new = list(dict.fromkeys(units))
        if new:
            self.add(new)
        code = np.fromiter(map(self.code.__getitem__, units), np.int64, len(units))
        by_unit = np.argsort(code, kind="stable")  # searches then go through the lattices in order
        code, draw = code[by_unit], draw[by_unit]
        key, back, emit, first = self.key[: self.used], self.back, self.emit, self.first[code]
        node = first + self.length[code]
        live, steps = np.arange(len(code)), []
        while len(live):
            draw[live] = splitmix(draw[live])
            u = np.minimum(draw[live] >> np.uint64(64 - BITS), np.uint64((1 << BITS) - 2)).astype(np.int64)
            edge = np.searchsorted(key, (node[live] << BITS) + u, side="right")
            steps.append((by_unit[live], emit[edge]))
            node[live] -= back[edge]
            live = live[node[live] > first[live]]
        counts = np.zeros(len(code), np.int64)
        for at, _ in steps:
            counts[at] += 1
        end = np.cumsum(counts)
        ids = np.empty(int(end[-1]), np.int32)
        for k, (at, e) in enumerate(steps):
            ids[end[at] - 1 - k] = e
        return ids, counts

    def spell(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes."""
        own = np.flatnonzero(ids < 0)
        if not len(own):
            return ids, counts
        chars, which = np.unique(ids[own], return_inverse=True)
        spelt = [[self.v.bytes[x] for x in chr(-1 - int(c)).encode()] for c in chars]
        width = np.ones(len(ids), np.int64)
        width[own] = np.array([len(x) for x in spelt])[which]
        start = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(ids, width)
        for j in range(4):
            some = np.array([len(x) > j for x in spelt])[which]
            out[start[own[some]] + j] = np.array([x[j] if len(x) > j else 0 for x in spelt])[which[some]]
        return out, np.diff(start[np.concatenate([[0], np.cumsum(counts)])])

    def encode(self, texts: list[str], seeds: np.ndarray) -> list[bytes]:
        """Sampled ids of each text (16-bit little-endian)."""
        units, counts = [], []
        for t in texts:
            found = self.units_of(t)
            units += found
            counts.append(len(found))
        if not units:
            return [b""] * len(texts)
        rows = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(units)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        packed, sizes = [], []
        for i in range(0, len(units), DRAWN):
            part = slice(i, i + DRAWN)
            ids, n = self.spell(*self.draw(units[part], splitmix(seeds[rows[part]] ^ splitmix(place[part].astype(np.uint64)))))
            packed.append(ids.astype("<u2").tobytes())
            sizes.append(n)
        whole = b"".join(packed)
        borders = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[np.concatenate([[0], np.cumsum(counts)])]
        return [whole[2 * a : 2 * b] for a, b in zip(borders[:-1], borders[1:])]


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float, stamp: str) -> Vocabulary:
    return Vocabulary(path, alpha)


def sampler_of(path: str, alpha: float, stamp: str) -> Sampler:
    """A task's sampler; its lattices are freed with the task, so that workers of later stages do not hold them."""
    return Sampler(vocabulary(path, alpha, stamp))


class Decoder:
    def __init__(self, pieces: list[bytes]):
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: bytes) -> str:
        """The text, without the marker before its first word."""
        out = []
        every = np.frombuffer(ids, "<u2")
        for i in range(0, len(every), 1 << 20):
            part = every[i : i + (1 << 20)]
            size = self.size[part]
            end = np.cumsum(size)
            out.append(self.flat[np.repeat(self.start[part] - end + size, size) + np.arange(int(end[-1]))].tobytes())
        return b"".join(out).decode()[1:]


def seeds(keys: list, seed: int) -> np.ndarray:
    """Row seeds from the key's text form; a null key counts as an empty one."""
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{'' if k is None else k}".encode(), digest_size=8).digest(), "little") for k in keys], np.uint64)


def encode_texts(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """ids (16-bit little-endian) and n_pieces of every row; columns in ``keep`` pass through.

    Null and empty texts have no pieces; rows with the same key and text get the same
    pieces; whole texts are encoded; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    keep = [id_col] if keep is None else keep

    def run(batches):
        sampler = sampler_of(model, alpha, file_stamp(model))
        for b in batches:
            texts, key = b.column("__text").to_pylist(), seeds(b.column("__key").to_pylist(), seed)
            ids: list[bytes] = []
            start = size = 0
            for k, t in enumerate(texts):  # about half a million characters at a time, so that long texts do not add up
                size += len(t or "")
                if size > 1 << 19 or k == len(texts) - 1:
                    ids += sampler.encode([x or "" for x in texts[start : k + 1]], key[start : k + 1])
                    start, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + [pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())], names=[*keep, "ids", "n_pieces"])

    return docs.select(*[docs[c] for c in keep], docs[id_col].alias("__key"), docs[text_col].alias("__text")).mapInArrow(run, with_kept(docs, keep, "ids binary, n_pieces long"))


def decode_texts(encoded: DataFrame, model: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The text of every row of ids, exactly as it was encoded (null and empty ones: empty)."""
    prepare(encoded.sparkSession)
    keep = [c for c in encoded.columns if c != ids_col] if keep is None else keep

    def run(batches):
        decoder = Decoder(vocabulary(model, 1.0, file_stamp(model)).text)
        for b in batches:
            texts = [decoder.decode(i) if i else "" for i in b.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + [pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return encoded.select(*[encoded[c] for c in keep], encoded[ids_col].alias("__ids")).mapInArrow(run, with_kept(encoded, keep, "decoded string"))


def round_trip(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and compare: id, n_pieces, ids_sha256, decoded_sha256, lossless."""
    encoded = encode_texts(docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("__t")), model, alpha, seed, "__id", "__t", ["__id", "__t"])
    decoded = decode_texts(encoded.select("__id", F.sha2("__t", 256).alias("__sha"), "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), "ids"), model)
    return decoded.select(F.col("__id").alias(id_col), "n_pieces", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("__sha")).alias("lossless"))
