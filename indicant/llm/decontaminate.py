"""Benchmark decontamination with one Aho-Corasick automaton.

A window is n consecutive normalised words of a benchmark item.  Every window of n words holds
one of the item's blocks of n // 2 words, cut one after another, so the blocks are the
patterns of one automaton, a tenth of what the windows would take.  A text is normalised byte
by byte (A-Z to a-z, separators to a space), which keeps its words in place, and scanned once;
where a block stands, the match is extended word by word to both sides, and a run of n words
is a hit.  Hits are mapped back to offsets of the original.  A block that stands at many places
of the benchmark is not extended at each: the windows around its places are kept, and those of
the text around it are looked up among them.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, prepare, with_kept, words

WORD = re.compile(rb"[^ ]+")
#: The largest benchmark, in words, whose automaton was measured: 0.5 GB a worker.
MAX_WORDS = 1_000_000
#: Places of a block up to which each is extended.
FEW = 8
#: Letters of a word's code; the first and the others come from different ranges, so that codes match at words only.
BASE, FIRST, OTHER = 48, 0x40, 0x80


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(WORD_BYTES)


class Automaton:
    """One automaton over the codes of words; words that the benchmark lacks have a code that no pattern holds."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        import ahocorasick

        self.n, self.names, self.items = n, [], []
        known = sorted({w for _, words in items for w in words})
        self.width = 1
        while BASE**self.width < len(known):
            self.width += 1
        self.code = {w: "".join(chr((OTHER if j else FIRST) + k // BASE**j % BASE) for j in range(self.width)) for k, w in enumerate(known)}
        self.unknown = "\0" * self.width
        size, blocks, lines = max(1, n // 2) * self.width, defaultdict(list), {}
        for item, words in items:
            if words:
                line = "".join(map(self.code.__getitem__, words))
                if line not in lines:  # items of equal words are one line with several names
                    lines[line] = len(self.items)
                    for at in range(0, max(1, len(line) - size + 1), size):
                        blocks[line[at : at + size]].append((len(self.items), at))
                    self.names.append([])
                    self.items.append(line)
                self.names[lines[line]].append(item)
        self.scanner = ahocorasick.Automaton() if blocks else None
        for block, of in blocks.items():
            self.scanner.add_word(block, (len(block), of, None) if len(of) <= FEW else (len(block), (), self.windows(of, len(block))))
        if blocks:
            self.scanner.make_automaton()

    def windows(self, of: list[tuple[int, int]], size: int) -> list[tuple[int, int, dict[str, list[int]]]]:
        """Around the places of one block: by how far before the block a window starts and its length, items by the window's words."""
        shapes: dict[tuple[int, int], dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, q in of:
            line = self.items[item]
            length = min(self.n * self.width, len(line))
            for start in range(max(0, q + size - length), min(q, len(line) - length) + 1, self.width):
                shapes[q - start, length][line[start : start + length]].append(item)
        return [(before, length, dict(found)) for (before, length), found in shapes.items()]

    def extended(self, line: str, at: int, item: str, q: int, size: int) -> tuple[int, int]:
        """The longest common run of words around line[at : at + size] == item[q : q + size], as places in line."""
        w = self.width
        a, b = at, at + size
        while a >= w and q - (at - a) >= w and line[a - w : a] == item[q - (at - a) - w : q - (at - a)]:
            a -= w
        shift = q - at
        while b < len(line) and b + shift < len(item) and line[b : b + w] == item[b + shift : b + shift + w]:
            b += w
        return a, b

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str | None], list[tuple[int, int]]]:
        """(words, merged hit word ranges, items, the ranges' character spans in the original text)."""
        flat = normalised(text)
        words = flat.split()
        runs: dict[tuple[int, int], int] = {}  # by item and diagonal: where its last run ends
        hits, items, met = set(), set(), set()
        if self.scanner is not None and words:
            line = "".join(map(self.code.get, words, repeat(self.unknown)))
            for end, (size, of, windows) in self.scanner.iter(line):
                at = end - size + 1
                for before, length, found in windows or ():
                    window = line[at - before : at - before + length] if at >= before else ""
                    if window in found:
                        hits.add(((at - before) // self.width, (at - before + length) // self.width))
                        if (before, size, window) not in met:
                            met.add((before, size, window))
                            for item in found[window]:
                                items.update(self.names[item])
                for item, q in of:
                    if runs.get((item, at - q), -1) >= at + size:
                        continue
                    a, b = self.extended(line, at, self.items[item], q, size)
                    runs[item, at - q] = b
                    if b - a >= min(self.n * self.width, len(self.items[item])):
                        hits.add((a // self.width, b // self.width))
                        items.update(self.names[item])
        if not hits:
            return len(words), [], items, []
        ranges: list[list[int]] = []
        for start, end in sorted(hits):
            if ranges and start <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], end)
            else:
                ranges.append([start, end])
        places, raw = [m.span() for m in WORD.finditer(flat)], (text or "").encode()
        spans, at, chars = [], 0, 0
        for a, b in ranges:
            start = chars + len(raw[at : places[a][0]].decode())
            at, chars = places[b - 1][1], start + len(raw[places[a][0] : places[b - 1][1]].decode())
            spans.append((start, chars))
        return len(words), [tuple(r) for r in ranges], items, spans


_built: dict[str, Automaton] = {}


def automaton_of(key: str, items: list[tuple[str, list[bytes]]], n: int) -> Automaton:
    """One automaton a worker, kept from task to task; key names its content."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, n)
    return _built[key]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """Hits of benchmark windows in every document: n_words, n_hit, n_items, items, contaminated, spans.

    spans holds [start, end) character offsets into the original text.  The automaton is built
    in every worker, so the benchmark's words are counted first and more than ``max_words``
    raise: test sets are fixed in size and do not grow with the corpus.
    Null and empty texts have no words and no hits, null or wordless items no window; ties
    and repeated rows are judged row by row; items of one id are one item, those of a null id
    one without a name, which is null among the items and empty in their digest; extra columns
    pass through ``keep`` only; an empty benchmark or table gives clean or no rows.
    """
    spark = prepare(docs.sparkSession)
    rows = benchmark.select(benchmark[item_col].cast("string").alias("item"), words(benchmark[item_text]).alias("w"))
    size = rows.agg(F.coalesce(F.sum(F.size("w").cast("long")), F.lit(0))).first()[0]
    if size > max_words:
        raise ValueError(f"benchmark of {size} words exceeds the bound of {max_words}")
    items = sorted(((r.item, [x.encode() for x in r.w]) for r in rows.toLocalIterator()), key=lambda i: (i[0] is not None, i))
    key = hashlib.sha256(repr((n, items)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(items)
    keep = [id_col] if keep is None else keep

    def run(batches):
        built = automaton_of(key, shared.value, n)
        for b in batches:
            cols = defaultdict(list)
            for t in b.column("__text"):
                count, ranges, items, spans = built.scan(t.as_py())
                cols["n_words"].append(count)
                cols["n_hit"].append(sum(y - x for x, y in ranges))
                cols["n_items"].append(len(items))
                named = sorted(items, key=lambda i: (i is not None, i or ""))
                cols["items"].append(named)
                cols["items_sha256"].append(hashlib.sha256(",".join(i or "" for i in named).encode()).hexdigest())
                cols["contaminated"].append(bool(ranges))
                cols["spans"].append([{"start": x, "end": y} for x, y in spans])
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in range(len(keep))]
                + [pa.array(cols["n_words"], pa.int64()), pa.array(cols["n_hit"], pa.int64()), pa.array(cols["n_items"], pa.int64()), pa.array(cols["items"], pa.list_(pa.string())), pa.array(cols["items_sha256"], pa.string()), pa.array(cols["contaminated"], pa.bool_()), pa.array(cols["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[*keep, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"],
            )

    return docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text")).mapInArrow(
        run, with_kept(docs, keep, "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>")
    )
