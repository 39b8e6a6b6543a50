"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Of the tokens that end a byte prefix, exactly one ends its encoding: the one that is itself
what its bytes encode to and that may follow the last token of the prefix before it.  Two
tokens may follow each other if their bytes together encode to just the two.  So a table with
the last token of every prefix is filled from left to right, and walked back from its end it
is the encoding.  An entry looks back no further than the longest token: bytes appended only
add entries, and after an edit the entries count again from where as many in a row as the
longest token has bytes are what they were.

The table is kept for each pre-token, a match of the pattern, since no token crosses their
borders; a worker keeps the ids of the pre-tokens it has met, up to a bound.
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_stamp, prepare, with_kept
from .token_counts import BASIC, BLOCK, PRETOKEN, ranges

#: Entries of a worker's tables; a full one makes room, which costs time and changes no result.
CACHE_ENTRIES, PAIRS = 400_000, 1_000_000
LONG_PRETOKEN = 64
#: How far past its end a match of the pattern can have looked: the letters of a contraction.
LOOKAHEAD = 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, of a file with a base64 token and a rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens by id, all matches that end at a place, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"the vocabulary lacks the bytes {lacking}")
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = [0] * (max(self.token) + 1)
        for rank, token in self.token.items():
            self.size[rank] = len(token)
        self.longest = max(self.size)
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.matches.add_word(token.decode("latin-1"), rank)
        self.matches.make_automaton()
        self.own: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The plain definition, for the few bytes of two tokens: the neighbours of least rank become one until none are a token."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while joined and (least := min(joined)) != none:
            at = joined.index(least)
            parts[at] += parts.pop(at + 1)
            del joined[at]
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def stands(self, token: int) -> bool:
        """Whether a token is what its bytes encode to."""
        if token not in self.own:
            self.own[token] = len(self.merged(self.token[token])) == 1
        return self.own[token]

    def follows(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode to a and b."""
        key = a * len(self.size) + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.token[a], self.token[b]
            found = self.pairs[key] = x + y not in self.ranks and self.merged(x + y) == [x, y]
        return found


class Prefixes:
    """The last token of every prefix of a run of bytes; entry 0 is the empty prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes: earlier entries stay."""
        known = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self._fill(known)

    def _fill(self, known: int, enough: Callable[[int], bool] | None = None) -> None:
        """Work out the entries after ``known``, in order, until one is enough."""
        v, last, size = self.vocabulary, self.last, self.vocabulary.size
        begin = max(0, known - v.longest + 1)
        follows, pairs, width = v.follows, v.pairs, len(size)
        for end, token in v.matches.iter(self.data[begin:].decode("latin-1")):
            end += begin + 1
            if end <= known or last[end] >= 0:
                continue
            start = end - size[token]
            if start:
                before = last[start]
                good = pairs.get(before * width + token)
                good = follows(before, token) if good is None else good
            else:
                good = v.stands(token)
            if good:
                last[end] = token
                if enough is not None and enough(end):
                    break

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put new in the place of bytes start to end; returns how many entries were worked out again.

        Behind the edit it stops where the last ``longest`` entries are those from before: all
        that follow look back no further.
        """
        old, gone, behind = self.last, len(new) - (end - start), start + len(new)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1] + [-1] * (len(self.data) - start)
        same, reached = 0, start

        def settled(at: int) -> bool:
            nonlocal same, reached
            reached = at
            same = same + 1 if at > behind and self.last[at] == old[at - gone] else 0
            return same >= self.vocabulary.longest

        self._fill(start, settled)
        self.last[reached + 1 :] = old[reached - gone + 1 :]
        return reached - start

    def tokens(self) -> list[int]:
        """The encoding: the last tokens, walked back from the end."""
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= self.vocabulary.size[self.last[at]]
        return out[::-1]


class Splitter:
    """A pattern's matches, with the character classes that the library's own engine has.

    A character is of the class of 'a', '1' or '!' if the library joins the two: with a
    vocabulary of single bytes and of these three before a byte, the first token tells.
    """

    def __init__(self, pattern: str):
        import tiktoken

        single = {bytes([b]): b for b in range(256)}
        joined = {p + bytes([b]): 256 * (k + 1) + b for k, p in enumerate((b"a", b"1", b"!")) for b in range(256)}
        self.first = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single | joined, special_tokens={}).encode_ordinary
        self.pattern = pattern
        self.classes: dict[str, list[int]] = {"L": [], "N": [], "S": []}
        self.blocks: set[int] = set()
        self.learn(set(range(BASIC)))

    def learn(self, blocks: set[int]) -> None:
        """Classify the characters of new blocks."""
        for o in (o for b in sorted(blocks - self.blocks) for o in range(b * BLOCK, min((b + 1) * BLOCK, 0x110000))):
            if not 0xD800 <= o <= 0xDFFF:
                kind = next((k for k, p in zip("LN!", "a1!") if self.first(p + chr(o))[0] >= 256), "S")
                if kind != "!":
                    self.classes[kind].append(o)
        self.blocks |= blocks
        letters, numbers, space = (ranges(sorted(self.classes[k])) for k in "LNS")
        pattern = self.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
        self.regex = re.compile(pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))
        self.other = re.compile(f"[^{ranges(sorted(o for b in self.blocks for o in range(b * BLOCK, (b + 1) * BLOCK)))}]")

    def ready(self, text: str) -> re.Pattern:
        if not text.isascii() and self.other.search(text):
            self.learn({ord(c) // BLOCK for c in self.other.findall(text)})
        return self.regex


class Encoder:
    """Texts to ids and back, by one file of ranks."""

    def __init__(self, path: str, pattern: str = PRETOKEN):
        self.vocabulary = Vocabulary(read_ranks(path))
        self.split = Splitter(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, pretoken: str) -> bytes:
        """The ids of one pre-token as 32-bit numbers.  A full table becomes the older one, from which what is met again comes back."""
        found = self.known.get(pretoken) or self.older.get(pretoken)
        if found is None:
            data = pretoken.encode()
            whole = self.vocabulary.ranks.get(data)
            found = array("i", [whole] if whole is not None else Prefixes(self.vocabulary, data).tokens()).tobytes()
        if len(pretoken) <= LONG_PRETOKEN:
            if len(self.known) >= CACHE_ENTRIES:
                self.older, self.known = self.known, {}
            self.known[pretoken] = found
        return found

    def encode(self, text: str) -> tuple[array, int, str]:
        """The ids, how many of them no further text can change, and the text of the others."""
        known, piece = self.known, self.piece
        matches = self.split.ready(text).findall(text)
        parts = [known.get(p) or piece(p) for p in matches]
        out = array("i")
        out.frombytes(b"".join(parts))
        border, settled = len(text), len(out)
        while matches and border > len(text) - LOOKAHEAD:
            border -= len(matches.pop())
            settled -= len(parts.pop()) // out.itemsize
        return out, settled, text[border:]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids))


class Encoded:
    """A text with the matches of the pattern and their ids, for appends and edits."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.ends: list[int] = []
        self.parts: list[bytes] = []
        self.replace(0, 0, text)

    def ids(self) -> array:
        out = array("i")
        out.frombytes(b"".join(self.parts))
        return out

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put new in the place of characters start to end; returns how many matches were looked for.

        Matches that did not look at the edit stay, and so do those behind it from where a
        new match ends where an old one did.
        """
        gone = len(new) - (end - start)
        keep = bisect_right(self.ends, start - LOOKAHEAD)
        begin = self.ends[keep - 1] if keep else 0
        text = self.text[:start] + new + self.text[end:]
        ends, parts, meets = [], [], len(self.ends)
        for m in self.encoder.split.ready(text).finditer(text, begin):
            ends.append(m.end())
            parts.append(self.encoder.piece(m.group()))
            if m.end() >= start + len(new):
                at = bisect_left(self.ends, m.end() - gone)
                if at < len(self.ends) and self.ends[at] == m.end() - gone:
                    meets = at + 1
                    break
        looked = len(ends)
        self.ends = self.ends[:keep] + ends + [e + gone for e in self.ends[meets:]]
        self.parts = self.parts[:keep] + parts + self.parts[meets:]
        self.text = text
        return looked


@lru_cache(maxsize=2)
def encoder(path: str, stamp: str, pattern: str) -> Encoder:
    """One encoder a worker and file, kept from task to task."""
    return Encoder(path, pattern)


def id_lists(rows: list[array]) -> pa.Array:
    """Arrays of ids as an Arrow list column."""
    sizes = [0]
    for r in rows:
        sizes.append(sizes[-1] + len(r))
    values = pa.Array.from_buffers(pa.int32(), sizes[-1], [None, pa.py_buffer(b"".join(r.tobytes() for r in rows))])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)


def encode_texts(docs: DataFrame, path: str, keep: list[str] | None = None, text_col: str = "text", pattern: str = PRETOKEN) -> DataFrame:
    """The kept columns (doc_id) with ids, n_tokens and, for later appends, n_settled and tail.

    ``tail`` is what of the text its further course may still split otherwise, ``n_settled``
    the number of ids before it.  Null texts count as empty and have no ids; rows come as
    they are, repeated ones and null ids too; other columns are ignored.  The pattern's matches
    must leave no gap.
    """
    prepare(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep

    def run(batches):
        own = encoder(path, file_stamp(path), pattern)
        for b in batches:
            rows = [own.encode(t.as_py() or "") for t in b.column(b.num_columns - 1)]
            ids, settled, tails = (list(c) for c in zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], id_lists(ids), pa.array([len(r) for r in ids], pa.int64()), pa.array(settled, pa.int64()), pa.array(tails, pa.string())],
                names=[*keep, "ids", "n_tokens", "n_settled", "tail"],
            )

    chosen = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text"))
    return chosen.mapInArrow(run, with_kept(docs, keep, "ids array<int>, n_tokens long, n_settled long, tail string"))


def append_texts(encoded: DataFrame, path: str, more_col: str = "more", keep: list[str] | None = None, pattern: str = PRETOKEN) -> DataFrame:
    """Rows of encode_texts with more text behind them, as encode_texts gives the whole: only the tail is encoded again."""
    prepare(encoded.sparkSession)
    keep = ["doc_id"] if keep is None else keep

    def run(batches):
        own = encoder(path, file_stamp(path), pattern)
        for b in batches:
            rows, settled, tails = [], [], []
            for row in zip(*(b.column(b.num_columns - k) for k in (4, 3, 2, 1))):
                ids, n, tail, more = (x.as_py() for x in row)
                new, fixed, left = own.encode(tail + (more or ""))
                rows.append(array("i", ids[:n]) + new)
                settled.append(n + fixed)
                tails.append(left)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-4], id_lists(rows), pa.array([len(r) for r in rows], pa.int64()), pa.array(settled, pa.int64()), pa.array(tails, pa.string())],
                names=[*keep, "ids", "n_tokens", "n_settled", "tail"],
            )

    chosen = encoded.select(*[encoded[c] for c in keep], "ids", "n_settled", "tail", encoded[more_col].alias("__more"))
    return chosen.mapInArrow(run, with_kept(encoded, keep, "ids array<int>, n_tokens long, n_settled long, tail string"))


def decode_ids(encoded: DataFrame, path: str, keep: list[str] | None = None, ids_col: str = "ids") -> DataFrame:
    """The kept columns with ``decoded``, the bytes of the ids (any ids: they need not be whole characters); null ids give none."""
    prepare(encoded.sparkSession)
    keep = ["doc_id"] if keep is None else keep

    def run(batches):
        decode = encoder(path, file_stamp(path), PRETOKEN).decode
        for b in batches:
            column = b.column(b.num_columns - 1)
            ids, borders = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
            texts = [decode(ids[x:y].tolist()) for x, y in zip(borders, borders[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.binary())], names=[*keep, "decoded"])

    return encoded.select(*[encoded[c] for c in keep], encoded[ids_col].alias("__ids")).mapInArrow(run, with_kept(encoded, keep, "decoded binary"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text: digests of the decimal ids, comma-joined, and of the bytes they decode to."""
    encoded = encode_texts(docs, path, [id_col], text_col)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    both = encoded.select(id_col, "n_tokens", digest.alias("ids_sha256"), "ids")
    decoded = decode_ids(both, path, [id_col, "n_tokens", "ids_sha256"])
    return decoded.select(id_col, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
