"""Token counts without token ids.

A byte-level BPE never merges across pre-token borders, so the tokens of a text are the
sum over its distinct pre-tokens of (pieces of the pre-token) x (times it occurs).  Each
worker keeps a table of pieces by distinct pre-token; a pre-token is encoded when it is
first met and joined to the per-document frequencies from then on.  The table is local to
a worker because the distinct pre-tokens of a corpus have no size bound for a broadcast
and a shuffled join would move every (document, pre-token) pair; it is emptied beyond
``CACHE_ENTRIES`` entries, which costs time and never changes a count.

Which characters are letters, numbers or white space is asked of the tokenizer itself,
block by block, so that texts of every script split as the library splits them.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import file_stamp, prepare

#: Fixed value: the public pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters are classified in blocks of as many; the first 16 are the basic plane.
BLOCK, BASIC = 4096, 16
CACHE_ENTRIES = 800_000
LONG_PRETOKEN = 64


def ranges(chars: list[int]) -> str:
    """Code points in rising order as the inside of a character class."""
    out: list[list[int]] = []
    for o in chars:
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Splitter:
    """PRETOKEN for the standard library's engine, its classes spelt out as the tokenizer has them."""

    def __init__(self, pre_tokenizer):
        self.pre_tokenizer = pre_tokenizer
        self.classes: dict[str, list[int]] = {"L": [], "N": [], "S": []}
        self.blocks: set[int] = set()
        self.learn(set(range(BASIC)))

    def learn(self, blocks: set[int]) -> None:
        """Classify the characters of new blocks: a character is of the class of 'a', '1' or '!' if it joins that one's token."""
        for block in blocks - self.blocks:
            chars = [o for o in range(block * BLOCK, (block + 1) * BLOCK) if not 0xD800 <= o <= 0xDFFF]
            joins = {}
            for probe in "a1!":
                line = "".join(f"{probe}{chr(o)}\n" for o in chars)
                ends = {start: end for _, (start, end) in self.pre_tokenizer.pre_tokenize_str(line)}
                joins[probe] = {o for k, o in enumerate(chars) if ends.get(3 * k, 0) >= 3 * k + 2}
            self.classes["L"] += [o for o in chars if o in joins["a"]]
            self.classes["N"] += [o for o in chars if o in joins["1"]]
            self.classes["S"] += [o for o in chars if not any(o in j for j in joins.values())]
        self.blocks |= blocks
        letters, numbers, space = (ranges(sorted(self.classes[k])) for k in "LNS")
        pattern = PRETOKEN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
        self.find = re.compile(pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")).findall
        self.other = re.compile(f"[^{ranges(sorted(o for b in self.blocks for o in range(b * BLOCK, (b + 1) * BLOCK)))}]")

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() and self.other.search(text):
            self.learn({ord(c) // BLOCK for c in self.other.findall(text)})
        return self.find(text)


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceTable(dict):
    """Pieces of each distinct pre-token, counted when it is first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model
        self.alphabet = byte_alphabet()

    def __missing__(self, pretoken: str) -> int:
        n = len(self.model.tokenize(pretoken.encode().decode("latin-1").translate(self.alphabet)))
        if len(pretoken) <= LONG_PRETOKEN:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[pretoken] = n
        return n


class TokenCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        #: The sum over pre-tokens holds for plain byte-level BPE; for any other file the library counts whole texts.
        self.additive = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and pre.get("use_regex", True) and not spec["model"].get("dropout")
            and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in spec["added_tokens"])
        )
        self.added = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.border = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.split = Splitter(self.tokenizer.pre_tokenizer) if self.additive else None
        self.pieces = PieceTable(self.tokenizer)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.additive:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        total, parts = 0, [text]
        if self.border is not None and any(a in text for a in self.added):
            parts = self.border.split(text)
            total = len(parts) - 1
        pieces = self.pieces
        for part in parts:
            frequency = Counter(self.split(part))
            total += sum([pieces[p] * n for p, n in frequency.items()])
        return total


@lru_cache(maxsize=2)
def counter(path: str, stamp: str) -> TokenCounter:
    """One counter a worker and tokenizer file, kept from task to task."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, in one pass without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept as
    they come; other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches):
        count = counter(tokenizer_path, file_stamp(tokenizer_path)).count
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            sizes, tokens = [], []
            for t in texts:
                t = t.as_py() or ""
                sizes.append(len(t.encode()))
                tokens.append(count(t))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
