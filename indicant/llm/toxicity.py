"""Toxicity by a linear-chain conditional random field.

Token labels come from the document labels: words that are significantly over-represented in
toxic training documents are labelled toxic where they stand in one.  A two-state CRF is
fitted on all sentences of the sample by stochastic gradients; a word's emission is made of
the word, its neighbours and its character trigrams, so that spellings and words that the
labels never met are judged too.  Forward-backward marginals over every sentence of a text
give the offending spans and, through a calibrated logistic layer, the document's score.
Only words are inputs: never labels, language, source or identifiers.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, prepare, with_kept

#: As WORD_BYTES, but ends of sentences and lines become a line feed.
SEGMENT_BYTES = bytes(10 if chr(b) in ".!?\n\r" else WORD_BYTES[b] for b in range(256))
#: Sentences of more words are stepped through one by one, shorter ones side by side.
WIDE = 2048
#: Buckets of character trigrams, and words that a worker remembers.
TRIGRAM_BITS, CACHE_WORDS = 12, 150_000
#: Words of a step of the fit, and characters of texts that are tagged side by side.
BATCH, TAGGED = 1 << 17, 1 << 19


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def segments(text: str | None) -> list[list[bytes]]:
    """The words of a text's sentences and lines, whole."""
    return [w for line in (text or "").encode().translate(SEGMENT_BYTES).split(b"\n") if (w := line.split())]


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the words' character trigrams one after another, how many each word has); ends of words count as a character."""
    flat = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    three = flat[at] << 16 | flat[at + 1] << 8 | flat[at + 2]
    return ((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int32), sizes


class Lattice:
    """Sentences side by side from the longest to the shortest, stepped through word by word."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        lengths, start = lengths[order], (np.cumsum(lengths) - lengths)[order]
        long = int((lengths > WIDE).sum())
        #: Sentences for which a step of vectors would hold hardly anything.
        self.single = list(zip(start[:long].tolist(), lengths[:long].tolist()))
        start, lengths = start[long:].astype(np.int32), lengths[long:]
        steps = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        #: The token of each active sentence at every step.
        self.at = [start[: active[t]] + t for t in range(steps)]
        inner = self.at[1:] + [np.arange(a + 1, a + n, dtype=np.int32) for a, n in self.single]
        #: Tokens that have one before them in their sentence, and those that have one after.
        self.inner = np.concatenate(inner) if inner else np.zeros(0, np.int32)

    def messages(self, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios toxic : clean of the forward and backward messages; e: emission odds, t: 2 x 2 transition weights."""
        fwd, bwd = np.empty_like(e), np.ones_like(e)
        for k, at in enumerate(self.at):
            if k == 0:
                fwd[at] = e[at]
            else:
                r = fwd[at - 1]
                fwd[at] = e[at] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
        for at in reversed(self.at[1:]):
            x = e[at] * bwd[at]
            bwd[at - 1] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        t00, t01, t10, t11 = t.ravel().tolist()
        for a, n in self.single:
            odds, r, out = e[a : a + n].tolist(), 0.0, []
            for k, x in enumerate(odds):
                r = x * (t01 + r * t11) / (t00 + r * t10) if k else x
                out.append(r)
            fwd[a : a + n] = out
            r, out = 1.0, [1.0]
            for x in reversed(odds[1:]):
                x *= r
                r = (t10 + t11 * x) / (t00 + t01 * x)
                out.append(r)
            bwd[a : a + n] = out[::-1]
        return fwd, bwd

    def neighbours(self, column: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the words before and after, ``none`` at a sentence's ends."""
        before, after = np.full(len(column), none, column.dtype), np.full(len(column), none, column.dtype)
        before[self.inner], after[self.inner - 1] = column[self.inner - 1], column[self.inner]
        return before, after


class Crf:
    """Weights by word column (0: a word too rare to have one, the last: no word), for the word itself and as a neighbour, by trigram bucket, and transitions."""

    def __init__(self, columns: int):
        self.own, self.before, self.after = np.zeros(columns + 1), np.zeros(columns + 1), np.zeros(columns + 1)
        self.gram, self.bias, self.trans = np.zeros(1 << TRIGRAM_BITS), np.array([-4.0]), np.zeros((2, 2))

    def emissions(self, column: np.ndarray, spelt: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.exp(np.clip(self.bias[0] + self.own[column] + spelt + self.before[near[0]] + self.after[near[1]], -30, 30))

    def spelling(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Mean trigram weight of words whose trigrams stand one after another."""
        return np.add.reduceat(self.gram[grams], np.cumsum(sizes) - sizes) / sizes if len(sizes) else np.zeros(0)


def fit_crf(batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], column: np.ndarray, grams: np.ndarray, sizes: np.ndarray, steps: int = 160) -> Crf:
    """Fit on batches of (word numbers, labels, sentence lengths): Adagrad on the conditional likelihood, L2 on all weights.

    column has the weight's column of every word number; grams and sizes its trigrams.  All
    batches are gone through at least four times and until about ``steps`` steps were taken.
    """
    none = int(column.max()) + 1
    crf = Crf(none)
    parts = ("own", "before", "after", "gram", "bias", "trans")
    seen = {k: np.full_like(getattr(crf, k), 1e-2) for k in parts}
    rate = {"own": 0.5, "before": 0.2, "after": 0.2, "gram": 0.2, "bias": 0.3, "trans": 0.3}
    start, own = np.cumsum(sizes) - sizes, []
    for word, _, n in batches:  # each batch looks at the spelling of its own words only
        met, number = np.unique(word, return_inverse=True)
        some = sizes[met]
        at = np.repeat(start[met] - np.cumsum(some) + some, some) + np.arange(int(some.sum()))
        own.append((Lattice(n.astype(np.int64)), number.astype(np.int32), grams[at], some))
    for _ in range(max(4, -(-steps // len(batches)))):
        for (word, y, _), (lattice, number, spelt, some) in zip(batches, own):
            c = column[word]
            near = lattice.neighbours(c, none)
            e, t = crf.emissions(c, crf.spelling(spelt, some)[number], near), np.exp(crf.trans)
            fwd, bwd = lattice.messages(e, t)
            odds = fwd * bwd
            short = y - odds / (1 + odds)
            by_word = np.bincount(number, weights=short, minlength=len(some)) / some
            inner, gold_y = lattice.inner, y.astype(np.int64)
            r, after = fwd[inner - 1], e[inner] * bwd[inner]
            pair = np.stack([np.full_like(r, t[0, 0]), t[0, 1] * after, r * t[1, 0], r * t[1, 1] * after])
            pair /= pair.sum(axis=0)
            gold = np.bincount(2 * gold_y[inner - 1] + gold_y[inner], minlength=4).astype(float)
            grad = {
                "own": np.bincount(c, weights=short, minlength=none + 1), "before": np.bincount(near[0], weights=short, minlength=none + 1),
                "after": np.bincount(near[1], weights=short, minlength=none + 1), "gram": np.bincount(spelt, weights=np.repeat(by_word, some), minlength=1 << TRIGRAM_BITS),
                "bias": np.array([short.sum()]), "trans": (gold - pair.sum(axis=1)).reshape(2, 2),
            }
            for k in parts:
                w = getattr(crf, k)
                g = grad[k] - (0.0 if k == "bias" else 0.02 if k == "own" else 0.3) * w
                seen[k] += g**2
                w += rate[k] * g / np.sqrt(seen[k])
    return crf


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (bias first) of a logistic regression by Newton's method."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + l2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Words(dict):
    """Number of each word that was met, given when it is first asked for; ``new`` lists those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Tagger:
    def __init__(self, crf: Crf, column: dict[bytes, int], layer: np.ndarray):
        self.crf, self.column, self.layer = crf, column, layer
        self.forget()

    def __getstate__(self) -> dict:
        return {"crf": self.crf, "column": self.column, "layer": self.layer}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def forget(self) -> None:
        self.words, self.columns, self.spelt = Words(), np.zeros(0, np.int32), np.zeros(0)

    def learn(self) -> None:
        """Columns and spelling weights of words that are new to this worker."""
        new, self.words.new = self.words.new, []
        if new:
            self.columns = np.concatenate([self.columns, np.array([self.column.get(w, 0) for w in new], np.int32)])
            self.spelt = np.concatenate([self.spelt, self.crf.spelling(*trigrams(new))])

    def marginals(self, texts: list[list[list[bytes]]]) -> list[np.ndarray]:
        """Probability of being toxic of every word, by text."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        lengths = np.array([len(s) for t in texts for s in t], dtype=np.int64)
        sizes = [sum(map(len, t)) for t in texts]
        if not sum(sizes):
            return [np.zeros(0) for _ in sizes]
        known = self.words
        number = np.fromiter((known[w] for t in texts for s in t for w in s), dtype=np.int64, count=sum(sizes))
        self.learn()
        column, lattice = self.columns[number], Lattice(lengths)
        e = self.crf.emissions(column, self.spelt[number], lattice.neighbours(column, len(self.crf.own) - 1))
        fwd, bwd = lattice.messages(e, np.exp(self.crf.trans))
        odds = fwd * bwd
        return np.split(odds / (1 + odds), np.cumsum(sizes)[:-1])

    @staticmethod
    def summary(p: np.ndarray) -> list[float]:
        """What the document layer sees: the largest marginal, the expected toxic words, their share."""
        if not len(p):
            return [0.0, 0.0, 0.0]
        likely = float(p[p > 0.1].sum())
        return [float(p.max()), math.log1p(likely), likely / len(p) * 10]

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        x = np.array([[1.0, *self.summary(p)] for p in marginals]).reshape(len(marginals), 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.layer, -30, 30)))


def fit(rows, min_docs: int = 4, min_lift: float = 2.5) -> Tagger:
    """Fit on all words of (text, toxic) rows of the training sample, which may be an iterator: texts are kept as word numbers."""
    number = Words()
    docs: list[tuple[np.ndarray, np.ndarray]] = []  # word numbers and sentence lengths
    toxic = []
    for text, y in rows:
        if y is not None:
            segs = segments(text)
            docs.append((np.array([number[w] for s in segs for w in s], np.int32), np.array([len(s) for s in segs], np.int32)))
            toxic.append(int(y))
    y = np.array(toxic, bool)
    flat = Tagger(Crf(1), {}, np.zeros(4))
    if not y.any() or y.all() or not len(number):  # one class or nothing to learn from: the base rate for every text, clean without labels
        rate = (y.sum() + 0.1) / (len(docs) + 1.0)
        flat.layer = np.array([math.log(rate / (1 - rate)), 0, 0, 0])
        return flat
    bad, all_ = np.zeros(len(number)), np.zeros(len(number))
    for (w, _), t in zip(docs, y):
        once = np.unique(w)
        all_[once] += 1
        bad[once] += t
    rate = y.mean()
    lift = (bad - all_ * rate) / np.sqrt(np.maximum(all_, 1) * rate * (1 - rate))
    lexicon = (bad >= min_docs) & (bad >= min_lift * rate * all_) & (lift > 5)
    known = lexicon | (all_ >= 20)
    column = np.where(known, np.cumsum(known), 0).astype(np.int32)  # 0: a word too rare to have a weight
    grams, sizes = trigrams(list(number))
    batches, held = [], []
    for k, ((w, n), t) in enumerate(zip(docs, toxic)):
        held.append((w, lexicon[w] & bool(t), n))
        if sum(len(h[0]) for h in held) >= BATCH or k == len(docs) - 1:
            batches.append(tuple(np.concatenate([h[j] for h in held]) for j in range(3)))
            held = []
    batches = [b for b in batches if len(b[0])]
    crf = fit_crf(batches, column, grams, sizes)
    tagger = Tagger(crf, {w: int(column[k]) for w, k in number.items() if known[k]}, np.zeros(4))
    words, seen = list(number), []
    for i in range(0, len(docs), 100):
        part = docs[i : i + 100]
        seen += [tagger.summary(p) for p in tagger.marginals([[[words[x] for x in s] for s in np.split(w, np.cumsum(n)[:-1])] if len(w) else [] for w, n in part])]
    tagger.layer = logistic(np.array(seen), y.astype(float), l2=0.1)
    return tagger


def training_sample(docs: DataFrame, labels: DataFrame, target: str, max_rows: int, id_col: str, columns: list[str]) -> DataFrame:
    """At most about max_rows labelled, not held-out rows of docs with their label, drawn by a hash of the id.

    The sample of labels is bounded by max_rows before it is broadcast; of several labels of
    one id the largest counts.
    """
    usable = labels.filter(labels[target].isNotNull() & labels[id_col].isNotNull() & ~held_out(labels[id_col])).select(labels[id_col].alias("__lid"), labels[target].cast("int").alias("__y"))
    n = usable.count()
    if n > max_rows:
        usable = usable.filter(F.pmod(F.xxhash64("__lid"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    one = usable.groupBy("__lid").agg(F.max("__y").alias("__y"))
    found = docs.select(docs[id_col].alias("__lid"), *[docs[c].alias(f"__{c}") for c in columns]).join(F.broadcast(one), "__lid")
    # The same order for the same rows, however they are spread over files.
    return found.select("__lid", *[f"__{c}" for c in columns], "__y").repartition(8, "__lid").sortWithinPartitions("__lid", *[f"__{c}" for c in columns])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Fit on a bounded sample (max_rows, a parameter) of labelled rows that are not held out."""
    sample = training_sample(docs, labels, "toxic", max_rows, id_col, [text_col])
    return fit((r[1], r[2]) for r in sample.toLocalIterator())


def score_toxicity(docs: DataFrame, tagger: Tagger, threshold: float = 0.3, span_threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """score, predicted and offending spans ([start, end) characters of the original text) of every row.

    Whole texts are tagged; null and empty texts get the score of a text without toxic words;
    repeated rows and null ids are scored row by row; other columns pass through ``keep``,
    whatever their names; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(tagger)
    keep = [id_col] if keep is None else keep

    def spans(text: str, p: np.ndarray) -> list[dict]:
        raw = text.encode()
        places = [m.span() for m in re.finditer(rb"[^ \n]+", raw.translate(SEGMENT_BYTES))]
        # Characters before each byte, counted once: every byte but a continuation byte starts one.
        before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, dtype=np.int32)])
        return [{"start": int(before[places[k][0]]), "end": int(before[places[k][1]]), "p": float(p[k])} for k in np.flatnonzero(p >= span_threshold)]

    def run(batches):
        model = shared.value
        for b in batches:
            texts, marginals, start, size = b.column("__text").to_pylist(), [], 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size > TAGGED or k == len(texts) - 1:
                    marginals += model.marginals([segments(t) for t in texts[start : k + 1]])
                    start, size = k + 1, 0
            score = model.scores(marginals)
            found = [spans(t, p) if len(p) and p.max() >= span_threshold else [] for t, p in zip(texts, marginals)]
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in range(len(keep))]
                + [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32()), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))],
                names=[*keep, "score", "predicted", "spans"],
            )

    return docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text")).mapInArrow(run, with_kept(docs, keep, "score double, predicted int, spans array<struct<start:bigint,end:bigint,p:double>>"))
