"""License scan, decontamination, token counts, SentencePiece, toxicity, quality and chat formatting."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from indicant.llm import chat_format, quality, sentencepiece_codec, toxicity
from indicant.llm.common import WORD_BYTES
from indicant.llm import decontaminate as decontamination
from indicant.llm.decontaminate import Automaton, decontaminate, normalised
from indicant.llm.license_scan import TEMPLATES, Template, scan_licenses
from indicant.llm.near_dedup import near_duplicates
from indicant.llm.queries import tokenizer
from indicant.llm.token_counts import TokenCounter, count_tokens

#: Extra columns whose names clash with what operators return or use inside.
HARD = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, id string, n long, contaminated string, words string"


def hard_rows():
    """Null columns, empty and very long texts, ties, repeated rows and null ids."""
    long = "Ünïcode wörter und mehr. " * 20000
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one two three"), (4, "one two three"), (5, "one two three"), (None, "some text here"), (None, None), (6, long), (7, "x" * 50000), (8, "a▁b ▁ \u0000 한국 <|endoftext|> <|im_end|>")]
    return [(i, t, None, None, None, None, None, None, None, None, None) for i, t in rows]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), HARD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], HARD)


def words(text):
    return (text or "").encode().translate(WORD_BYTES).decode().split()


def test_license_places_and_labels(spark):
    texts = ["MIT License, mit-license; the MIT\nLICENSE", "GNU General Public License version 3", "permit licenses", "Licensed under the Apache License, Version 2.0.", "general public general public license"]
    rows = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels) == (3, 0, 5, "mit")
    assert (rows[1].base_labels, rows[1].labels, rows[1].score) == ("gpl", "gpl,gpl-3.0", 1.0)
    assert (rows[2].n_base, rows[2].first_word, rows[2].labels, rows[2].score) == (0, None, "", 0.0)
    assert rows[3].labels == "apache,apache-2.0"
    assert (rows[4].n_base, rows[4].first_word) == (1, 2)


def test_license_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["mit", "license", "apache", "general", "public", "gnu", "x", "version", "3"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for k in range(200)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, text in docs:
        w = words(text)
        places = [i for t in TEMPLATES if t.base for i in range(len(w)) if w[i : i + len(t.words)] == t.words]
        assert (got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))


def test_license_of_many_templates(spark):
    """The expressions stay the same for hundreds of templates; single-word ones and ones whose anchors are one word included."""
    rng = random.Random(9)
    many = [*TEMPLATES, Template("one", "zlib"), Template("twice", "wtf wtf license")] + [Template(f"t{k}", " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(6)) + f" t{k}") for k in range(300)]
    docs = [(k, " ".join(rng.choice([many[rng.randrange(len(many))].text, "zlib", "wtf", "license", "aa bb"]) for _ in range(6))) for k in range(60)]
    for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), many).collect():
        w = words(docs[r.doc_id][1])
        expected = {t.label for t in many for i in range(len(w)) if i >= t.key_at[0] and w[i : i + t.key_at[1]] == t.words[t.key_at[0] : sum(t.key_at)]}
        assert set(filter(None, r.labels.split(","))) == expected


def test_license_hard_rows(hard, none):
    rows = scan_licenses(hard).collect()
    assert len(rows) == 11 and all(r.n_base == 0 and r.score == 0 for r in rows)
    assert scan_licenses(none).count() == 0


def brute_hits(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for i in range(max(1, len(iw) - n + 1) if iw else 0):
            win = iw[i : i + n]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for k in range(12)] + [(99, None), (100, "¿Qué, ÉL?")]
    docs = [(k, " ".join(rng.choice("abcdE") for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(1000, "x qué él\tqué; Él y"), (1001, items[0][1].upper().replace(" ", "--"))]
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    for r, (k, text) in zip(sorted(found.collect(), key=lambda r: r.doc_id), sorted(docs)):
        n, hit, of = brute_hits(text, items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(of), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(of).encode()).hexdigest()


def test_decontamination_offsets_point_into_the_original():
    built = Automaton([("7", normalised("große Fragen, kurze Antwort").split())], 10)
    text = "  ¡So! GROßE -- fragen; kurze\nAntwort?"
    _, ranges, items, spans = built.scan(text.replace("GROßE", "Große"))
    assert ranges == [(1, 5)] and items == {"7"} and [text[a:b] for a, b in spans] == ["GROßE -- fragen; kurze\nAntwort"]


@pytest.mark.parametrize("few", [0, 2, decontamination.FEW])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 10])
def test_decontamination_automaton_equals_windows(n, few, monkeypatch):
    """Blocks and their extension, or the windows around frequent ones, find what all windows would, also in items of hardly any different words."""
    monkeypatch.setattr(decontamination, "FEW", few)
    rng = random.Random(n)
    for _ in range(200):
        letters = rng.choice(["ab", "abc", "abcd"])
        items = [(str(i), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 16)))) for i in range(5)]
        text = " ".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 50)))
        count, ranges, found, _ = Automaton([(i, t.encode().split()) for i, t in items], n).scan(text)
        assert (count, sum(b - a for a, b in ranges), sorted(found)) == brute_hits(text, items, n)


def test_decontamination_of_items_that_begin_alike():
    """A preamble that thousands of items share costs a few lookups for each place it stands at."""
    head = "the following is a multiple choice question about the history of".split()
    items = [(str(k), [w.encode() for w in [*head, f"a{k}", f"b{k}", "answer", "now"]]) for k in range(5000)]
    built = Automaton(items, 10)
    text = " ".join([*head, "a7", "b7", "answer", "now", "and", *head[:10], "rest"] * 40)
    start = time.process_time()
    count, ranges, found, _ = built.scan(text)
    assert time.process_time() - start < 2
    assert count == 40 * 27 and len(found) == 5000 and sum(b - a for a, b in ranges) == 40 * 25
    assert built.scan("a7 b7 answer now " + " ".join(head[2:]) + " a9 x")[2] == {"9"}


def test_decontamination_of_null_and_repeated_item_ids(spark):
    docs = spark.createDataFrame([(1, "one two three x four five six x seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), ("None", "four five six"), ("None", "seven"), (None, "nowhere")], "item_id string, text string")
    r = decontaminate(docs, bench).first()
    assert (r.n_hit, r.n_items, r["items"], r.items_sha256) == (7, 2, [None, "None"], hashlib.sha256(b",None").hexdigest())


def test_toxic_spans_of_a_very_long_text_take_linear_time(spark):
    train = [(k, f"you are a {w} and nobody likes it {k}" if k % 2 else f"this is a nice day for all of us {k}") for k, w in zip(range(400), ["fool", "scum", "trash", "idiot"] * 100)]
    docs = spark.createDataFrame(train, "doc_id long, text string")
    tagger = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k, _ in train], "doc_id long, toxic int"))
    long = "é you are a fool and nobody likes it. " * 40_000
    start = time.time()
    r = toxicity.score_toxicity(spark.createDataFrame([(1, long)], "doc_id long, text string"), tagger, span_threshold=0.0).select("doc_id", "spans").first()
    assert time.time() - start < 60 and len(r.spans) == 9 * 40_000
    assert [long[s.start : s.end] for s in r.spans[-8:]] == "you are a fool and nobody likes it".split()


def test_decontamination_refuses_a_benchmark_beyond_its_bound(spark):
    docs, bench = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    with pytest.raises(ValueError):
        decontaminate(docs, bench, max_words=2)


def test_decontamination_hard_rows(spark, hard, none):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (None, "")], "item_id long, text string")
    rows = decontaminate(hard, bench).collect()
    assert len(rows) == 11 and sum(r.contaminated for r in rows) == 3
    assert decontaminate(none, bench).count() == 0 and not decontaminate(hard, bench.limit(0)).filter("contaminated").count()


def test_token_counts_equal_the_library(spark, hard, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = [r[1] or "" for r in hard_rows()] + ["don't  stop\n\n\n  it's 12'34 '", "<|endoftext|><|endoftext|> a", "  　x\u0085y\x1c", "日本語とэто ไทย", "a" * 200]
    counter = TokenCounter(path)
    for t in texts:
        assert counter.count(t) == len(whole.encode(t, add_special_tokens=False).ids), t[:40]
    rows = count_tokens(hard, path).collect()
    assert len(rows) == 11 and {(r.n_bytes, r.n_tokens, r.over_limit) for r in rows if r.doc_id in (1, 2)} == {(0, 0, False)}
    assert count_tokens(none, path).count() == 0


def test_token_counts_of_every_script_and_a_whole_table(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    whole, counter, rng = Tokenizer.from_file(path), TokenCounter(path), random.Random(3)
    texts = ["日本語とэто ไทย 한국어", "नमस्ते दुनिया १२३", "שלום עולם", "Tiếng Việt™ 🙂🙃 x", "½ ² Ⅷ 𝔘𝔫𝔦 𐍈 \u3000\u2028 '’s"]
    blocks = (range(0x80), range(0x80, 0x3000), range(0x3000, 0xD800), range(0xE000, 0x110000), (32, 39, 10, 0x1F600))
    texts += ["".join(chr(rng.choice(rng.choice(blocks))) for _ in range(30)) for _ in range(400)]
    assert [counter.count(t) for t in texts] == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, path).collect()}
    assert got == {r.doc_id: len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_token_counts_other_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    counter = TokenCounter(path)
    assert not counter.additive
    assert counter.count("Hello, the World!") == len(Tokenizer.from_file(path).encode("Hello, the World!", add_special_tokens=False).ids)


MODEL = "piece_bpe_32k.model"


def test_sentencepiece_is_lossless_and_reproducible(spark, hard, none):
    docs = hard.withColumn("text", F.coalesce("text", F.lit("")))
    rows = sentencepiece_codec.round_trip(hard, tokenizer(MODEL)).collect()
    assert len(rows) == 11 and all(r.lossless for r in rows)
    again = sentencepiece_codec.round_trip(hard.repartition(3), tokenizer(MODEL)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sentencepiece_codec.encode_texts(none, tokenizer(MODEL)).count() == 0
    other = sentencepiece_codec.encode_texts(docs, tokenizer(MODEL), seed=5).select("doc_id", "ids").filter("doc_id = 6").first()
    first = sentencepiece_codec.encode_texts(docs, tokenizer(MODEL)).select("doc_id", "ids").filter("doc_id = 6").first()
    assert other.ids != first.ids


def test_sentencepiece_draws_follow_the_lattice():
    """Sampled segmentations of one word occur as often as their weights say."""
    v = sentencepiece_codec.Vocabulary(tokenizer(MODEL), 0.5)
    sampler = sentencepiece_codec.Sampler(v)
    n, word = 20000, "theat"
    drawn = sampler.encode([word] * n, sentencepiece_codec.seeds(list(range(n)), 1))
    unit, ways = " " + word, {}

    def walk(at, ids, p):
        if at == len(unit):
            ways[tuple(ids)] = p
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in v.weight:
                w, i = v.weight[unit[at:end]]
                walk(end, [*ids, i], p * w)

    walk(0, [], 1.0)
    total = sum(ways.values())
    counts = {}
    for d in drawn:
        key = tuple(np.frombuffer(d, "<u2").tolist())
        counts[key] = counts.get(key, 0) + 1
    assert set(counts) <= set(ways)
    for way, p in ways.items():
        share = p / total
        assert abs(counts.get(way, 0) / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-3


LONG_TEXTS = ["日本語のテキストを使って長い文を作ります。" * 40, "a" * 9000, "x=ab/cd" * 900, "สวัสดีชาวโลก" * 50, " " * 500 + "b", "🙂🙃" * 100, "a  b   c " * 50, "\n \n  x\n"]


def test_sentencepiece_long_runs_are_lossless_and_whole():
    v = sentencepiece_codec.Vocabulary(tokenizer(MODEL), 1.0)
    sampler, decoder = sentencepiece_codec.Sampler(v), sentencepiece_codec.Decoder(v.text)
    keys = sentencepiece_codec.seeds(list(range(len(LONG_TEXTS))), 0)
    together = sampler.encode(LONG_TEXTS, keys)
    for k, text in enumerate(LONG_TEXTS):
        assert decoder.decode(together[k]) == text and "".join(sampler.units_of(text)) == " " + text
        assert sentencepiece_codec.Sampler(v).encode([text], keys[k : k + 1]) == [together[k]]


def test_sentencepiece_cuts_only_where_no_piece_crosses():
    v = sentencepiece_codec.Vocabulary(tokenizer(MODEL), 1.0)
    sampler = sentencepiece_codec.Sampler(v)
    for run in (t.split("\n")[0] for t in ("日本語のテキスト" * 12, "x=ab/cd" * 30, "Привет-мир" * 20, "thequickbrown" * 9)):
        at, borders = 0, set()
        for u in sampler.free_units(run):
            at += len(u)
            borders.add(at)
        crossed = {b for i in range(len(run)) for j in range(i + 2, min(len(run), i + v.longest) + 1) if run[i:j] in v.weight for b in range(i + 1, j)}
        assert borders == set(range(1, len(run) + 1)) - crossed


def test_sentencepiece_long_units_are_drawn_as_short_ones(monkeypatch):
    """Shares of the segmentations of one unit, block by block and all at once, against the lattice's weights."""
    v, n, word = sentencepiece_codec.Vocabulary(tokenizer(MODEL), 0.3), 6000, "theathers"
    monkeypatch.setattr(sentencepiece_codec, "LONG", 4)
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", 4)
    monkeypatch.setattr(sentencepiece_codec, "RUN", 5)
    sampler, counts = sentencepiece_codec.Sampler(v), {}
    assert sampler.units_of(word) == [" " + word]
    for d in sampler.encode([word] * n, sentencepiece_codec.seeds(list(range(n)), 1)):
        counts[d] = counts.get(d, 0) + 1
    ways = {}

    def walk(at, ids, p):
        if at == len(word) + 1:
            ways[np.array(ids, "<u2").tobytes()] = p
        for end in range(at + 1, len(word) + 2):
            w, i = v.weight.get((" " + word)[at:end], (0, 0))
            if w:
                walk(end, [*ids, i], p * w)

    walk(0, [], 1.0)
    total = sum(ways.values())
    assert len(ways) > 20 and set(counts) <= set(ways)
    for way, p in ways.items():
        assert abs(counts.get(way, 0) / n - p / total) < 5 * (p / total / n) ** 0.5 + 2e-3


def labelled(n=600, seed=3):
    rng = random.Random(seed)
    plain, bad = [f"w{k}" for k in range(40)], ["fool", "scum", "trash"]
    rows = []
    for k in range(n):
        toxic = k % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((" ".join(w) + ".", int(toxic)))
    return rows


def test_toxicity_learns_spans_and_scores(spark):
    rows = labelled()
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels), keep=["doc_id", "text"]).collect()
    out = [r for r in scored if toxicity_held_out(r.doc_id)]
    assert sum(r.predicted == rows[r.doc_id][1] for r in out) / len(out) > 0.97
    spans = [r.text[s.start : s.end] for r in scored for s in r.spans]
    assert spans and sum(s in ("fool", "scum", "trash") for s in spans) / len(spans) > 0.95


def toxicity_held_out(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def random_crf(rng, columns=5):
    crf = toxicity.Crf(columns + 1)
    for part in ("own", "before", "after", "gram", "bias", "trans"):
        setattr(crf, part, rng.normal(size=getattr(crf, part).shape))
    crf.before[-1] = crf.after[-1] = 0.0  # no neighbour
    return crf


def by_enumeration(tagger, sentence):
    """Marginals of one sentence from all its labellings."""
    crf, n = tagger.crf, len(sentence)
    column = [tagger.column.get(w, 0) for w in sentence]
    score = []
    for k, w in enumerate(sentence):
        grams, _ = toxicity.trigrams([w])
        score.append(crf.bias[0] + crf.own[column[k]] + crf.gram[grams].mean() + (crf.before[column[k - 1]] if k else 0) + (crf.after[column[k + 1]] if k + 1 < n else 0))
    total, weights = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        p = np.exp(sum(x for x, l in zip(score, y) if l) + sum(crf.trans[a, b] for a, b in zip(y, y[1:])))
        total += p
        weights += p * np.array(y)
    return weights / total


@pytest.mark.parametrize("wide", [1, 4, 2048])
def test_crf_marginals_equal_enumeration(monkeypatch, wide):
    """Also of sentences that are stepped through one by one, and of words that the fit never met."""
    monkeypatch.setattr(toxicity, "WIDE", wide)
    rng = np.random.default_rng(1)
    tagger = toxicity.Tagger(random_crf(rng), {b"%d" % k: k + 1 for k in range(5)}, rng.normal(size=4))
    texts = [[[b"%d" % k for k in rng.integers(0, 7, n)] for n in sizes] for sizes in ((6,), (1, 9, 3), (), (2,))]
    got = tagger.marginals(texts)
    for t, p in zip(texts, got):
        assert np.allclose(p, np.concatenate([by_enumeration(tagger, s) for s in t]) if t else np.zeros(0))
    x = np.array([[1.0, *tagger.summary(p)] for p in got])
    assert np.allclose(tagger.scores(got), 1 / (1 + np.exp(-x @ tagger.layer)))


def test_trigrams_of_words_side_by_side():
    words_ = [b"a", "öl".encode(), b"abcd", b"a"]
    grams, sizes = toxicity.trigrams(words_)
    alone = [toxicity.trigrams([w])[0].tolist() for w in words_]
    assert sizes.tolist() == [1, 3, 4, 1] and grams.tolist() == [g for x in alone for g in x] and alone[0] == alone[3]


def test_toxicity_of_words_out_of_the_sample():
    """Spellings that no label showed are found by their trigrams."""
    rng = random.Random(7)
    rows = [(f"{' '.join(rng.choice('abcdefgh') * 3 for _ in range(20))} {'stinkface' + str(k % 40) if k % 4 == 0 else 'daisy' + str(k % 40)} end.", int(k % 4 == 0)) for k in range(800)]
    tagger = toxicity.fit(iter(rows))
    scores = tagger.scores(tagger.marginals([toxicity.segments(t) for t in ("aaa bbb stinkface77 end.", "aaa bbb daisy77 end.")]))
    assert scores[0] > 0.3 > scores[1]


def test_toxicity_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(4, None), (None, 1), (5, 1), (5, 0)], "doc_id long, toxic int")
    for docs, n in ((hard, 11), (none, 0)):
        for marks in (labels, labels.limit(0)):
            rows = toxicity.score_toxicity(docs, toxicity.train(docs, marks)).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)


def test_quality_views_agree_on_junk(spark):
    rng = random.Random(4)
    rows = []
    for k in range(500):
        good = k % 4 > 0
        w = [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(20, 80))]
        text = " ".join(w) + "." if good else " | ".join(x + "###" for x in w)
        rows.append((k, text, "en", f"s{k % 7}" if good else "junk", len(text), int(good)))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 2 == 0], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.score_quality(docs, model).collect()
    assert sum(r.predicted == rows[r.doc_id][5] for r in scored if r.doc_id % 2) / 250 > 0.97
    assert all(0 <= x <= 1 for r in scored for x in (r.score, r.content_score, r.metadata_score))


def test_quality_rounds_equal_brute_force(spark):
    """train() takes the rounds that plain loops over all rows would take, without a cap on the pool."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "##", "=="][: 4 if k % 3 else 6]) for _ in range(rng.randint(5, 60))), rng.choice(["en", "de", None]), f"s{rng.randint(0, 3) if k % 3 else 9}", rng.randint(0, 900)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 900, 2)], "doc_id long, quality int")
    model = quality.train(docs, labels, sure=0.6)
    known = [k for k in range(0, 900, 2) if not toxicity_held_out(k)]
    views = tuple(np.array(v) for v in zip(*[(quality.content_view(r[1]), quality.metadata_view(*r[2:])) for r in rows]))
    views = np.stack(views[0]), np.stack(views[1])
    y = np.array([float(k % 3 > 0) for k in range(900)])
    aside = np.array([__import__("zlib").crc32(f"aside {k}".encode()) % 4 == 0 for k in range(900)])
    train = np.array([k in set(known) for k in range(900)])
    rounds = []

    def brute_pool(weights):
        out = {}
        for view in (0, 1):
            for label in (0, 1):
                n, g = 0, 0.0
                for k in np.flatnonzero(~train):
                    p = [1 / (1 + np.exp(-quality.margin(weights[v], views[v][k][None])[0])) for v in (0, 1)]
                    if (p[1 - view] if label else 1 - p[1 - view]) >= 0.6:
                        n, g = n + 1, g + (label - p[view]) * np.concatenate([[1.0], views[view][k]])
                if n:
                    out[view, label] = n, g
        rounds.append({k: v[0] for k, v in out.items()})
        return out

    brute = quality.fit((views[0][train], views[1][train]), y[train], aside[train], brute_pool)
    assert len(rounds) == 2 and min(rounds[0].values()) > 20
    for k in (0, 1):
        assert np.allclose(model.views[k], brute.views[k], atol=1e-4)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert np.allclose([got[k] for k in range(900)], brute.scores(*views)[0], atol=1e-4)


def test_quality_without_metadata_columns(spark):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "## == ##", 1.5) for k in range(80)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    rows = quality.score_quality(docs, quality.train(docs, labels)).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in rows) == 80


def test_quality_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    for docs, n in ((hard, 11), (none, 0)):
        for marks in (labels, labels.limit(0)):
            assert quality.score_quality(docs, quality.train(docs, marks)).count() == n


def test_chat_folds_events(spark):
    e = "conv_id long, turn long, seq long, kind string, role string, text string, number long, formatted string"
    log = [
        (1, 0, 0, "message", "user", "helo"), (1, 0, 5, "edit", None, "hello"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "Hi"),
        (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "Good "), (1, 1, 6, "delta", None, "day"), (1, 2, 7, "message", "user", "x"), (1, 2, 8, "delete", None, None),
        (None, None, None, None, None, None), (2, 0, 0, "delta", "tool", "only"), (2, 1, 0, "edit", None, "lost"),
    ]
    messages = chat_format.fold(spark.createDataFrame([(*r, None, None) for r in reversed(log)], e))
    got = sorted((r.conv_id or 0, r.turn or 0, r.role, r.text) for r in messages.collect())
    assert got == [(0, 0, "", ""), (1, 0, "user", "hello"), (1, 1, "assistant", "Good day"), (2, 0, "tool", "only")]
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_messages(messages)).collect()}
    assert back[1].n_turns == 2 and back[1].loss_chars == 8 and back[1].loss_sha256 == hashlib.sha256(b"Good day").hexdigest()
    assert chat_format.read_back(chat_format.format_messages(messages.limit(0))).count() == 0


def test_chat_events_fold_back_to_the_turns(spark):
    """Streamed, regenerated and edited turns of a log, one conversation with most of it, come out as they were."""
    rows = [(7, t, "assistant" if t % 2 else "user", f"<|im_end|> text {t} ü🙂") for t in range(3000)] + [(8, 0, "user", None), (8, 0, "user", None), (8, 1, None, "x"), (None, None, "assistant", "y"), (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (9, 0, "system", "")]
    table = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, seq long, formatted string").repartition(4)
    events = chat_format.events_of(table)
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    messages = chat_format.fold(events)
    order = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in (r[0], r[1])) + (r[2] or "", r[3] or "")
    expected = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=order)
    assert sorted(((m.conv_id, m.turn, m.role, m.text) for m in messages.collect()), key=order) == expected
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_messages(messages)).collect()}
    for conv in {r[0] for r in rows}:
        own = [e for e in expected if e[0] == conv]
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert (back[conv].n_turns, back[conv].loss_chars) == (len(own), len(loss))
        assert back[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        assert back[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.fold(chat_format.events_of(table.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|im_end|>", "<\\\\|<|\\|", "<", "|>", "", "<|im_start|>assistant\nok<|im_end|>\n", "<<|<\\<|"])
def test_chat_escape_round_trip(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    formatted, start, end = chat_format.render("us\\er\nx<|", text)
    m = chat_format.MESSAGE.fullmatch(formatted)
    assert chat_format.unescape_role(m[1]) == "us\\er\nx<|" and chat_format.unescape(m[2]) == text
    assert chat_format.unescape(formatted[start:end]) == text and len(re.findall(r"<\|im_end\|>", formatted)) == 1


def test_near_duplicates_hard_rows(hard, none):
    rows = near_duplicates(hard).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == 11 and near_duplicates(none).count() == 0
    assert all(r.n_shingles == 0 and r.kept for k in (1, 2, 3) for r in by[k])
    assert {(r.n_shingles, r.component_id, r.kept) for r in by[4]} == {(1, 4, True)} and (by[5][0].component_id, by[5][0].kept) == (4, False)
    assert all(r.component_id is None and r.kept for r in by[None])
