"""Licence scan over a positional rare-token index, DataFrame functions only.

The index is one map from a word to its postings (template, offset): every template is posted
under the two highest-IDF words of its key phrase.  A text's occurrences of indexed words are
looked up once; each posting says where its template would start, and starts that both of a
template's postings agree on are left; the mandatory key phrase is verified there; the rest
of the template is then scored by the IDF weight found in place.  The expressions are the same
for any number of templates; all work is inside a row, so no key can be hot, nothing is
shuffled and memory is bounded by one text.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str = ""  # mandatory phrase, the whole text if empty
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> tuple[int, int]:
        """First word and length of the key phrase in the template."""
        if not self.key:
            return 0, len(self.words)
        k = self.key.split()
        return next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k), len(k)


#: The contract's phrases, then notices of well-known licences, as normalised words.
TEMPLATES = [
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    Template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]


def idf(templates: list[Template]) -> dict[str, int]:
    """Inverse document frequency of each template word over the templates, in whole thousandths."""
    df = Counter(w for t in templates for w in set(t.words))
    return {w: round(1000 * math.log((len(templates) + 1) / n)) for w, n in df.items()}


def anchors(t: Template, weight: dict[str, int]) -> list[int]:
    """Offsets of the two highest-IDF words of the key phrase (ties: the earlier)."""
    at, size = t.key_at
    return sorted(sorted(range(at, at + size), key=lambda i: (-weight[t.words[i]], i))[:2])


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Null and empty texts have no words, no labels and score 0.  Every place counts, also
    repeated and overlapping ones; rows with the same id are scanned one by one; other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    weight = idf(templates)
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        for o in anchors(t, weight):
            postings.setdefault(t.words[o], []).append((k, o))
    entry = lambda k, o: F.struct(F.lit(k).alias("t"), F.lit(o).alias("o"))
    index = F.create_map(*[x for w, of in sorted(postings.items()) for x in (F.lit(w), F.array(*[entry(*p) for p in of]))])
    per_template = lambda values: F.array(*values)
    keys = per_template(F.array(*map(F.lit, t.words[t.key_at[0] : sum(t.key_at)])) for t in templates)
    key_at = per_template(F.lit(t.key_at[0]) for t in templates)
    wanted = per_template(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(weight[w]).alias("v")) for w in t.words]) for t in templates)
    total = per_template(F.lit(float(sum(weight[w] for w in t.words))) for t in templates)

    base = docs.select(docs[id_col].alias("__id"), words(docs[text_col]).alias("__w"))
    rare = F.filter(F.transform("__w", lambda w, i: F.when(w.isin(sorted(postings)), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    starts = lambda x: F.transform(F.element_at(index, x.w), lambda p: F.struct(p.t.alias("t"), (x.i - p.o).alias("s")))
    found = base.select("__id", "__w", F.sort_array(F.flatten(F.transform(rare, starts))).alias("__c"))
    # A template of one word has one posting; all others need two that agree.
    single = [k for k, t in enumerate(templates) if len(anchors(t, weight)) == 1]
    agreed = F.filter("__c", lambda c, i: (c.t.isin(single) if single else F.lit(False)) | ((i > 0) & (c == F.get("__c", i - 1))))
    key_of = lambda c: F.get(keys, c.t)
    at = lambda c: c.s + F.get(key_at, c.t)
    verified = F.filter("__p", lambda c: (at(c) >= 0) & (F.slice("__w", F.greatest(at(c), F.lit(0)) + 1, F.size(key_of(c))) == key_of(c)))
    hit = found.select("__id", "__w", agreed.alias("__p")).select("__id", "__w", verified.alias("__p"))

    def in_place(c: Column) -> Column:
        """Share of the template's IDF weight that stands where it should."""
        each = F.transform(F.get(wanted, c.t), lambda x, j: F.when((c.s + j >= 0) & F.get("__w", c.s + j).eqNullSafe(x.w), x.v).otherwise(0))
        return F.aggregate(each, F.lit(0), lambda a, v: a + v) / F.get(total, c.t)

    own = [k for k, t in enumerate(templates) if t.base]
    names = per_template(F.lit(t.label) for t in templates)
    every = F.transform(F.filter("__p", lambda c: c.t.isin(own)), lambda c: c.s)
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda c: F.get(names, c.t)))), ",")
    result = hit.select(
        "__id", F.size("__w").cast("long").alias("n_words"), F.col("__p"), every.alias("__own"),
        F.when(F.size("__p") > 0, F.array_max(F.transform("__p", in_place))).otherwise(F.lit(0.0)).alias("score"),
    )
    return result.select(
        F.col("__id").alias(id_col), "n_words",
        F.size("__own").cast("long").alias("n_base"),
        F.array_min("__own").cast("long").alias("first_word"),
        F.array_max("__own").cast("long").alias("last_word"),
        labels(F.filter("__p", lambda c: c.t.isin(own))).alias("base_labels"),
        labels(F.col("__p")).alias("labels"),
        "score",
    )
