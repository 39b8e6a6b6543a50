"""Phrase collocations by relational mining of occurrence relations (SETM).

R1 holds (document, position, word) of every frequent word, a border between pieces taking a
position of its own, so that neighbours of one piece, and no others, stand at adjacent
positions.  It is stored bucketed by document and sorted by position.  R1 merge-joined with
itself at the next position gives the pairs; they are grouped and counted; those of a frequent
group are stored, sorted alike, as R2.  R2 merge-joined with itself at the next position gives
phrases of three words, both of whose pairs are frequent, and so on: each length is extended
only from the frequent groups of the length before.  All joins of occurrences find both sides
already in their places, so text is shuffled once, to the buckets, and then only counts are.

A phrase is known by its number among the frequent ones of its length and a longer one by the
numbers of its first and last words but one: exact, with no hash of texts.  Words and phrases
are counted by language; the numbers differ between languages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_stored, prepare, shared_dir, stored

#: Frequent groups up to this number of rows and bytes are sent to the tasks; more are joined by a shuffle.
SENT_ROWS, SENT_BYTES = 1_000_000, 64 << 20
#: A language's phrases are ranked in so many parts first.
PARTS = 64
BORDER = "\n"


def tokens(text: Column) -> Column:
    """Words of a text in order, a border between pieces as a line feed; their letters' case is kept."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), r"[.,;:!?\x0A-\x0D]+", f" {BORDER} ")
    return F.split(apart, "[ \t]+")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, lang, pos, word) of every word; ``doc`` numbers the rows of docs."""
    each = docs.select("doc", "lang", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))
    return each.filter(f"word NOT IN ('', '{BORDER}')")


def frequent_groups(counts: DataFrame, least: int, where: str, name: str) -> DataFrame:
    """The groups counted ``least`` times or more, stored with a number of their own each."""
    return stored(counts.filter(F.col("a") >= least).withColumn("id", F.monotonically_increasing_id()), where, name)


def semi_joined(rows: DataFrame, groups: DataFrame, on: list[str], buckets: int) -> DataFrame:
    """rows of a frequent group, with its number; in their buckets."""
    size = groups.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(c) for c in on if dict(groups.dtypes)[c] == "string"]).first()
    if size.n <= SENT_ROWS and sum(size[1:]) <= SENT_BYTES:
        return rows.join(F.broadcast(groups), on)
    return rows.join(groups.hint("merge"), on).repartition(buckets, "doc")


class Relation:
    """An occurrence relation (doc, pos, id) as a table bucketed by doc and sorted by position.

    Runs of documents and dictionaries of positions and numbers keep it small without a codec.
    """

    def __init__(self, rows: DataFrame, where: str, name: str, buckets: int):
        self.spark, self.name = rows.sparkSession, f"indicant_{name}_{uuid.uuid4().hex}"
        writer = rows.select("doc", "pos", "id").write.bucketBy(buckets, "doc").sortBy("doc", "pos")
        writer.option("path", f"{where}/{name}").option("compression", "none").format("parquet").saveAsTable(self.name)

    def next_to_itself(self) -> DataFrame:
        """(doc, pos, first, last): every occurrence and that at the next position, by a merge join."""
        one = self.spark.table(self.name).withColumnRenamed("id", "first")
        two = self.spark.table(self.name).select("doc", (F.col("pos") - 1).alias("pos"), F.col("id").alias("last"))
        return one.join(two.hint("merge"), ["doc", "pos"])

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class co_located:
    """While it lasts, tables bucketed by one of the join's keys count as in their places.  The session's own setting is put back."""

    KEY = "spark.sql.requireAllClusterKeysForCoPartition"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(self.KEY)
        self.conf.set(self.KEY, "false")

    def __exit__(self, *_):
        self.conf.set(self.KEY, self.before)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, written, word, a) of every word as it is written, and in lower case: the text's letters are not all turned."""
    counts = occurrences(docs.withColumn("doc", F.lit(0))).groupBy("lang", "word").agg(F.count("*").alias("a"))
    return counts.select("lang", F.col("word").alias("written"), ascii_lower(F.col("word")).alias("word"), "a")


def frequent_phrases(docs: DataFrame, least: int, longest: int, where: str) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of every frequent phrase, single words too, and (lang, n).  docs has lang and text."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = stored(word_counts(docs), where, "words")
    totals = stored(counts.groupBy("lang").agg(F.sum("a").alias("n")), where, "totals")
    groups = frequent_groups(counts.groupBy("lang", "word").agg(F.sum("a").alias("a")), least, where, "groups1")
    found = groups.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "a")
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), "lang", "text")
    placed = occurrences(numbered.repartition(buckets, "doc").sortWithinPartitions("doc"))
    forms = stored(counts.select("lang", "written", "word").join(groups.select("lang", "word", "id"), ["lang", "word"]).select("lang", F.col("written").alias("word"), "id"), where, "forms")
    relation = Relation(semi_joined(placed, forms, ["lang", "word"], buckets), where, "r1", buckets)
    texts = groups.select("id", "lang", F.array("word").alias("words"))
    with co_located(spark):
        for size in range(2, longest + 1):
            pairs = relation.next_to_itself()
            grouped = pairs.groupBy("first", "last").agg(F.count("*").alias("a"))
            groups = frequent_groups(grouped, least, where, f"groups{size}")
            last = texts.select(F.col("id").alias("last"), F.element_at("words", -1).alias("word"))
            named = groups.join(texts.select(F.col("id").alias("first"), "lang", "words"), "first").join(last, "last")
            texts = stored(named.select("id", "lang", F.concat("words", F.array("word")).alias("words"), "a"), where, f"phrases{size}")
            found = found.union(texts.select("lang", F.array_join("words", " "), F.lit(size), "a"))
            if size == longest or not groups.limit(1).count():
                break
            extended = Relation(semi_joined(pairs, groups.select("first", "last", "id"), ["first", "last"], buckets), where, f"r{size}", buckets)
            relation.drop()
            drop_stored(spark, f"{where}/r{size - 1}")
            relation = extended
    relation.drop()
    return found, totals


def without_parts(phrases: DataFrame) -> DataFrame:
    """Candidates of two words or more that stand in no longer one counted as often.

    What stands in a longer one as often stands in one with a single word more as often, so
    a look at those is enough.
    """
    words = F.split("phrase", " ")
    ends = F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))
    inside = phrases.filter("size > 2").select("lang", F.explode(ends).alias("phrase"), F.col("a").alias("within")).groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    return phrases.filter("size > 1").join(inside, ["lang", "phrase"], "left").filter("within IS NULL OR within < a").drop("within")


def scored(candidates: DataFrame, phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the lowest floor(1000 * a * n / (l * r)) over all cuts, in 38 digits."""
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = phrases.select("lang", "phrase", "a")
    both = sides.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    both = both.join(F.broadcast(totals), "lang")  # a row a language
    exact = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    score = F.expr(f"({exact('a')} * {exact('n')} * 1000) div ({exact('l')} * {exact('r')})")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def ranked(rows: DataFrame, first: int) -> DataFrame:
    """The first rows of each language with their rank; of each part of a language no more go on."""
    from pyspark.sql import Window

    order = [F.desc("score"), F.desc("a"), "phrase"]
    rank = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", rank(["lang", "part"])).filter(F.col("rank") <= first).drop("part")
    return some.withColumn("rank", rank(["lang"]).cast("long")).filter(F.col("rank") <= first)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's collocations by falling score.

    Words are lower-cased in A to Z; pieces end at . , ; : ! ? and line ends.  n counts all
    words of the language, a, l and r all places of the phrase and of its two sides at the
    cut that scores least (of equal ones the first).  Null texts have no words, a null
    language is ``und``; repeated rows count each; other columns are ignored; an empty table
    and one without frequent phrases give no rows.  A score that passes 64 bits raises.
    """
    spark = prepare(docs.sparkSession)
    where = shared_dir(spark)
    chosen = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    phrases, totals = frequent_phrases(chosen, least, longest, where)
    result = ranked(scored(without_parts(phrases), phrases, totals), first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    kept = stored(result, f"{where}-result", "collocations")
    drop_stored(spark, where)  # only the small result stays, for the cluster's cleaner
    return kept
