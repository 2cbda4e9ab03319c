"""Quality rules (operator 10): Jensen-Shannon distance to language references, in DataFrame functions alone.

Each document gives two histograms: character classes (letters, capitals, digits, white space, symbols, the rest) and the
common words of its language.  A language's common words are the `common` words that most of its documents hold, counted over
all documents.  The reference of a language is the sum of these histograms over all documents of that
language which pass the base rules.  A document fails if the Jensen-Shannon distance (square root of the divergence with
base-2 logarithms, 0 to 1) of either histogram to its reference exceeds a threshold; texts with fewer characters or words
than the guards are not judged by that histogram, since short samples lie far from any reference.

One pass over the texts counts words by language, pre-aggregated before the shuffle, and keeps the first few; a second makes
a narrow table of counts (no text).  References are a pre-aggregated sum over that, and joining them back needs no text either.
Lists and references are joined as tables: they are broadcast where Spark measures that they are small.

Base rules: fewer than 50 words, or more than half the words inside 3-word windows that occur twice or more, fail.  Such
words are found in a document's own sorted window hashes: the low bits of each hash hold the window's position, neighbours
with equal high bits are compared word by word.

Defined cases: a null or empty text has counts of 0 and fails the base rules; a null language is a language of its own; a
language whose texts have no letters has no common words and is judged by character classes alone; a null doc_id stays null;
repeated rows are each judged; an empty table gives no rows; other columns are ignored.  A text of any length is judged whole;
its words are one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, read_documents

WORD = r"[^\x20\x09-\x0D]+"

LETTERS = r"\p{L}+"


def _let(value, body):
    """body(value) with value computed once: a lambda variable is evaluated once, a repeated expression again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts):
    """Words in windows of 3 that begin at the (distinct) starts."""

    def count(p):
        following = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(following, F.lit(0).cast("long"), lambda s, x: s + x)

    return _let(F.sort_array(starts), count)


def repeat_words(words):
    """Number of words in 3-word windows that occur twice or more in the array."""

    def by_words(w):
        n = F.size(w)
        # position bits: the smallest 2^k - 1 that holds every position
        mask = F.expr("0L") + F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - F.lit(1).cast("long")

        def by_mask(m):
            keys = F.transform(
                F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")),
            )

            def by_keys(s):
                def same(a, b):
                    p, q = a.bitwiseAND(m).cast("int"), b.bitwiseAND(m).cast("int")
                    alike = a.bitwiseAND(F.bitwise_not(m)) == b.bitwiseAND(F.bitwise_not(m))
                    equal = (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))
                    return F.coalesce(alike & equal, F.lit(False))

                pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), same)
                return _let(
                    pairs,
                    lambda e: _covered(
                        F.transform(
                            F.filter(s, lambda x, k: F.get(e, k) | F.coalesce(F.get(e, k - 1), F.lit(False))),
                            lambda x: x.bitwiseAND(m),
                        )
                    ),
                )

            return _let(F.sort_array(keys), by_keys)

        return _let(mask, by_mask)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(words, by_words))


def _left(text, pattern):
    """Characters of text that a run of `pattern` does not take."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def common_words(docs: DataFrame, common: int, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(list_lang, own): for each language the words that most of its documents hold, in that order; ties by word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(LETTERS), F.lit(0)))
    held = docs.select(F.col(lang_col).cast("string").alias("lang"), F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    first = held.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= common)
    lists = first.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("l"))
    return lists.select(F.col("lang").alias("list_lang"), F.transform("l", lambda x: x["word"]).alias("own"))


def measures(docs: DataFrame, lists: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One narrow row per document: base measures and both histograms.  lists: (list_lang, own), see common_words()."""
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    )
    d = d.join(lists, F.col("lang").eqNullSafe(F.col("list_lang")), "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    d = d.withColumns({"w": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))})
    letters = F.regexp_extract_all(F.lower("t"), F.lit(LETTERS), F.lit(0))
    own = F.col("own")

    def counts(all_words):
        hits = F.filter(all_words, lambda x: F.array_contains(own, x))
        of = _let(hits, lambda h: F.transform(own, lambda c: F.size(F.filter(h, lambda x: x == c)).cast("long")))
        return _let(of, lambda c: F.concat(c, F.array(F.size(all_words).cast("long") - F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x))))

    d = d.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length("t").cast("long").alias("n_chars"),
        _left(F.col("t"), r"[\x20\x09-\x0D]+").alias("word_chars"),
        _left(F.col("t"), r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        _left(F.col("t"), r"[^\p{L}]+").alias("n_letters"),
        _left(F.col("t"), r"[^\p{Lu}]+").alias("n_upper"),
        _left(F.col("t"), r"[^\p{Nd}]+").alias("n_digits"),
        _let(letters, counts).alias("word_hist"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lower = F.col("n_letters") - F.col("n_upper")
    space = F.col("n_chars") - F.col("word_chars")
    rest = F.col("n_chars") - F.col("n_letters") - F.col("n_digits") - space - F.col("n_symbols")
    return d.withColumns({"base_failed": failed, "class_hist": F.array(lower, F.col("n_upper"), F.col("n_digits"), space, F.col("n_symbols"), rest)})


def _sums(column: str, n: int):
    return F.array(*[F.sum(F.coalesce(F.get(F.col(column), F.lit(i)), F.lit(0))) for i in range(n)])


def js_distance(p, q):
    """Square root of the Jensen-Shannon divergence of two count arrays; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def both(a, sa, b, sb):
        parts = F.zip_with(a, b, lambda x, y: F.struct((x / sa).alias("x"), (y / sb).alias("y")))
        halves = F.transform(parts, lambda s: term(s["x"], (s["x"] + s["y"]) / 2) + term(s["y"], (s["x"] + s["y"]) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), total(halves) / 2))

    a, b = F.transform(p, lambda x: x.cast("double")), F.transform(q, lambda x: x.cast("double"))
    return F.when((total(a) > 0) & (total(b) > 0), both(a, total(a), b, total(b)))


def rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = 0.25,
    max_word_distance: float = 0.35,
    min_chars: int = 200,
    min_words: int = 50,
    common: int = 12,
) -> DataFrame:
    """Base measures, both distances and the verdict for every document."""
    lists = materialise(common_words(docs, common, text_col=text_col, lang_col=lang_col), "common")
    m = materialise(measures(docs, lists, id_col=id_col, text_col=text_col, lang_col=lang_col), "quality")
    width = 1 + common
    refs = m.filter(~F.col("base_failed")).groupBy("lang").agg(_sums("class_hist", 6).alias("ref_class"), _sums("word_hist", width).alias("ref_words"))
    refs = refs.withColumnRenamed("lang", "ref_lang")
    out = m.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    words = F.slice("ref_words", 1, F.greatest(F.size("word_hist"), F.lit(1)))
    # the last place holds all other words, whatever the length of the language's list
    judged = lambda guard, d, most: F.coalesce(~(guard & (F.round(d, 9) > most)), F.lit(True))
    out = out.withColumns({"class_distance": js_distance(F.col("class_hist"), F.col("ref_class")), "word_distance": F.when(F.size("word_hist") > 1, js_distance(F.col("word_hist"), words))})
    good = judged(F.col("n_chars") >= min_chars, F.col("class_distance"), max_class_distance) & judged(F.col("n_words") >= min_words, F.col("word_distance"), max_word_distance)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & good).alias("kept"),
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(read_documents(spark, sf_dir))


def _js_sql(p: str, q: str) -> str:
    """Distance of two lists of counts of one length."""
    x, y = f"(({p})[i] / list_sum({p})::double)", f"(({q})[i] / list_sum({q})::double)"
    term = lambda z: f"CASE WHEN {z} > 0 THEN {z} * log2({z} / (({x} + {y}) / 2)) ELSE 0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0::double, list_sum([{term(x)} + {term(y)} for i in range(1, len({p}) + 1)]) / 2)) END"


def _oracle() -> str:
    width = 13
    sums = lambda c, n: "[" + ", ".join(f"sum(coalesce({c}[{i}], 0))::bigint" for i in range(1, n + 1)) + "]"
    left = lambda pattern: f"length(regexp_replace(t, '{pattern}', '', 'g'))::bigint"
    return rf"""
WITH v AS (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+'))) AS word FROM documents),
v2 AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM v GROUP BY lang, word QUALIFY r <= 12),
v3 AS (SELECT lang AS list_lang, list(word ORDER BY r) AS own FROM v2 GROUP BY lang),
d AS (SELECT doc_id, lang, coalesce(text, '') AS t, coalesce(own, []::varchar[]) AS own FROM documents LEFT JOIN v3 ON lang IS NOT DISTINCT FROM list_lang),
e AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(lower(t), '\p{{L}}+') AS letters,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)]) AS g FROM e WHERE len(w) >= 3),
r AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT e.doc_id, lang, len(w)::bigint AS n_words, length(t) AS n_chars, {left(r"[\x20\x09-\x0D]+")} AS word_chars, {left(r"[^#*$%&|<>]+")} AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(c.n, 0)::bigint AS n_repeat_words, {left(r"[^\p{L}]+")} AS n_letters,
        {left(r"[^\p{Lu}]+")} AS n_upper, {left(r"[^\p{Nd}]+")} AS n_digits, [len(list_filter(letters, lambda x: x = o)) for o in own] AS hits, len(letters) AS n_letter_words
      FROM e LEFT JOIN c USING (doc_id)),
h AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_append(hits, n_letter_words - coalesce(list_sum(hits), 0)::bigint) AS word_hist,
        [n_letters - n_upper, n_upper, n_digits, n_chars - word_chars, n_symbols, n_chars - n_letters - n_digits - (n_chars - word_chars) - n_symbols] AS class_hist FROM m),
f AS (SELECT lang AS ref_lang, {sums("class_hist", 6)} AS ref_class, {sums("word_hist", width)} AS ref_words FROM h WHERE NOT base_failed GROUP BY lang),
j AS (SELECT *, ref_words[1:len(word_hist)] AS rw FROM h LEFT JOIN f ON lang IS NOT DISTINCT FROM ref_lang),
k AS (SELECT *, {_js_sql("class_hist", "ref_class")} AS cd, CASE WHEN len(word_hist) > 1 THEN {_js_sql("word_hist", "rw")} END AS wd FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(NOT (n_chars >= 200 AND round(cd, 9) > 0.25), true) AND coalesce(NOT (n_words >= 50 AND round(wd, 9) > 0.35), true) AS kept,
       round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM k"""


ORACLE_SQL = _oracle()
