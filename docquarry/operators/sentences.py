"""Sentence boundaries learned from the texts themselves: abbreviations and sentence starters by log-likelihood.

A word is an abbreviation if it stands with a full stop far more often than full stops occur, weighted by how short it is, how many stops it holds and how
often it stands without one.  A word is a starter if it stands after sentence ends far more often than elsewhere.  Both are Spark aggregates over words;
what is learned is small and goes to the splitter, which is a hook of the chunker.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, with stops inside it, and the stop after it.
WORD = r"\p{L}+(?:[.]\p{L}+)*[.]?"
#: Least score of an abbreviation and of a starter; share of stops after an abbreviation (values of the published method).
ABBREVIATION, STARTER, SURE = 0.3, 30.0, 0.99
#: A starter is met this often after an end, at least; words learned at most, those with the highest scores.
LEAST_STARTS, MOST_WORDS = 3, 100_000


def _pairs(texts: DataFrame, text_col: str) -> DataFrame:
    """(x, before): each word and the one before it."""
    w = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    return texts.select(w.alias("w")).select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("x"), F.get("w", i - 1).alias("before")))).alias("p")).select("p.*")


def _type(c: str) -> Column:
    return F.lower(F.regexp_replace(c, "[.]$", ""))


def words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, n, stopped): words in lower case without their stop, how often they occur and how often with one."""
    x = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    each = texts.select(F.explode(x).alias("x"))
    return each.groupBy(_type("x").alias("type")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("x").endswith(".")).cast("double").alias("stopped"))


def _log_likelihood(n: Column, hits: Column, p: Column, sure: float) -> Column:
    """How much better a share of `sure` explains hits of n than the share p does."""
    free = hits * F.log(p) + (n - hits) * F.log(1 - p)
    return -2 * (free - (hits * F.log(F.lit(sure)) + (n - hits) * F.log(F.lit(1 - sure))))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(type, n, stopped, score) of counts as by words(), for words that ever had a stop."""
    all_ = counts.agg(F.sum("n").alias("all"), F.sum("stopped").alias("stops"))
    t = counts.filter("stopped > 0").crossJoin(F.broadcast(all_))  # one row
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    p = F.least(F.col("stops") / F.col("all"), F.lit(0.999999))
    score = _log_likelihood(F.col("n"), F.col("stopped"), p, SURE) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -(F.col("n") - F.col("stopped")))
    return t.select("type", F.col("n").cast("long").alias("n"), F.col("stopped").cast("long").alias("stopped"), F.round(score, 6).alias("score"))


def starters(texts: DataFrame, counts: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, n, starts, score): words that stand, with a capital, after a sentence's end more often than elsewhere; a stop of an abbreviation (known: type) is no end."""
    after = _pairs(texts, text_col).filter(F.col("before").endswith(".")).select("x", _type("before").alias("type")).join(known.select("type"), "type", "left_anti")
    ends = after.agg(F.count("*").cast("double").alias("ends"))
    capital = F.substring("x", 1, 1) != F.lower(F.substring("x", 1, 1))
    starts = after.filter(capital).groupBy(_type("x").alias("type")).agg(F.count("*").cast("double").alias("starts")).filter(F.col("starts") >= LEAST_STARTS)
    all_ = counts.agg(F.sum("n").alias("all")).crossJoin(ends)
    t = starts.join(counts, "type").join(known.select("type"), "type", "left_anti").crossJoin(F.broadcast(all_))  # one row
    held = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    ll = lambda k, n, p: k * F.log(held(p)) + (n - k) * F.log(1 - held(p))
    k, e, others = F.col("starts"), F.col("ends"), F.greatest(F.col("all") - F.col("ends"), F.lit(1.0))
    rest, both = F.col("n") - k, F.col("n") / F.col("all")
    score = -2 * (ll(k, e, both) + ll(rest, others, both) - ll(k, e, k / e) - ll(rest, others, rest / others))
    return t.filter(k / e > both).select("type", F.col("n").cast("long").alias("n"), k.cast("long").alias("starts"), F.round(score, 6).alias("score"))


_END = re.compile(r"[.!?][\"'”’)\]»]*\s+")
_LAST = re.compile(r"((?:[^\W\d_]+[.])*[^\W\d_]+|\d+)[.][\"'”’)\]»]*$")
_FIRST = re.compile(r"[\"'“‘(\[«]*([^\W\d_]+|\d)")


@dataclass(frozen=True)
class SentenceModel:
    abbreviations: frozenset
    starters: frozenset

    @classmethod
    def learn(cls, texts: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> "SentenceModel":
        """From all texts; null texts count as empty."""
        counts = words(texts, text_col).persist()
        a = abbreviations(counts).filter(F.col("score") >= ABBREVIATION)
        s = starters(texts, counts, a, text_col).filter(F.col("score") >= STARTER)
        names = lambda df: frozenset(r["type"] for r in df.orderBy(F.desc("score"), "type").limit(most).collect())
        out = cls(names(a), names(s))
        counts.unpersist()
        return out

    def ends(self, before: str, after: str) -> bool:
        """Whether a sentence ends between what comes before white space, which ends with a mark, and what comes after."""
        last, first = _LAST.search(before), _FIRST.match(after)
        if last is None:
            return True  # an exclamation or question mark, or a stop after no word
        word, low = first[1] if first else "", last[1].lower()
        if last[1].isdigit():
            return not word[:1].islower()  # an ordinal number goes on in lower case
        if low in self.abbreviations or len(low) == 1:  # no sentence ends after an initial; after a small letter one does where a starter follows
            return word[:1].isupper() and word.lower() in self.starters and not (len(low) == 1 and last[1].isupper())
        return not word[:1].islower()

    def split(self, text: str) -> list[str]:
        """Sentences of a text, without the white space around them."""
        out, start = [], 0
        for m in _END.finditer(text):
            if self.ends(text[max(start, m.end() - 200) : m.end()].rstrip(), text[m.end() : m.end() + 100]):
                out.append(text[start : m.end()].strip())
                start = m.end()
        return [s for s in [*out, text[start:].strip()] if s]
