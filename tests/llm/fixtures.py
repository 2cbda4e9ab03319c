"""Small documents with the awkward cases, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import types as T

#: Names that the operators use for columns of their own.
CLASHING = ["t", "w", "th", "doc", "p", "n", "rep", "node", "a", "b", "h", "l", "rid", "size", "shard", "extra", "carried", "twin", "runs", "node_id", "score"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)

EN = "the quick brown fox jumps over lazy dogs while seven wizards quietly measure bright golden lamps near old stone bridges and rivers".split()
DE = "der schnelle braune fuchs springt über den faulen hund während sieben zauberer leise helle goldene lampen nahe alter brücken messen und".split()


def words(rng, vocabulary, n):
    return [rng.choice(vocabulary) + (rng.choice([".", ",", "\n", ""]) if rng.random() < 0.2 else "") for _ in range(n)]


def rows(seed=5, n=60):
    """(doc_id, text, lang): copies, near copies, shared passages, repeats and empties."""
    rng = random.Random(seed)
    out = []
    passage = words(rng, [w + str(i) for i, w in enumerate(EN)], 70)
    for i in range(n):
        lang, vocabulary = ("en", EN) if i % 3 else ("de", DE)
        own = words(rng, [f"{w}{rng.randrange(30)}" if rng.random() < 0.5 else w for w in vocabulary * 4], rng.choice([3, 20, 80, 160, 400]))
        if i % 5 == 1:
            k = rng.randrange(len(own) + 1)
            own[k:k] = passage[: rng.choice([40, 52, 70])]
        out.append([i, " ".join(own), lang])
    for i in range(0, n, 7):  # near copies with one or two words changed
        w = out[i][1].split(" ")
        for _ in range(1 + i % 2):
            w[rng.randrange(len(w))] = "changed" + str(i)
        out.append([len(out), " ".join(w), out[i][2]])
    out += [[len(out) + k, out[3][1], out[3][2]] for k in range(6)]  # copies
    out += [[len(out), "x y " * 150, "en"], [len(out) + 1, "spam " * 200, "en"], [len(out) + 2, "ab" * 300, "de"], [len(out) + 3, "Ünïcödé   \t\x0b text\r\n\n" * 30, None]]
    out += [[len(out), None, "en"], [len(out) + 1, "", None], [len(out) + 2, " \n\t", "de"], [len(out) + 3, "12 34 !!", "en"], [len(out) + 4, "four words are here", "en"]]
    out += [[None, out[4][1], "en"], [None, None, None], list(out[5]), list(out[5])]  # no id; one row three times
    return [tuple(r) for r in out]


def frame(spark, data, partitions=3):
    full = [(d, t, lang, None if d is None else f"s{d % 3}", None if t is None else len(t), *["x"] * len(CLASHING)) for d, t, lang in data]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def removed(units: dict, length: int) -> dict:
    """Positions removed from each document: covered by a window that also starts in a smaller document."""
    first: dict = {}
    for d in sorted(units):
        for i in range(len(units[d]) - length + 1):
            first.setdefault(tuple(units[d][i : i + length]), d)
    out = {}
    for d, u in units.items():
        gone = set()
        for i in range(len(u) - length + 1):
            if first[tuple(u[i : i + length])] < d:
                gone.update(range(i, i + length))
        out[d] = gone
    return out


def near_components(data, width=5, percent=75):
    """doc_id -> smallest reachable doc_id, and set sizes."""
    sets = {}
    for d, t, _ in data:
        w = tokens(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(d for d in sets if d is not None)
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def base_measures(text):
    x = text or ""
    w = tokens(x)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(tri)
    inside = {k for i, g in enumerate(tri) if count[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [s for s in x.split("\n") if tokens(s)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(inside)
