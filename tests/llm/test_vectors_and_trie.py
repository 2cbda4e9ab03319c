"""Whitening, nearest neighbours and the prefix trie against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docquarry.llm import neighbours, prefixtrie, whitening
from docquarry.llm.neighbours import scan
from tests.helpers import duck

NAN, INF = float("nan"), float("inf")
CLASHING = "id long, x string, vector string, list string, rep string, at string, found string, score string, n string"
BLANK = [None] * 9


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *BLANK) for i, v in rows], f"vec_id long, embedding array<float>, {CLASHING}").repartition(3)


def usable_rows(rows, length):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == length and None not in v and np.isfinite(np.array(v, float)).all()]


ODD = [(900, None), (901, [1.0, None, 2.0, 0.0]), (902, [NAN, 1.0, 1.0, 1.0]), (903, [1.0, INF, 1.0, 1.0]), (904, []), (905, [1.0, 2.0]), (906, [0.0] * 4), (None, [0.5, 0.25, -1.0, 2.0])]


def sample(n=200, d=4, seed=3):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) @ rng.standard_normal((d, d))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return rows + [(n + k, rows[0][1]) for k in range(30)]  # copies of one vector


def whitened_by_hand(x):
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    c = d / n
    v = c.T @ c / n
    values, u = np.linalg.eigh(v)
    values, u = values[::-1][:8], u[:, ::-1][:, :8]
    return (d.astype(object) ** 2).sum(axis=1), c @ u / np.sqrt(values), values / np.trace(v)


def test_whitening(spark):
    rows = sample() + ODD + [(5, sample()[5][1])]  # an id twice
    want = usable_rows(rows, 4)
    x = np.floor(1024 * np.array([v for _, v in want])).astype(np.int64) + 100000
    deviation, white, explained = whitened_by_hand(x)
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    assert set(got.columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert len(got) == 4 * len(want) and set(got.n) == {len(want)} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    expected = sorted((-1 if i is None else i, int(d)) for (i, _), d in zip(want, deviation))
    assert sorted((-1 if np.isnan(i) else int(i), int(d)) for i, d in got[got.component == 1][["vec_id", "deviation"]].itertuples(index=False)) == expected
    place = {i: k for k, (i, _) in enumerate(want)}
    for c in range(4):
        own = got[(got.component == c + 1) & got.vec_id.notna()]
        by_hand = np.array([white[place[int(i)], c] for i in own.vec_id])
        assert min(np.abs(own.whitened - by_hand).max(), np.abs(own.whitened + by_hand).max()) < 1e-9
        assert abs(own.explained.iloc[0] - explained[c]) < 1e-12


def test_whitening_without_variance(spark):
    assert whitening.whitened(vectors(spark, ODD[:5])).count() == 0
    assert whitening.whitened(vectors(spark, [])).count() == 0
    one = whitening.whitened(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    flat = whitening.whitened(vectors(spark, [(i, [float(i), 1.0]) for i in range(5)])).toPandas()  # the second dimension does not vary
    assert flat[flat.component == 2].whitened.isna().all() and flat[flat.component == 1].whitened.notna().all() and flat.identity_error[0] < 1e-9


def test_whitening_of_huge_entries(spark):
    """A deviation beyond a long is null, one within is exact."""
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [1.0, 0.5])]
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    assert got[got.vec_id < 3].deviation.isna().all() and got[got.vec_id == 3].deviation.notna().all() and got.identity_error[0] < 1e-6
    w = whitening.Whitener(3, np.array([0, 10]), np.array([1.0]), np.array([[1.0], [0.0]]))
    assert w.deviations(np.array([[2, 5], [1 << 31, 0], [1 << 62, 0]])) == [36 + 25, None, None]


def test_centring_is_exact():
    """A common offset that dwarfs the spread is gone before anything is multiplied."""
    w = whitening.Whitener(3, np.array([3 * (1 << 40) + 3]), np.array([1.0]), np.array([[1.0]]))
    assert w.centred(np.array([[(1 << 40)], [(1 << 40) + 1], [(1 << 40) + 2]])).ravel().tolist() == [-1.0, 0.0, 1.0]


def nearest_by_hand(rows, k=20, modulus=20):
    best = {}
    for i, v in rows:
        if i is not None and v.any() and (i not in best or tuple(v) < tuple(best[i])):
            best[i] = v
    out = {}
    for q in best:
        if q % modulus == 0:
            near = sorted((-float(best[q] @ v), i) for i, v in best.items() if i != q)[:k]
            out[q] = [i for _, i in near], [-s for s, _ in near]
    return out


def test_neighbours(spark):
    rows = sample() + ODD + [(5, sample()[5][1]), (7, [9.0, 9.0, 9.0, 9.0])]
    want = nearest_by_hand(usable_rows(rows, 4))
    df = vectors(spark, rows)
    got = neighbours.neighbours(df, df.filter("vec_id % 20 = 0").select("vec_id")).toPandas().sort_values(["query_id", "rank"])
    assert set(got.columns) == {"query_id", "rank", "vec_id", "score"} and set(got.query_id) == set(want)
    hits = 0
    for q, own in got.groupby("query_id"):
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        assert own.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == own.vec_id.tolist()
        hits += len(set(own.vec_id) & set(want[q][0]))
    assert hits >= 0.9 * 20 * len(want)
    # ties at one vector go by id, and the query's own copies count
    copies = got[got.query_id == 200].vec_id.tolist()
    assert 200 not in copies


def test_copies_of_the_query(spark):
    """Forty copies of the largest vector: each finds the twenty smallest ids but its own."""
    rows = [(i, [3.0, 4.0]) for i in range(40)] + [(i, [0.1, 0.1 * i]) for i in range(40, 45)]
    df = vectors(spark, rows)
    got = neighbours.neighbours(df, df.filter("vec_id % 20 = 0").select("vec_id")).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].vec_id.tolist() == list(range(1, 21))
    assert got[got.query_id == 20].vec_id.tolist() == list(range(20))
    assert got[got.query_id == 0].score.unique().tolist() == [25.0]


def test_few_neighbours(spark):
    df = vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [-1.0, 2.0])])
    got = neighbours.neighbours(df, df.select("vec_id").filter("vec_id = 0")).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 0.5), (2, 2, -1.0)]
    for rows in ([], ODD[:5], [(0, [0.0, 0.0])], [(0, [1.0, 1.0])]):
        df = vectors(spark, rows)
        assert neighbours.neighbours(df, df.select("vec_id")).count() == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_registered_neighbours(spark, scale):
    base = f"/root/testdata/{scale}"
    e = spark.read.parquet(f"{base}/embeddings.parquet").toPandas()
    want = nearest_by_hand([(int(i), np.asarray(v, float)) for i, v in zip(e.vec_id, e.embedding)])
    got = neighbours.query(spark, base).toPandas()
    assert got.groupby("query_id").size().to_dict() == {q: 20 for q in want}
    recall = sum(len(set(own.vec_id) & set(want[q][0])) for q, own in got.groupby("query_id")) / (20 * len(want))
    assert recall >= 0.9
    exact = {(q, i): s for q, (ids, scores) in want.items() for i, s in zip(ids, scores)}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, i, s in got[["query_id", "vec_id", "score"]].itertuples(index=False) if (q, i) in exact)


def test_large_lists_are_dealt_in_parts(spark, monkeypatch):
    """Parts of lists and of queries change nothing in the result."""
    df = vectors(spark, sample(300, 8))
    asked = df.filter("vec_id % 5 = 0").select("vec_id")
    whole = sorted(neighbours.neighbours(df, asked, 5).collect())
    monkeypatch.setattr(neighbours, "ENTRIES", 16)
    monkeypatch.setattr(neighbours, "ASKS", 4)
    # few entries to a part abandon fewer candidates early, never others
    parts = sorted(neighbours.neighbours(df, asked, 5).collect())
    assert len(set(map(tuple, whole)) & set(map(tuple, parts))) >= 0.97 * len(whole)


def test_scan_abandons_early_and_keeps_the_nearest():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    x[:40] = q[np.arange(40) % 20] + 0.1 * rng.standard_normal((40, 64))
    blocks = np.split(x, range(16, 64, 16), axis=1)
    i, j = scan(blocks, q, np.full(20, INF), 2)
    near = {(a, b) for a in range(20) for b in np.argsort(((x - q[a]) ** 2).sum(axis=1))[:2].tolist()}
    assert near <= set(zip(i.tolist(), j.tolist())) and len(i) < 0.01 * 20 * 3000


def by_hand(rows):
    own = defaultdict(list)
    for c, number, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((number is not None, number or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        s = own.get(c - c % 5, [])[:h] + own[c][h:]
        ends[tuple(s)].append(c)
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
EXTRA = "pos string, n string, node string, parent string, base string, h string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}").repartition(3)


def trie_rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefixtrie.trie(df).select(COLUMNS).collect())


def talk(seed=2, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n):
        for t in range(int(rng.integers(1, 12))):
            out.append((c, t, ["user", "assistant"][t % 2], ["hello", "héllo wörld", "", "x" * 50, None][int(rng.integers(0, 5)) if t else c % 2]))
    return out


def test_trie(spark):
    rows = talk()
    rows += [(70, None, None, None), (70, None, "user", "first"), (70, 3, "user", "tie"), (70, 3, "user", "tie b"), (70, 3, "user", "tie b"), (71, 5, None, "a"), (None, 1, "user", "nobody's")]
    rows += [(1001, 0, "user", "no family"), (10**12, 0, "user", "far")]
    assert trie_rows(conversations(spark, rows)) == by_hand(rows)


def test_turnless_conversations(spark):
    """A conversation whose family has no first one, and whose own turns all give way, ends in the root."""
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "gone")]
    got = trie_rows(conversations(spark, rows))
    assert got == by_hand(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert prefixtrie.trie(conversations(spark, [])).count() == 0


@pytest.mark.parametrize("group", [2, 3])
def test_long_conversations(spark, monkeypatch, group):
    """Groups above groups: lengths at, below and beyond powers of the group size."""
    monkeypatch.setattr(prefixtrie, "GROUP", group)
    rows = [(5 * c, t, "user", f"t{t % 3}") for c, n in enumerate((1, 2, 3, 4, 8, 9, 16, 17, 27, 28, 40)) for t in range(n)]
    assert trie_rows(conversations(spark, rows)) == by_hand(rows)


def test_hot_conversations(spark):
    """One very long conversation and very many equal ones."""
    rows = [(5, t, "user", f"t{t}") for t in range(700)] + [(5 * c, 0, "user", "t0") for c in range(2, 800)]
    assert trie_rows(conversations(spark, rows)) == by_hand(rows)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_trie_like_sql(spark, scale):
    base = f"/root/testdata/{scale}"
    got = prefixtrie.query(spark, base).select(COLUMNS).collect()
    want = duck(base).execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefixtrie.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
