"""Quality rules, whitening and periodic runs against plain brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from driftsim.llm import quality, queries, runs, whitening
from tests.llm.helpers import awkward, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward()).repartition(3).persist()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# Periodic runs


def runs_of(words, least=6, times=4):
    best = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n = rng.choice([0, 1, 2, 5, 9, 30, 60])
            words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 8)
                words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
            texts.append(words)
        least, times = rng.choice([(6, 4), (2, 2), (3, 3)])
        first = np.cumsum([0] + [len(t) for t in texts])
        found = runs.periodic_runs(np.array(sum(texts, []), np.int64), first, least, times)
        got = list(zip(*(x.tolist() for x in found), strict=True))
        assert got == [(a + f, a + f + n, q) for t, f in zip(texts, first.tolist()) for a, n, q in runs_of(t, least, times)]


def test_collapse_runs(spark):
    rng = random.Random(2)
    base = awkward()
    for k in range(30):
        words = prose(rng, rng.randint(1, 6)).split()
        base.append((100 + k, prose(rng, 20) + " ".join(words * rng.randint(3, 9)) + "\n" + prose(rng, 10)))
    docs = table(spark, base).repartition(3)
    found = runs.collapse_runs(docs)
    assert found.select("document.*").columns == docs.columns
    got, want = [], []
    for r in found.collect():
        got.append((r.document.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed))
        words = WORD.findall(r.document.text or "")
        have = runs_of(words)
        want.append((r.document.doc_id, len(words), have, collapsed(words, have)))
    assert got == want
    assert sum(bool(r[2]) for r in got) > 20
    assert runs.collapse_runs(docs.limit(0)).count() == 0


def test_long_texts_of_few_words():
    for words in (np.zeros(300_000, np.int64), np.arange(300_000) % 1000):
        start, end, period = runs.periodic_runs(words, np.array([0, len(words)]))
        assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [300_000], [int(words.max()) + 1])


def test_periodic_runs_query(spark, tmp_path):
    texts = [(n, f"{n} " + prose(random.Random(n), 5 + n % 90)) for n in range(300)]
    table(spark, [*texts, *awkward()[:6], (None, "a " * 20), (None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.table(spark, str(tmp_path), "documents").collect()
    want = []
    for r in rows:
        words = WORD.findall(r.text or "")
        h = 1 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = runs_of(words)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None,) * 3
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{n},{q}\n" for a, n, q in found), collapsed(words, found))]
        want.append((r.doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert ordered(got) == ordered(want)
    assert sum(r[1] > 0 for r in got) > 15


# Quality


def test_plain_figures(docs):
    texts = [r.text for r in docs.collect()] + ["a b c d e a b c d e", "x\nx \nx\n\n\n \nx", "é#*ü $%&|<>\nq", "a b c d e f g a b c d e f g h"]
    found = quality.plain_figures(pa.array(texts))
    failed = quality.base_failed(found).tolist()
    for k, text in enumerate(texts):
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again))
        assert tuple(v[k] for v in found.values()) == want, text
        assert failed[k] == (len(words) < 10 or 100 * len(again) > 20 * len(words))


def test_rate_quality_against_plain_multinomials(spark):
    rng = random.Random(3)
    good = [(k, prose(rng, 60, "abcdef")) for k in range(200)]
    bad = [(200 + k, prose(rng, 60, "uvwxyz").replace(" ", "!! ")) for k in range(60)]
    docs = table(spark, [*good, *bad, *[(500 + k, t) for k, (_, t) in enumerate(awkward()[:21])], (None, good[0][1]), (7, good[7][1])]).repartition(3)
    trusted = spark.createDataFrame([(k,) for k in range(0, 200, 2)] + [(None,), (0,), (9999,)], "doc_id long")
    found = quality.rate_quality(docs, trusted)
    assert found.select("document.*").columns == docs.columns
    rows = found.collect()

    def slots_of(text):
        return quality.ngram_slots(pa.array([text], pa.string()))[0].tolist()

    def grams(text):
        tokens = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff\x20\x09-\x0D]+", text or "")
        return tokens + list(zip(tokens, tokens[1:]))

    raw, target, hold = Counter(), Counter(), []
    slot = {}
    for r in rows:
        some = slots_of(r.document.text)
        # Every n-gram has one slot, as evenly spread as by chance (below).
        assert Counter(some) == Counter(slot.setdefault(g, s) for g, s in zip(grams(r.document.text), some, strict=True))
        raw.update(some)
        d = r.document.doc_id
        if d is not None and d < 200 and d % 2 == 0:
            if zlib.crc32(str(d).encode()) % 4:
                target.update(some)
            else:
                hold.append(r)
    slots = quality.SLOTS
    total, learned = sum(raw.values()), sum(target.values())

    def ratio(text):
        some = slots_of(text)
        values = []
        for x in some:
            p = (raw[x] + 1) / (total + slots)
            values.append(math.log((target[x] + slots * p) / ((learned + slots) * p)))
        return sum(values) / max(len(some), 1)

    assert len(set(slot.values())) > 0.95 * slots * (1 - math.exp(-len(slot) / slots))
    assert max(abs(r.ratio - ratio(r.document.text)) for r in rows) < 1e-9
    scores = sorted(r.ratio for r in hold if not r.base_failed)
    least = math.floor(scores[int(quality.BELOW * len(scores))] * quality.GRID) / quality.GRID
    assert all(r.kept == (not r.base_failed and r.ratio >= least) for r in rows)
    assert np.mean([r.kept for r in rows if r.document.doc_id is not None and r.document.doc_id < 200]) > 0.9
    assert not any(r.kept for r in rows if r.document.doc_id is not None and 200 <= r.document.doc_id < 260)
    none = quality.rate_quality(docs, trusted.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.ratio == pytest.approx(0) for r in none)
    assert quality.rate_quality(docs.limit(0), trusted).count() == 0


def test_all_trusted_rows_are_learned_from(spark, monkeypatch):
    """Labels beyond those that travel at once take further passes; none is left out."""
    rng = random.Random(4)
    docs = table(spark, [(k, prose(rng, 30, "abcdef" if k < 40 else "uvwxyz")) for k in range(60)])
    trusted = spark.createDataFrame([(k,) for k in range(40)], "doc_id long")
    figures = []
    for rows in (1000, 7):
        monkeypatch.setattr(quality, "TRUSTED_ROWS", rows)
        figures.append(sorted((r.document.doc_id, r.ratio, r.kept) for r in quality.rate_quality(docs, trusted).collect()))
    assert figures[0] == figures[1]


# Whitening

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("x", T.LongType()), T.StructField("k1", T.StringType())]
)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, i, "k") for i, v in rows], VECTORS).repartition(3)


def check_fit(rows, width, by_count=False):
    """All figures of the rows of one length against exact sums and numpy."""
    x = {r.document.vec_id: tuple(math.floor(256 * c) for c in r.document.embedding) for r in rows}
    times = Counter(x.values()) if by_count else dict.fromkeys(x.values(), 1)
    n = sum(times.values())
    sums = [sum(t * v[j] for v, t in times.items()) for j in range(width)]
    distinct, weight = np.array(list(times), float), np.array(list(times.values()), float)
    centred = distinct - np.array([s / n for s in sums])
    values = np.sort(np.linalg.eigvalsh((centred * weight[:, None]).T @ centred / n))[::-1]
    mine = {}
    for r in rows:
        v = x[r.document.vec_id]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
        assert np.allclose(r.explained, values[: len(r.explained)] / values.sum(), rtol=1e-6, atol=1e-12)
        assert r.identity_error < 1e-6
        mine[v] = r.whitened
    white = np.array([mine[v] for v in times])
    assert np.allclose((white * weight[:, None]).T @ white / n, np.eye(white.shape[1]), atol=1e-6)
    # A component's covariance with x is its eigenvector times the root of its eigenvalue.
    back = (white * weight[:, None]).T @ centred / n
    assert np.allclose(np.linalg.norm(back, axis=1) ** 2, values[: white.shape[1]])


@pytest.mark.parametrize("by_count", [False, True])
def test_whiten(spark, by_count):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(6, 6))
    rows = [(k, (rng.normal(size=6) @ mix * (1000 if k % 2 else 0.1)).tolist()) for k in range(300)]
    rows += [(300 + k, rows[k % 3][1]) for k in range(100)] + [(500, [0.0] * 6), (501, [-0.0] * 6), (502, [1e-9] * 6)]
    rows += [(None, None), (600, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (601, [math.nan] * 6), (602, [math.inf] + [0.0] * 5), (603, []), (604, [1e300] * 6)]
    rows += [(700 + k, rng.normal(size=2).tolist()) for k in range(20)] + [(800, [1.5])]
    found = whitening.whiten(vectors(spark, rows), by_count=by_count)
    assert found.select("document.*").columns == VECTORS.names
    got = found.collect()
    assert sorted(r.document.vec_id for r in got) == sorted(i for i, v in rows if i is not None and not 600 <= i < 700)
    check_fit([r for r in got if len(r.document.embedding) == 6], 6, by_count)
    check_fit([r for r in got if len(r.document.embedding) == 2], 2, by_count)
    (lone,) = [r for r in got if r.document.vec_id == 800]
    assert lone.whitened == [None] and lone.explained == [None] and lone.identity_error is None and lone.deviation == 0


def test_whiten_keeps_large_numbers_exact(spark):
    rng = random.Random(9)
    rows = [(k, [rng.uniform(-1, 1) * 3e13, rng.uniform(-1, 1), 1e13 * (k % 5)]) for k in range(50)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    x = {r.document.vec_id: [math.floor(256 * c) for c in r.document.embedding] for r in got}
    sums = [sum(v[j] for v in x.values()) for j in range(3)]
    assert all(int(r.deviation) == sum((50 * a - s) ** 2 for a, s in zip(x[r.document.vec_id], sums)) for r in got)


def test_whiten_nothing(spark):
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    same = whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(9)])).collect()
    assert len(same) == 9 and all(r.n == 1 and r.whitened == [None, None] for r in same)


def test_whitening_query(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)] + [(60, [0.5] * 3)]
    vectors(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_embedding_whitening(spark, str(tmp_path))
    assert got.dtypes[:4] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint")]
    assert sorted((r.vec_id, r.component) for r in got.collect()) == sorted((k, c) for k, v in rows for c in range(1, min(len(v), 4) + 1))
