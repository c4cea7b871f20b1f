"""Line, substring, suffix and SimHash operators against plain brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from driftsim.llm import line_dedup, simhash, substring_dedup, suffix_dedup
from driftsim.llm.components import components
from tests.llm.helpers import awkward, prose, table


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward()).repartition(3).persist()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def low(doc_id):
    return (doc_id is not None, doc_id)


def test_line_dedup(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = {}
    for d, t in sorted(set(rows), key=lambda r: (low(r[0]), r[1] or "")):
        lines = (t or "").split("\n") if t is not None else []
        for i in range(len(lines) - 2):
            key = tuple(lines[i : i + 3])
            first[key] = min(first.get(key, (low(d), 1 << 30)), (low(d), i))
    # Two texts under one id are ordered by a hash: such windows are left out of this check.
    want = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = set()
        for i in range(len(lines) - 2):
            if first[tuple(lines[i : i + 3])] < (low(d), i):
                gone |= {i, i + 1, i + 2}
        kept = None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        want.append((d, len(lines), len(gone), kept))
    found = line_dedup.line_dedup(docs)
    got = [(r.document.doc_id, r.n_lines, r.n_removed, r.kept) for r in found.collect()]
    assert ordered(got) == ordered(want)
    assert sum(r[2] for r in got) > 10
    assert found.select("document.*").columns == docs.columns


def test_substring_dedup(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    least = {}
    cut = {(d, t): re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in rows}
    for (d, _), words in cut.items():
        if d is not None:
            for i in range(len(words) - 49):
                key = b" ".join(words[i : i + 50])
                least[key] = min(d, least.get(key, d))
    want = []
    for d, t in rows:
        words = cut[d, t]
        gone = [False] * len(words)
        for i in range(len(words) - 49):
            if d is not None and least[b" ".join(words[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((d, len(words), sum(gone), kept.decode()))
    found = substring_dedup.substring_dedup(docs)
    got = [(r.document.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()]
    assert ordered(got) == ordered(want)
    assert sum(r[2] for r in got) > 300


@pytest.mark.parametrize("places", [64, 1])
def test_suffix_dedup(docs, monkeypatch, places):
    # With one place both ways are taken: shards of suffixes, and counted windows.
    monkeypatch.setattr(suffix_dedup, "SEED_PLACES", places)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    count = Counter()
    for _, t in rows:
        raw = (t or "").encode()
        count.update(raw[i : i + 200] for i in range(len(raw) - 199))
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = len(re.findall(rb"\x01+", gone.tobytes()))
        want.append((d, len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    found = suffix_dedup.suffix_dedup(docs)
    got = [(r.document.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found.collect()]
    assert ordered(got) == ordered(want)
    assert sum(r[2] for r in got) > 2000


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    rng = random.Random(seed)
    symbols = np.array([rng.randint(1, rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(0, 300))], np.int64)
    want = sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
    assert suffix_dedup.suffix_array(symbols).tolist() == want


def test_suffix_array_takes_few_recursions(monkeypatch):
    """Names span twice as many places as the triples of plain recursion."""
    rng, sort, sizes = random.Random(5), suffix_dedup.suffix_array, []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda symbols, *step: sizes.append(len(symbols)) or sort(symbols, *step))
    text = rng.randbytes(350)
    found = suffix_dedup.repeated_starts([text, rng.randbytes(350), text])
    assert [int(hit.sum()) for hit in found] == [151, 0, 151]
    assert len(sizes) <= 5


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(3)
    texts = awkward(5)
    for _ in range(30):
        base = prose(rng, rng.randint(3, 400)).split(" ")
        for _ in range(rng.randint(1, 4)):
            near = list(base)
            near[rng.randrange(len(near))] = "other"
            texts.append((len(texts) + 100, " ".join(near)))
    docs = table(spark, texts)
    prints = [fingerprint(t) for _, t in texts]
    ids = [d for d, _ in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    least = {g: min((d for d in members if d is not None), default=None) for g, members in groups.items()}
    want = [(ids[i], f"{prints[i]:016x}", least[find(i)]) for i in range(len(ids))]
    got = [tuple(r) for r in simhash.simhash_components(docs).collect()]
    assert ordered(got) == ordered(want)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.values())


def test_pigeonring_finds_every_close_pair(spark):
    rng = random.Random(11)
    found = set()
    for _ in range(60):
        a = rng.getrandbits(64)
        found.add(a)
        for _ in range(6):
            b = a
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                b ^= 1 << bit
            found.add(b)
    values = sorted(x - (1 << 64) if x >> 63 else x for x in found)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    prints = spark.createDataFrame([(v,) for v in values], "print long")
    got = {r.print: r.root for r in simhash.link_groups(prints).collect()}
    linked = Counter(find(v) for v in values)
    groups = defaultdict(set)
    for v in values:
        if linked[find(v)] > 1:
            groups[find(v)].add(v)
    back = defaultdict(set)
    for v, r in got.items():
        back[r].add(v)
    assert sorted(map(sorted, back.values())) == sorted(map(sorted, groups.values()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100)}


def test_empty_tables(spark):
    none = table(spark, [])
    assert line_dedup.line_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert simhash.simhash_dedup(none).count() == 0


def test_digests_agree_with_contents(spark):
    docs = table(spark, ["a b", None])
    got = {r.document.doc_id: r.kept for r in substring_dedup.substring_dedup(docs).collect()}
    assert hashlib.sha256(got[1].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
