"""Language ID, personal data, decontamination, vectors, packing and scoring."""

import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftsim.llm import decontamination, embedding_dedup, language_id, lm_scoring, packing, pii, text
from tests.llm.helpers import DOCS, awkward, prose, table


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_id_on_rows_held_out(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdef", "bb": "cdefgh", "cc": "stuvwä"}
    rows = []
    for n in range(600):
        lang = rng.choice(list(letters))
        rows.append((n, prose(rng, 60, letters[lang]), lang, "s", 1, "r", "p", 1, 2))
    awkwards = [(1000 + n, t, None, "s", 1, "r", "p", 1, 2) for n, t in enumerate(["", None, "12 34 !!", "a", "abc " * 9000])]
    docs = spark.createDataFrame([*rows, *awkwards, awkwards[0], (None, "abc def", None, "s", 1, "r", "p", 1, 2)], DOCS)
    got = [(r.document.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs).collect()]
    assert len(got) == docs.count()
    want = {r[0]: r[2] for r in rows}
    tested = [(d, p) for d, p, _ in got if d in want and held(d, 3) == 1]
    assert sum(want[d] == p for d, p in tested) >= 0.97 * len(tested) > 100
    by = {d: (p, s) for d, p, s in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert by[1003][0] in letters and by[1004][0] == "aa"
    assert all(0 <= s <= 1 for _, _, s in got)
    nothing = language_id.identify(docs.filter("lang is null"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language_id.identify(table(spark, [])).count() == 0


KINDS = {
    "email": rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": rb"[0-9]([\x20-]?[0-9])+",
    "phone": rb"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern.decode(), text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    rng = random.Random(4)
    texts = [t for _, t in awkward(8)]
    texts += ["a@b.c_d@e.f", "a@b.c@d.e", "x..@y-.z.", "1.2.3.4.5.6.7.8", "300.1.1.1 00255.0.0.1", "é😀 q@w.de 😀 +1 2345678.", "9" * 6000, "1 " * 3000, "a" * 30000, "+" * 500]
    texts += ["".join(rng.choice("a@.1 2+-4_%(é)\n") for _ in range(rng.randint(5, 200))) for _ in range(300)]
    texts += ["4111-1111-1111-1111 4111 1111 1111 1112 378282246310005", "+49 30 123456 +1 +123456789012345 +1234567890123456"]
    docs = table(spark, texts)
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).select("document.doc_id", pii.span_list("base").alias("spans")).collect()}
    for n, t in enumerate(texts):
        assert got[n] == base(t), t


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(6)
    texts = [f"{prose(rng, 8)} Zanzibarian {prose(rng, 3)} ada@x.org {prose(rng, 8)}" for _ in range(12)]
    texts += [f"{prose(rng, 8)} common {prose(rng, 2)} u{n}@y.org {prose(rng, 8)}" for n in range(300)]
    texts += ["Zanzibarian without an address", None, ""]
    found = pii.find_personal_data(table(spark, [*texts, (0, texts[0])]))
    got = {r.document.doc_id: (r.document.text, r.base, r.spans) for r in found.collect()}
    assert found.count() == len(texts) + 1
    for n in range(12):
        text, plain, spans = got[n]
        terms = {text[s.start : s.end] for s in spans if s.kind == "term"}
        assert "Zanzibarian" in terms and len(plain) == 1
    assert not any(s.kind == "term" for n in range(12, 315) for s in got[n][2])
    clean = found.select("document.doc_id", pii.sanitised(found["document.text"], found["spans"]).alias("clean")).collect()
    assert all("@" not in r.clean and "Zanz" not in r.clean for r in clean if r.doc_id is not None and r.doc_id < 12)


def marked_words(spark, texts):
    """Per document, every (word, start) of kind term."""
    found = pii.find_personal_data(table(spark, texts)).select("document.doc_id", "document.text", "spans").collect()
    return {r.doc_id: [(r.text[s.start : s.end], s.start) for s in r.spans if s.kind == "term"] for r in found}


def test_terms_anywhere_in_the_document(spark):
    rng = random.Random(11)
    # Far from the place, behind another place, twice, and not where it is part of a place or of a longer word.
    texts = [
        f"{prose(rng, 3)} Zanzibarian {prose(rng, 60)} ada@x.org {prose(rng, 5)} u{n}@y.org {prose(rng, 60)} zanzibarian, Quokkas; Zanzibarians ñquokkas@z{n}.org"
        for n in range(8)
    ]
    texts += [f"{prose(rng, 20)} v{n}@y.org {prose(rng, 20)}" for n in range(300)]
    got = marked_words(spark, texts)
    for n in range(8):
        text = texts[n]
        want = [(m[0], m.start()) for m in re.finditer(r"\b(?:zanzibarian|quokkas|zanzibarians)\b(?!@)", text, re.I)]
        assert len(want) == 4
        assert [g for g in got[n] if g[0].lower()[:2] in ("za", "qu", "ñq")] == want
        assert all(word.isalpha() for word, _ in got[n])
    assert not any(got[n] for n in range(8, 308))


def test_terms_are_counted_over_all_documents(spark):
    rng = random.Random(12)
    texts = [f"{prose(rng, 9)} ordinary zanzibarian ada@x.org {prose(rng, 9)}" for _ in range(4)]
    texts += [f"{prose(rng, 9)} ordinary {n}" for n in range(80)]
    # Copies of one text are no support for its terms; words inside places are no terms.
    texts += ["quokkas bob@x.org"] * 3 + ["zanzibarian und"] + [f"{prose(rng, 2)} w{n}@zanzibarian.org" for n in range(9)]
    got = marked_words(spark, texts)
    assert all([w for w, _ in got[n] if len(w) > 6] == ["zanzibarian"] for n in range(4))
    assert not any(got[n] for n in range(4, len(texts)))
    found = {r.document.doc_id: r.document.asDict() for r in pii.find_personal_data(table(spark, texts)).collect()}
    assert found[0] == {"doc_id": 0, "text": texts[0], "lang": "en", "source": "s", "n_chars": len(texts[0]), "row": "r", "print": "p", "spans": 1, "document": 2}


def test_words_beside_places(spark):
    texts = ["größe@x.de tel+49 30 1234567 größe", "a@b.cé\u0301é und a@b.c", "ab 😀 cd@ef.gh ij", "ab"]
    text = pii.F.col("text")
    places = pii._merged(pii.base_spans(text))
    rows = table(spark, texts).select("doc_id", pii._outside(text, places).alias("outside")).collect()
    got = {r.doc_id: r.outside for r in rows}
    assert got == {0: " " * 11 + "tel" + " " * 15 + "größe", 1: " " * 8 + " und" + " " * 6, 2: "ab 😀" + " " * 10 + "ij", 3: "ab"}


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench_words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


@pytest.mark.parametrize("items_at_once", [50_000, 3])
def test_decontamination(spark, monkeypatch, items_at_once):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", items_at_once)
    rng = random.Random(9)
    items = [(n, prose(rng, rng.randint(5, 40), "abc")) for n in range(8)]
    items += [(8, ""), (9, None), (10, "Short One"), (11, "alone"), (None, items[0][1]), (2, items[3][1]), (12, "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab")]
    texts = [t for _, t in awkward(3)]
    texts += [prose(rng, 30) + items[n % 8][1].upper() + prose(rng, 20 * n) for n in range(20)]
    texts += ["short one alone", "short, one! alone?", items[1][1][:60], "ab " * 40, "words " * 20 + items[4][1][5:]]
    docs = table(spark, texts)
    windows = {}
    for item, text in items:
        words = bench_words(text)
        for i in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[i : i + 13]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    found = decontamination.benchmark_hits(docs, spark.createDataFrame(items, "item_id long, text string"))
    for r in found.select("document", "n_words", "items", "spans", decontamination.n_hit().alias("hit"), decontamination.contaminated().alias("bad")).collect():
        words = bench_words(r.document.text)
        hit, which = [False] * len(words), set()
        for m in lengths:
            for i in range(len(words) - m + 1):
                owners = windows.get(tuple(words[i : i + m]))
                if owners:
                    which |= owners
                    hit[i : i + m] = [True] * m
        assert (r.n_words, r.hit, r["items"]) == (len(words), sum(hit), sorted(which)), r.document.text[:80]
        assert r.bad == (sum(hit) > 0 and 20 * sum(hit) >= len(words))
        assert sum(s.end - s.start for s in r.spans) == sum(hit)
    assert decontamination.benchmark_hits(table(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0
    none = decontamination.benchmark_hits(docs, spark.createDataFrame([], "item_id long, text string"))
    assert {len(r.spans) for r in none.collect()} == {0}


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 64)
    draw = np.random.default_rng(5)
    rows = []
    for n in range(300):
        v = draw.normal(size=16)
        rows.append((n, v))
        for _ in range(int(draw.integers(0, 4))):
            rows.append((1000 + len(rows), v + draw.normal(size=16) * draw.choice([0.05, 0.15, 0.3])))
    same = draw.normal(size=16)
    rows += [(5000 + i, same) for i in range(40)] + [(6000, same * 3), (6001, -same)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    bad = [(7000, None), (7001, []), (7002, [0.0] * 16), (7003, [1.0, None] * 8), (7004, [math.inf] + [1.0] * 15), (7005, [math.nan] * 16), (7006, [1.0] * 8), (7006, [1.0] * 8)]
    every = rows + bad
    vectors = spark.createDataFrame([(i, v, "x") for i, v in every], "vec_id long, embedding array<float>, links string")
    ids = [i for i, _ in every]
    unit = {}
    for k, (_, v) in enumerate(every):
        if v and None not in v and np.isfinite(v).all() and any(v):
            unit[k] = np.array(v) / np.linalg.norm(v)
    links, root = Counter(), list(range(len(every)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(len(every)):
        least[find(k)] = min(ids[k], least.get(find(k), ids[k]))
    want = sorted((ids[k], links[k], least[find(k)], ids[k] == least[find(k)]) for k in range(len(every)))
    got = sorted(tuple(r) for r in embedding_dedup.embedding_links(vectors).collect())
    assert got == want
    assert embedding_dedup.embedding_links(vectors.filter("false")).count() == 0


def test_quantised_bound_loses_no_pair():
    draw = np.random.default_rng(8)
    a = draw.normal(size=(400, 24)) * draw.lognormal(0, 3, (400, 1))
    b = np.concatenate([a[:200] + draw.normal(size=(200, 24)) * 0.2 * np.abs(a[:200]).mean(axis=1, keepdims=True), draw.normal(size=(100, 24))])
    ua, ub = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    for cosine in (0.5, 0.9, 0.95, 0.99):
        want = {*zip(*(x.tolist() for x in np.nonzero(ua @ ub.T >= cosine)), strict=True)}
        got = {p for i, j in embedding_dedup.close_pairs(a, b, cosine, False) for p in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == want and want


def test_packing_round_trip(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = awkward(2) + [(900, "two  blanks\n\n\tand tabs   x"), (901, "trailing  "), (902, "it's <|endoftext|> here"), (903, prose(random.Random(1), 9000))]
    docs = table(spark, texts)
    want = Counter()
    for d, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for row in places.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 400) for _ in range(rng.randint(1, 40))}
    slots = sorted(packing.plan(counts, 100))
    room = {}
    for n, (size, rank, first, offset) in enumerate(slots):
        last = slots[n + 1][1] if n + 1 < len(slots) and slots[n + 1][0] == size else counts[size]
        for k in range(last - rank):
            room.setdefault(first + k, []).append((offset, size))
    assert sum(map(len, room.values())) == sum(counts.values())
    for row in room.values():
        at = 0
        for offset, size in sorted(row):
            assert offset == at
            at += size
        assert at <= 100
    # Best fit decreasing one by one opens as many.
    left = []
    for size in sorted((s for s, c in counts.items() for _ in range(c)), reverse=True):
        fits = [x for x in left if x >= size]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - size)
        else:
            left.append(100 - size)
    assert len(room) <= len(left)


def log_sum_of_segmentations(word, known, log_p):
    raw, best = b" " + word, {0: 0.0}
    for j in range(1, len(raw) + 1):
        ways = [best[i] + log_p[known.number[raw[i:j]]] for i in range(j) if i in best and raw[i:j] in known.number]
        if ways:
            top = max(ways)
            best[j] = top + math.log(sum(math.exp(w - top) for w in ways))
    return best[len(raw)]


def test_lattices_against_plain_recursion():
    known = lm_scoring.pieces()
    words = [b"a", "für".encode(), b"internationally", b"x" * 300, "日本".encode(), b"12,3"]
    got = lm_scoring.word_log_p(words, known.log_p, known)
    assert np.allclose(got, [log_sum_of_segmentations(w, known, known.log_p) for w in words])
    counts = lm_scoring.expected_counts(words, np.ones(len(words)), known)
    length = {k: len(p) for p, k in known.number.items()}
    covered = sum(counts[k] * length[k] for k in np.flatnonzero(counts))
    assert math.isclose(covered, sum(len(w) + 1 for w in words))


@pytest.mark.parametrize("head", [400_000, 5])
def test_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", head)
    texts = awkward(7)
    docs = table(spark, texts)
    words = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for _, t in texts]
    out = [d is not None and held(d, 7) == 2 for d, _ in texts]
    count, ends = Counter(), 0
    for w, o in zip(words, out, strict=True):
        if not o:
            count.update(w)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    known = lm_scoring.pieces()
    spelled = sorted(count)
    pieces = lm_scoring.expected_counts(spelled, np.array([count[w] for w in spelled]), known)
    whole = pieces.sum() + len(pieces) + ends + 1
    log_p = np.log((pieces + len(pieces) * np.exp(known.log_p)) / whole)
    floor = math.log10(n + v + 1)
    want = []
    for (d, _), w, o in zip(texts, words, out, strict=True):
        plain = sum(math.log10(count[x] + 1) - floor for x in w) + math.log10(ends + 1) - floor
        score = (sum(log_sum_of_segmentations(x, known, log_p) for x in w) + math.log((ends + 1) / whole)) / math.log(10)
        want.append((-1 if d is None else d, o, len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, plain, score))
    got = [(-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in lm_scoring.score(docs).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert np.allclose(g[5:], w[5:], rtol=1e-9)
    assert lm_scoring.score(table(spark, [])).count() == 0


def test_embeddings_of_any_magnitude(spark):
    base = [0.3, 0.4, 0.5]
    rows = [(1, [1e200, 1e200, 0.0]), (2, [1e200, 1.0001e200, 0.0]), (3, [1e-200, 1e-200, 0.0]), (4, base), (5, [c * 1e-300 for c in base]), (6, [0.0, 0.0, -5e-324])]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)]


def test_language_of_very_short_texts(spark):
    words = {"es": "hola", "en": "hello", "de": "hallo", "fr": "salut"}
    rows = [(n, w, lang) for k, (lang, w) in enumerate(words.items()) for n in range(1000 * k, 1000 * k + 60)]
    docs = spark.createDataFrame([*rows, (None, "hola", "es")], "doc_id long, text string, lang string")
    got = language_id.identify(docs).select("document.lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)


def test_forward_pass_against_a_plain_convolution():
    rng = np.random.default_rng(5)
    net = language_id.train(["abc def " * 40, "xyz uvw " * 40], ["a", "b"], rounds=1)
    windows = rng.integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    want = []
    for x in windows:
        hidden = [
            max(sum(net.tables[w][j][x[i + j]][f] for j in range(w)) for i in range(language_id.WINDOW - w + 1))
            for w in language_id.WIDTHS
            for f in range(language_id.FILTERS)
        ]
        z = np.array(hidden) @ net.dense + net.bias
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(language_id._probabilities(windows, net.pairs(), net), want, atol=1e-4)


def test_scores_of_long_words(spark):
    """A word of 50 kilobytes beside short ones; it is joined, however frequent."""
    long = "ab" * 25_000
    docs = spark.createDataFrame([(n, f"{long} a bc a") for n in range(6)] + [(9, long)], "doc_id long, text string")
    rows = {r.document if "document" in r else r.doc_id: r for r in lm_scoring.score(docs).collect()}
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows.values())
    assert rows[0].n_tokens == 5 and rows[9].n_tokens == 2
    assert rows[0].score < rows[9].score < -1000


def test_many_and_long_matches_in_one_text(spark):
    """Long runs of digits, and many addresses, take time in proportion to their length."""
    texts = ["7" * 300_000 + " 1.5 " + "8" * 300_000 + ".1.2.3", "12.3.4.5.6.7.8.9.10 1.2.3 " * 300, "a@b.c 10.0.0.1, " * 3000, "x"]
    docs = table(spark, texts).repartition(4)
    began = time.time()
    got = {r.document.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert time.time() - began < 100
    for n, text in enumerate(texts):
        want = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text if "@" in text else "")]
        want += [("ip", m) for m in re.finditer(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}", text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split("."))]
        found = [(s.kind, s.start, s.end) for s in got[n].base if s.kind in ("email", "ip")]
        assert found == [(k, *m.span()) for k, m in want]


def test_merged_places(spark):
    rng = random.Random(4)
    rows = []
    for n in range(60):
        spans = [(a, a + rng.randint(1, 12)) for a in (rng.randrange(0, 4000) for _ in range(rng.choice([0, 1, 5, 300, 700])))]
        rows.append((n, spans))
    frame = spark.createDataFrame(rows, "n long, spans array<struct<start:int,end:int>>")
    for r in frame.select("n", "spans", pii._merged(F.col("spans")).alias("places")).collect():
        want = []
        for a, b in sorted(map(tuple, r.spans)):
            if want and a < want[-1][1]:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        assert [[p.start, p.end] for p in r.places] == want


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_words_are_hashed_piece_by_piece():
    """Hashes do not depend on the piece a word is in, and a task needs a bounded memory for them."""
    long = "x" * (3 * text.HASH_BYTES + 5)
    rows = ["a bc  def", "", None, f"{long} b {long}y {long}", "bc " * 200_000, "def"]
    words = lm_scoring.words_of(pa.array(rows, pa.string()))
    spelled = lm_scoring._spell(words, np.arange(len(words.start)))
    by_word = {}
    for word, value in zip(spelled, text.word_hashes(words).tolist(), strict=True):
        assert by_word.setdefault(word, value) == value
    alone = {w: int(text.word_hashes(lm_scoring.words_of(pa.array([w.decode()])))[0]) for w in by_word}
    assert by_word == alone and len(set(alone.values())) == len(alone) == 6
    many = lm_scoring.words_of(pa.array(["some words of a text " * 1000] * 380))  # 8 MB
    assert peak_mb(lambda: text.word_hashes(many)) < 40


def test_decontamination_memory_of_a_shard():
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"word{k}" for k in range(3000)])
    texts = [" ".join(vocabulary[rng.integers(0, 3000, 500)]) for _ in range(1000)]  # 4 MB
    wanted = decontamination.phrases([str(k) for k in range(300)], [" ".join(t.split()[:20]) for t in texts[:300]])
    words = decontamination.words_of(pa.array(texts))
    found = []
    assert peak_mb(lambda: found.append(decontamination.occurrences(words, wanted))) < 110
    start, length, _ = found[0]
    assert {(int(words.row[s]), int(s - words.first[words.row[s]])) for s in start} >= {(r, k) for r in range(300) for k in range(8)}
    assert set(length.tolist()) == {13}
