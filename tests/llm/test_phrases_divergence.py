"""Phrase mining and source divergence against brute-force versions, on random
texts and on nulls, empty and very long texts, ties, repeated rows, empty
tables and clashing columns; fingerprint collisions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptorium.llm import divergence, ngrams, phrases

SCHEMA = "doc_id long, text string, lang string, source string, n int, phrase string, value long, term string, cells int, kept int, _salt int"


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = [p for p, a in c.items() if len(p) > 1 and a >= least]
        kept = []
        for p in cand:
            a = c[p]
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            longer = [q for q in cand if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * c[q] >= 50 * a for q in longer):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text))) for _, text, lang, source, *_ in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[r][t]) for t in kept), r.encode()) for r in sources if r != s)
            term = sorted((-f(p[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > whole[t])
            for part, best in (("pair", pair), ("term", term[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(best, 1)]
    return sorted(out)


def _docs(seed=1, size=160):
    rng = random.Random(seed)
    vocab = ["The", "the", "a", "ü", "Ü", "New", "york", "x1", "b", "c-d", "über", "日本", "o'k"]
    rows = [(0, None, "en", "s1"), (1, "", None, None), (2, " \t . , \n", "fr", "s1"), (None, None, None, None),
            (5, "new york city " * 40, "en", None), (5, "new york city " * 40, "en", None), (6, "a a a a a a a a a a a a a", None, "s9"),
            (7, "12 34 56. " * 30, "de", "s1"), (8, "A\tb  c,d" * 15, "", "")]
    for i in range(20, 20 + size):
        text = "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", " : ", "!"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "é", None])))
    return [(*r, 1, "z", 2, "t", 3, 4, 5) for r in rows]


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_phrases_equal_brute_force(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, SCHEMA)
    got = phrases.collocations(df, least=5, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert _rows(got) == brute_phrases(rows, 5, 40)


def test_divergence_equals_brute_force(spark):
    rows = _docs(2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = divergence.source_divergence(df, least_docs=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert _rows(got) == brute_divergence(rows, 3, 10)


def test_small_blocks_and_spills_change_nothing(spark, monkeypatch):
    """Texts cut into blocks, partitions that hand on often, many tiles and a
    filter that is nearly full give the same rows."""
    rows = _docs(3, 60) + [(900, " ".join(f"w{i % 7}" for i in range(3000)), "en", "s2", 1, "z", 2, "t", 3, 4, 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for module, name, value in ((phrases, "BLOCK_BYTES", 64), (phrases, "HELD", 10), (phrases, "FILTER_BITS", 1 << 9),
                                (divergence, "BLOCK_BYTES", 64), (divergence, "STRIPE_CELLS", 10), (divergence, "TILE_SOURCES", 2),
                                (divergence, "TILE_TERMS", 5)):
        monkeypatch.setattr(module, name, value)
    assert _rows(phrases.collocations(df, least=4, top=30)) == brute_phrases(rows, 4, 30)
    assert _rows(divergence.source_divergence(df, least_docs=2)) == brute_divergence(rows, 2, 10)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert _rows(phrases.collocations(df)) == [] and _rows(divergence.source_divergence(df)) == []
    only = spark.createDataFrame([(1, None, None, None)] * 2, "doc_id long, text string, lang string, source string")
    assert _rows(phrases.collocations(only)) == [] and _rows(divergence.source_divergence(only)) == []


def test_languages_without_kept_terms_have_pairs(spark):
    rows = [(1, "one", "en", "a"), (2, "two", "en", "b"), (3, None, "en", None)]
    got = _rows(divergence.source_divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert got == brute_divergence(rows, 10, 10) and len(got) == 6 and all(r[4] == 0 for r in got)


def test_collisions_are_told_apart_by_text(monkeypatch):
    """Fingerprints of two bits: almost all collide, all texts stay apart."""
    rng = random.Random(4)
    raw = np.frombuffer(" ".join(rng.choice(["ab", "ba", "abc", "c", "dd"]) for _ in range(400)).encode(), np.uint8)
    start, end = ngrams.runs(raw != 32)
    fp = ngrams.Prefixes(raw).fingerprints(start, end)
    texts = [raw[s:e].tobytes() for s, e in zip(start, end)]
    assert len(set(zip(fp.tolist(), texts))) == len(set(texts)) == len(set(fp.tolist()))
    number, first = ngrams.number_texts(raw, fp & np.uint64(3), start, end)
    assert [texts[first[n]] for n in number] == texts and len(first) == len(set(texts))


def test_colliding_phrases_are_counted_by_text(spark, monkeypatch):
    """The partitions' fingerprints keep a few bits: counts stay exact."""
    real = ngrams.Prefixes.fingerprints
    rows = _docs(5, 40)

    class Weak(ngrams.Prefixes):
        def fingerprints(self, start, end):
            return real(self, start, end) & np.uint64(63)

    monkeypatch.setattr(phrases, "Prefixes", Weak)
    assert _rows(phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=5, top=40)) == brute_phrases(rows, 5, 40)


@pytest.mark.parametrize("size", [0, 1, 2, 65_535, 65_537, 200_000])
def test_powers(size):
    p = ngrams._powers(ngrams.BASE, size)
    assert len(p) == size and all(int(p[i]) == pow(ngrams.BASE, i, 1 << 64) for i in {0, 1, size // 2, size - 1} if 0 <= i < size)
