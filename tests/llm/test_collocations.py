"""Collocations against a plain count, on texts with the cases that break things."""

import collections
import random
import re

import pytest

from tidemark.llm import collocations

SCHEMA = "doc_id long, text string, lang string, word string, hash long, n long, count string"


def brute(rows, support, longest=3, swallowed=50, most=2000):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i: i + k])] += 1
    found = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        covered = collections.Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i: i + m]] = max(covered[p[i: i + m]], a)
        kept = []
        for p, a in candidates.items():
            if covered[p] and 100 * covered[p] >= swallowed * a:
                continue
            score, cut = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            found.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["a", "B", "Ça", "être", "the", "THE", " x", "日本", "of", "New York", "new  york\tcity", "x\x85y", "\x00", "'", "-"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",;", "\x0b", "?!"]) for _ in range(rng.randint(0, 60)))
        rows.append((i if i % 7 else None, text if i % 11 else None, rng.choice(["en", "en", "fr", None, "und", ""])))
    return rows + [(1, "", "en"), (1, " \t ", "de"), (2, "new york " * 3000, "fr"), (3, "one two three " * 40, "es"), (3, "one two three " * 40, "es"), (4, "." * 50, "it")]


@pytest.mark.parametrize("support,shards,bits,most", [(10, 4, 1 << 27, 2000), (3, 7, 1 << 16, 5), (1, 1, 1 << 15, 2000)])
def test_collocations_equal_a_plain_count(spark, support, shards, bits, most):
    rows = texts(150, support)
    docs = spark.createDataFrame([(*r, "w", 7, 8, "c") for r in rows], SCHEMA).repartition(3)
    got = collocations.collocations(docs, support=support, shards=shards, bits=bits, most=most)
    assert sorted(map(tuple, got.collect())) == brute(rows, support, most=most)


def test_places_and_hashes_of_each_text(spark):
    rows = texts(40, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = [collocations.Words([t.encode() if t else b""], ["en"], [0]) for _, t, _ in rows]
    for w in words:
        for k in (1, 2, 3):
            assert len(w.hashes(k)) == len(w.places(k)) == max(0, len(w.ids) - k + 1)
    assert sorted(map(tuple, collocations.collocations(docs, support=4).collect())) == brute(rows, 4)


def test_equal_phrases_have_equal_hashes_and_languages_differ():
    one = collocations.Words([b"Big apple. x big apple", b"big apple"], ["en", "fr"], [0, 0])
    pairs = [h for h, at in zip(one.hashes(2), one.places(2)) if at]
    assert len(pairs) == 4 and pairs[0] == pairs[2] and pairs[3] not in pairs[:3]


def test_counts_beyond_64_bits_are_exact(spark):
    """a a 1000000 passes 64 bits from 3,037,000 on."""
    text = "zig zag " * 400_000
    docs = spark.createDataFrame([(i, text, "en") for i in range(8)], "doc_id long, text string, lang string")
    got = {r["phrase"]: r for r in collocations.collocations(docs).collect()}
    a = 8 * 400_000
    assert got["zig zag zig"]["a"] == a - 8 and got["zig zag zig"]["n"] == 2 * a
    assert got["zig zag zig"]["score"] == min(1000000 * (a - 8) ** 2 // (a * (a - 8)), 1000000 * (a - 8) ** 2 // (a * a))
    assert "zig zag" not in got


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(none).count() == 0
