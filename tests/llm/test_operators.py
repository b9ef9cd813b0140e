"""Each operator against a brute-force version, on texts with the cases that break things."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact, idfiles, language, licences, near, neighbours, packing, pieces, private, substrings
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.storing import stored
from tidemark.runtime import scratch_path
from tests.conftest import DATA

LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [
    None, "", " ", "\t\n \x0b\x0c\r", "a", "one two", "Don't  STOP's 'tis it'S ... word,\nword...word ''' '", "a<|endoftext|>b <|STARTOFTEXT|>", "ﬁ ½ Å é İstanbul ΑΣ ΑΣΑ",
    "日本語テキスト。 ok!!..'s 🎉🎉 fun‍️", "x y z\x85q\x1cw\x00", "İ̇. ß. ẞ, é.", "12345 5a6b +1 (017) 555-7713 x 1.2.3.4.5", "  two  spaces ▁▁ here ", "9" * 3000, LONG,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with repeated rows, a null id, and further columns named like the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, "s", -1, "x") for i, t in enumerate(ODD)] + [(4, "a", None, None, None, None), (None, "no id", "en", "s", 1, "x"), (100, "One  Two", "en", "s", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string").withColumns(
        {"digest": F.lit(1), "kept": F.lit("k"), "spans": F.lit(None).cast("int"), "node": F.lit(2), "words": F.lit("w"), "start": F.lit(1.5)}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def word_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: library.encode(text, add_special_tokens=False).ids + [1]


# packing


def test_differencing_keeps_every_item_and_balances():
    rng = random.Random(1)
    for n, ways in ((0, 3), (1, 1), (5, 8), (40, 4), (300, 64)):
        sizes = [rng.randint(1, 512) for _ in range(n)]
        groups = packing.differencing(sizes, ways)
        assert sorted(i for g in groups for i in g) == list(range(n)) and len(groups) <= ways
        if n == 300:
            sums = [sum(sizes[i] for i in g) for g in groups]
            assert max(sums) - min(sums) < 128


def test_fill_raises_the_number_of_windows():
    assert len(packing.fill([6, 6, 6], 10)) == 3
    assert all(sum(g) <= 10 for g in ([6] * len(g) for g in packing.fill([6, 6, 6], 10)))


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_packing_holds_every_id_once(request, table, word_ids):
    docs = request.getfixturevalue(table)
    got = packing.pack(docs).collect()
    want = collections.Counter((k, tuple(word_ids(t))) for k, t in texts_of(docs))
    pieces_of = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 2048
        pieces_of[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, own in pieces_of.items():
        found = sorted((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["doc_tokens"]) for r in own)
        expected = [(s, ids) for (d, ids), n in want.items() if d == k for s in [n]]
        assert sum(len(x[1]) for x in found) == sum(len(ids) * n for n, ids in expected)
        for start, ids, total in found:
            assert any(len(e) == total and e[start: start + len(ids)] == ids for _, e in expected)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


# id files


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 10**18), (1000, 1000), (5000, 10**12), (3000, 2**63), (700, 3)])
def test_elias_fano_round_trip(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top, n).astype(np.uint64))
    code = idfiles.EliasFano(idfiles.ef_encode(values))
    assert (code.values() == values).all() and len(code) == n
    assert all(code.select(i) == int(values[i]) for i in range(n))
    with pytest.raises(IndexError):
        code.select(n)


@pytest.mark.parametrize("block", [64, idfiles.BLOCK_IDS])
def test_id_files_round_trip(spark, odd, word_ids, block):
    path = scratch_path(spark, "ids")
    idfiles.write_ids(odd, path, block_ids=block)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], bytes(r["ids"])) for r in idfiles.read_ids(spark, path).collect()), key=lambda x: x[2])
    assert got == sorted(got, key=lambda x: (x[0], x[1]))
    at = 0
    for *_, start, n, ids in got:
        assert start == at and len(ids) == 4 * n
        at += n
    assert collections.Counter(x[4] for x in got) == collections.Counter(np.array(word_ids(t), "<u4").tobytes() for _, t in texts_of(odd))


# near duplicates


def brute_components(rows, words, part=80, whole=100):
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append(frozenset(tuple(w[i: i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if whole * both >= part * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    smallest = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            smallest[find(i)] = min(smallest.get(find(i), k), k)
    return sorted(((k is not None, k or 0), len(sets[i]), smallest.get(find(i)) if k is not None else None, k is None or k == smallest[find(i)]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("table,words", [("odd", 4), ("documents", 4), ("documents", 5)])
def test_near_links_equal_brute_force(request, table, words):
    docs = request.getfixturevalue(table)
    got = sorted((((r["doc_id"] is not None, r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in near.links(docs, words=words).collect()), key=repr)
    assert got == sorted(brute_components(texts_of(docs), words), key=repr)


def test_near_links_of_a_large_group_and_of_chains(spark):
    """Copies of one text with own changes, half of them too far from each other; chains whose ends are unlike."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        own = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3])):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    chain = [f"c{i}" for i in range(200)]
    rows += [(1000 + i, " ".join(chain[4 * i: 4 * i + 60])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((True, r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near.links(docs, words=4).collect())
    assert got == brute_components(rows, 4)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (10, 9), (9, 8), (8, 11), (3, 1)]
    got = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in range(1, 12)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8, 10: 8, 11: 8}


# sentencepiece


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_pieces_equal_the_library(request, table):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = request.getfixturevalue(table)
    want = sorted((str(k), tuple(ids := [1, *library.encode(t), 2]), library.decode(ids)) for k, t in texts_of(docs))
    got = sorted((str(r["doc_id"]), tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in pieces.encode_and_decode(docs).collect())
    assert got == want


def test_pieces_of_random_strings_equal_the_library():
    own = pieces.PrefixEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    parts = [" ", "  ", "▁", "a", "th", "e", "in", "ing", "\n", "日", "é", "🎉", "<s>", "<0x0A>", ".", "...", "--", "1", "2024", "'s", "The", "ation", "\x00", "ا", "то"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [" " * k for k in range(40)] + ["a" * 500]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts])] == own.library.encode(texts)
    for unit in ("▁the", "▁internationalisation", "▁x..y"):
        assert [own.merged(unit[:i])[-1] for i in range(1, len(unit) + 1)] == own.last_tokens(unit)


# licences


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_base_licence_phrases_equal_brute_force(request, table):
    docs = request.getfixturevalue(table)
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    want = []
    for k, t in texts_of(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
        want.append((str(k), len(w), sorted((i, v) for p, v in phrases.items() for i in range(len(w)) if tuple(w[i: i + len(p)]) == p)))
    got = [(str(r["doc_id"]), r["n_words"], sorted((p["start"], p["label"]) for p in r["places"] if p["base"])) for r in licences.scan(docs).collect()]
    assert sorted(got) == sorted(want)


def test_licence_templates(spark):
    texts = ["Released under the MIT License.", "x Licensed under the Apache License, Version 2.0 and cc by; CC-BY-NC 4.0", "mit mit mit", "GNU Lesser General Public License",
             "all rights all rights reserved reserved ALL RIGHTS RESERVED", "license apache the under licensed", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: sorted((p["label"], p["start"]) for p in r["places"]) for r in licences.scan(docs).collect()}
    assert got[0] == [("mit", 0)] and got[2] == [] and got[5] == [] and got[6] == []
    assert got[1] == [("apache-2.0", 1), ("cc-by", 10), ("cc-by", 12), ("cc-by-nc", 10)]
    assert got[3] == [("gpl", 2), ("lgpl", -3)]
    assert got[4] == [("reserved", 2), ("reserved", 6)]


# language


def test_language_accuracy_and_unknown_texts(spark, odd):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    profiles = language.prototypes(docs, ~language.held_out())
    found = language.identify(docs, profiles, keys=("doc_id", "lang")).where(language.held_out())
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    got = collections.Counter(r["lang_pred"] == "und" for r in language.identify(odd, profiles).collect())
    letterless = sum(not any(c.isalpha() for c in t) for _, t in texts_of(odd))
    assert got[True] == letterless
    assert language.identified(odd, profiles).count() == odd.count() - letterless and language.identified(odd, profiles).columns == odd.columns
    assert {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.identified(odd, {}).count() == odd.count() - letterless


def test_trigrams_of_letters_alone():
    keys, owner = language.trigrams(["ab 1", "", "Ñ", "12"])
    assert collections.Counter(owner.tolist()) == {0: 2, 2: 1}
    assert (language.bind(keys, 64) ** 2 == 1).all()


# nearest neighbours


def brute_neighbours(rows, k):
    usable = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    vectors = np.array([v for _, v in usable], np.float64)
    ids = np.array([i for i, _ in usable])
    out = {}
    for n, (i, _) in enumerate(usable):
        if i % 5 == 0:
            order = [j for j in np.lexsort((ids, -(vectors @ vectors[n]))) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(vectors[j] @ vectors[n])) for j in order]
    return out


def test_neighbours_with_copies_and_unusable_vectors(spark):
    """Few distinct vectors: every candidate is reranked, so the result is exact, ties and copies included."""
    rng = np.random.default_rng(4)
    base = rng.integers(-3, 4, (40, 8)).astype(np.float32)
    rows = [(i, base[i % 40 if i % 3 else 0].tolist()) for i in range(300)]
    rows += [(500, None), (505, [0.0] * 8), (510, [None] + [1.0] * 7), (515, [float("nan")] * 8), (520, [float("inf")] * 8), (525, [1.0] * 3), (None, [1.0] * 8), (530, []), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "node": F.lit("n"), "rank": F.lit(0)})
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 5 == 0, k=7, block=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == brute_neighbours(rows, 7)
    assert neighbours.search(df.where("vec_id >= 500"), F.col("vec_id") % 5 == 0).count() == 0
    assert neighbours.search(df.where("vec_id IS NULL AND vec_id = 1"), F.lit(True)).count() == 0


def test_neighbours_recall(spark):
    df = spark.read.parquet(DATA.replace("0.001", "0.1") + "/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    vectors, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    found = collections.defaultdict(set)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    hit = total = 0
    for n in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.argsort(-(vectors @ vectors[n])) if j != n][:20]
        hit, total = hit + len(found[ids[n]] & set(ids[order])), total + 20
    assert hit / total >= 0.93


def test_neighbours_recall_when_pivots_grow(spark):
    """More pivots than the least number: the visited share of them, and with it recall, stays."""
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((4000, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(8)
    found = collections.defaultdict(set)
    for r in neighbours.search(df, F.col("vec_id") % 40 == 0, share=6.0).collect():
        found[r["query_id"]].add(r["vec_id"])
    hit = sum(len(found[n] & {j for j in np.argsort(-(vectors @ vectors[n]))[:21].tolist() if j != n}) for n in range(0, 4000, 40))
    assert hit / (100 * 20) >= 0.97


def test_neighbours_footrule_of_postings():
    """Postings add up to the footrule distance over the visited pivots; an order without a pivot counts it behind the last visited one."""
    rng = np.random.default_rng(9)
    perms = np.stack([rng.permutation(30)[:6] for _ in range(200)]).astype(np.int32)
    asked = np.stack([rng.permutation(30)[:10] for _ in range(40)]).astype(np.int32)
    near = neighbours._Files(perms, 30).nearness(asked)
    for i, q in enumerate(asked.tolist()):
        for j, x in enumerate(perms.tolist()):
            assert near[i, j] == sum(max(0, 11 - abs(r - x.index(p))) for r, p in enumerate(q) if p in x)


def test_neighbours_rerank_a_falling_share(spark):
    """Beyond 10,000 vectors a query compares only a part of them exactly, and a vector travels once for each block of queries."""
    rng = np.random.default_rng(10)
    vectors = rng.standard_normal((3000, 16))
    file = pd.DataFrame({"node": range(3000), "first_id": range(3000), "v": list(vectors), "perm": list(np.argsort(-(vectors @ vectors[:40].T), axis=1)[:, :12].astype(np.int32))})
    asked = pd.DataFrame({"q_node": [0, 1], "q_v": list(vectors[:2]), "q_perm": list(np.argsort(-(vectors[:2] @ vectors[:40].T), axis=1)[:, :16].astype(np.int32))})
    few, every = [neighbours._meet(20, 40, share)(asked, file) for share in (0.2, 1.0)]
    for q in (0, 1):
        best = set(every.where(every.qnode == q).dropna()["node"])
        assert best == set(np.argsort(-(vectors @ vectors[q]))[:21].tolist()) and len(best & set(few.where(few.qnode == q).dropna()["node"])) >= 17
    entries = spark.createDataFrame([(i, i, [0.0], [0]) for i in range(50)], "node long, first_id long, v array<float>, perm array<int>")
    assert neighbours._blocks(entries, 4, 3, ("a", "b")).groupBy("node").count().where("count <> 3").count() == 0


# exact duplicates


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_groups_of_odd_rows(odd, fan_in):
    groups = collections.defaultdict(list)
    for k, t in texts_of(odd):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(k)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(str(i), str(keep), len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = exact.groups(odd, fan_in=fan_in).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == sorted(want)
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_deduplicate_keeps_one_row_and_all_columns(odd):
    left = exact.deduplicate(odd)
    assert left.columns == odd.columns
    assert left.count() == exact.groups(odd).where("kept").count()


# personal data


def brute_spans(t):
    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            n = int(c) * (1 + i % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns(odd, documents):
    rng = random.Random(2)
    parts = ["a", "b.", "_", "%", "@", "x@y.z", "@y", ".", "..", "1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "-", " ", "  ", "+", "+1", "(", ")", "é", "🎉", "0000000000000000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    texts += [t for _, t in texts_of(odd)] + [t for _, t in texts_of(documents)]
    for t in texts:
        assert [s[:3] for s in private.spans(t) if s[0] in private.BASE] == brute_spans(t), t


def test_further_kinds_need_checksums_and_context():
    assert [s[0] for s in private.spans("IBAN GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert private.spans("GB82 WEST 1234 5698 7654 33 now") == []
    assert [s[0] for s in private.spans("her SSN is 123-45-6789.")] == ["ssn"] and private.spans("part 123-45-6789.") == []
    plain, near_word = private.spans("10.0.0.1")[0][3], private.spans("server 10.0.0.1")[0][3]
    assert near_word > plain


@pytest.mark.parametrize("text,numbers", [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]), ("DE89370400440532013000 2024", ["DE89370400440532013000"]),
    ("DE89370400440532013000 I paid", ["DE89370400440532013000"]), ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
    ("REF XX12 3456 ACCOUNT DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]), ("DE89 3704 0044 0532 0130 01 BIC COBADEFF", []),
])
def test_account_numbers_among_capitals_and_numbers(text, numbers):
    assert [text[a:b] for kind, a, b, _ in private.spans(text) if kind == "iban"] == numbers
    assert all(n not in private.mask(text, private.spans(text)) for n in numbers)


def test_redact_keeps_columns_and_null_texts(odd):
    got = {r["doc_id"]: r for r in private.redact(odd).collect()}
    assert private.redact(odd).schema == odd.schema and got[0]["text"] is None and got[12]["text"].count("[") == 2
    assert private.mask("a x@y.z b", private.spans("a x@y.z b")) == "a [email] b"


# repeated passages


def test_chunk_boundaries_survive_insertions():
    rng = random.Random(6)
    passage = bytes(rng.choice(b"abcdefghij ") for _ in range(4000))
    cuts = set(substrings.boundaries(passage))
    moved = {c - 37 for c in substrings.boundaries(b"x" * 37 + passage)}
    assert len(cuts - moved) <= 3
    sizes = np.diff(substrings.boundaries(passage))
    assert min(sizes[1:-1]) > substrings.NEAR and max(sizes) <= substrings.LONGEST
    assert substrings.boundaries(b"") == [0] and substrings.boundaries(b"a" * 3000)[-1] == 3000


def test_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for k in range(60):
        shared = text(rng.randint(55, 80))
        rows += [(1000 + 2 * k + i, f"{text(rng.randint(5, 90))} {shared} {text(rng.randint(5, 90))}") for i in (0, 1)]
    rows += [(i, text(rng.randint(5, 300))) for i in range(200)] + [(500, None), (501, ""), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"keep_id": F.lit(1), "high": F.lit(2)})
    got = substrings.repeats(docs).collect()
    assert {r["doc_id"] for r in got} == set(range(1000, 1120))
    bytes_of = {k: (t or "").encode() for k, t in rows if k is not None}
    for r in got:
        assert bytes_of[r["doc_id"]][r["start"]: r["start"] + r["length"]] == bytes_of[r["keep_id"]][r["keep_start"]: r["keep_start"] + r["length"]]
        assert r["kept"] == (r["doc_id"] % 2 == 0) and r["keep_id"] // 2 == r["doc_id"] // 2
    cut = {r["doc_id"]: r["text"] for r in substrings.cut_repeats(docs).collect()}
    assert len(cut) == len(rows) and cut[500] is None and cut[1000] == bytes_of[1000].decode() and all(len(cut[k]) < len(bytes_of[k]) - 100 for k in range(1001, 1120, 2))


def test_passages_of_51_short_words_are_found_to_their_last_byte(spark):
    """Against the longest common stretch of each pair of documents, found byte by byte."""
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows, spans = [], {}
    for k in range(400):
        shared = text(51)
        own = [(text(rng.randint(5, 40)) + x, y + text(rng.randint(5, 40))) for x, y in (("! ", " ?"), ("; ", " ."))]
        for i, (a, b) in enumerate(own):
            rows.append((2 * k + i, a + shared + b))
            whole = (" " + shared + " ").encode()
            spans[2 * k + i] = (len(a.encode()) - 1, len(whole))
    got = collections.defaultdict(list)
    for r in substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got[r["doc_id"]].append((r["start"], r["length"]))
        assert r["kept"] == (r["doc_id"] % 2 == 0) and (r["keep_id"], r["keep_start"]) == (r["doc_id"] // 2 * 2, spans[r["doc_id"] // 2 * 2][0])
    assert got == {k: [s] for k, s in spans.items()}


def test_extension_goes_on_where_no_boundary_is(spark):
    """A run of one byte has no boundary, however long; equal rows with one id are extended, different ones are not."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = "-" * 900 + word(300) + "-" * 900
    rows = [(1, "A" + passage + "B"), (2, word(70) + "C" + passage + "D"), (2, "no repeats")]
    one = substrings.repeats(spark.createDataFrame(rows[:2] + rows[1:2], "doc_id long, text string")).where("doc_id = 2 AND keep_id = 1 AND length >= 300").collect()
    assert (71, 2100, 1) in {(r["start"], r["length"], r["keep_start"]) for r in one}
    for r in substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert rows[r["doc_id"] - 1][1][r["start"]: r["start"] + r["length"]] == rows[r["keep_id"] - 1][1][r["keep_start"]: r["keep_start"] + r["length"]]


# all of them


def test_empty_tables(spark, none):
    path = scratch_path(spark, "ids")
    idfiles.write_ids(none, path)
    profiles = language.prototypes(none, F.lit(True))
    assert profiles == {}
    for df in (packing.pack(none), idfiles.read_ids(spark, path), near.links(none), near.deduplicate(none), pieces.encode_and_decode(none), licences.scan(none),
               language.identify(none, profiles), exact.groups(none), exact.deduplicate(none), private.find(none), private.redact(none), substrings.repeats(none),
               substrings.cut_repeats(none)):
        assert df.count() == 0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="text"):
        packing.pack(spark.range(1).withColumnRenamed("id", "doc_id"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_the_contract_columns(spark, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    if name.startswith("op1_"):
        assert all(zlib.crc32(b"") <= r["ids_crc32"] < 1 << 32 for r in rows)
    if name.split("_")[0] in ("op3", "op4", "op5", "op6", "op8", "op9", "op10"):
        assert len(rows) == 200 and got.columns[0] == "doc_id"
    if name in ORACLES:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        result = con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(tuple(map(str, r)) for r in result.fetchall()) == sorted(tuple(str(r[n]) for n in names) for r in rows)


def test_pipeline_against_brute_force(spark, odd):
    """Language, then equal texts, then near-duplicates of what is left, then masks, then every id packed once."""
    import corpus_pipeline

    docs = odd.unionByName(spark.read.parquet(f"{DATA}/documents.parquet"), allowMissingColumns=True).where("doc_id IS NOT NULL")
    docs = docs.withColumn("doc_id", F.col("doc_id") + F.when(F.col("kept").isNull(), 10_000).otherwise(0))
    rows = [(k, t) for k, t in texts_of(docs) if any(c.isalpha() for c in t)]
    first = {}
    for k, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (k, t))
    rows = sorted(first.values())
    keep = {k for (_, k), _, _, kept in brute_components(rows, 5) if kept}
    want = {k: private.mask(t, private.spans(t)) for k, t in rows if k in keep}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stored(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns
        docs = out
    assert dict(texts_of(docs)) == want
    packed = corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(want)
