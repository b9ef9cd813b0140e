"""Every column of the registered queries without SQL, against a plain version of its contract."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from tests.conftest import DATA
from tests.llm.test_operators import brute_components, brute_spans
from tidemark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def word_ids(documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {k: library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for k, r in documents.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, word_ids):
    rows = QUERIES["op1_packing"](spark, DATA).collect()
    own, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = word_ids[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"]: r["start"] + r["length"]]) and r["length"] > 0
        own[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(own) == set(word_ids)
    for pieces, size in [*((p, len(word_ids[k])) for k, p in own.items()), *((w, None) for w in windows.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == size if size is not None else at <= 2048
    used = sum(n for w in windows.values() for _, n in w)
    padded = sum(2 ** math.ceil(math.log2(n)) if n & (n - 1) == 0 else 2048 for n in (sum(x for _, x in w) for w in windows.values()))
    assert padded <= 1.03 * used + 2048


def test_op9(spark, word_ids):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op9_id_files"](spark, DATA).collect()}
    want, at = {}, 0
    for k in sorted(word_ids):
        want[k] = (at, len(word_ids[k]), crc(word_ids[k]))
        at += len(word_ids[k])
    assert got == want


def test_op3(spark, documents):
    got = sorted((((True, r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op3_near_dedup"](spark, DATA).collect()), key=repr)
    assert got == sorted(brute_components([(k, r["text"] or "") for k, r in documents.items()], 4), key=repr)


def test_op4(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op4_sentencepiece"](spark, DATA).collect()}
    for k, r in documents.items():
        ids = [library.bos_id(), *library.encode(r["text"] or ""), library.eos_id()]
        assert got[k] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_op5(spark, documents):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    got = {r["doc_id"]: r for r in QUERIES["op5_licences"](spark, DATA).collect()}
    assert set(got) == set(documents)
    for k, r in documents.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(lower))
        base = [(i, v) for p, v in phrases.items() for i in range(len(w)) if tuple(w[i: i + len(p)]) == p]
        g = got[k]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(w), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None))
        assert g["base_labels"] == ",".join(sorted({v for _, v in base}))
        labels = [x for x in g["labels"].split(",") if x]
        assert labels == sorted(set(labels)) and {v for _, v in base} <= set(labels) and 0 <= g["score"] <= 1 and (g["score"] > 0) == bool(labels)


def test_op6(spark, documents):
    rows = QUERIES["op6_language"](spark, DATA).collect()
    learned = {r["lang"] for k, r in documents.items() if r["lang"] is not None and zlib.crc32(str(k).encode()) % 4 != 2}
    right = []
    for r in rows:
        d = documents[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in d["text"] or "")) and r["lang_pred"] in learned | {"und"}
        if r["held_out"] and d["lang"] is not None and r["lang_pred"] != "und":
            right.append(r["lang_pred"] == d["lang"])
    assert len(rows) == len(documents) and sum(right) >= 0.95 * len(right)


def test_op7(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    usable = {i: np.array(v, np.float64) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    got = collections.defaultdict(list)
    for r in QUERIES["op7_neighbours"](spark, DATA).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    assert set(got) == {i for i in usable if i % 20 == 0}
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, min(20, len(usable) - 1) + 1)) and q not in {x[1] for x in found}
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(float(usable[q] @ usable[i]), abs=1e-12)
        best = sorted((-float(usable[q] @ v), i) for i, v in usable.items() if i != q)[:20]
        hits, total = hits + len({i for _, i in best} & {x[1] for x in found}), total + len(best)
    assert hits >= 0.9 * total


def test_op10(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op10_personal_data"](spark, DATA).collect()}
    kinds = ("email", "ip", "card", "phone")
    for k, d in documents.items():
        found = brute_spans(d["text"] or "")
        base = [f"{kind}:{a}:{b}" for kind in kinds for a, b in sorted((a, b) for x, a, b in found if x == kind)]
        r = got[k]
        assert [r[f"n_{kind}"] for kind in kinds] == [sum(x[0] == kind for x in found) for kind in kinds]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert spans[: len(base)] == base and all(x.split(":")[0] not in kinds for x in spans[len(base):])
    assert set(got) == set(documents)
