"""Product codes against plain rounds of assignment and averaging."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, salt int, vector string"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in kept]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not whole:
        return []
    width = len(whole[0][1]) // parts
    cut = [[v[p * width: (p + 1) * width] for p in range(parts)] for _, v, _ in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(column) // len(own) for column in zip(*own)]
    last = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in last]
    by_label = {}
    for (_, _, label), e in zip(whole, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest) for (i, _, label), f, err in zip(whole, last, errors)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "v") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed,entries,cell", [(1, 256, 64), (2, 5, 1), (3, 16, 4096)])
def test_codes_equal_plain_rounds(spark, seed, entries, cell):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, None, 7]), [rng.gauss(0, 0.3) for _ in range(8)], rng.choice([1, 1, 1, 2, None])) for i in range(400)]
    rows += [(i, list(rows[0][1]), 1) for i in range(1000, 1150)]  # copies of one vector, in one label
    rows += [(5, None, 1), (6, [], 1), (8, [1.0, None] * 4, 1), (9, [float("nan")] * 8, 2), (10, [float("inf")] + [0.0] * 7, 2), (11, [0.0] * 8, None), (12, [50000.0] * 8, 2), (13, [-50000.0] * 8, 2)]
    got = codes.encode(frame(spark, rows), entries=entries, cell=cell)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, entries=entries)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 0.25, -0.5, 1.0], None), (2, [0.5, 0.25, -0.5, 1.0], None)]
    assert sorted(map(tuple, codes.encode(frame(spark, rows)).collect())) == brute(rows)
    assert codes.encode(frame(spark, rows).where("vec_id > 5")).count() == 0
    assert codes.encode(frame(spark, [(1, None, 1), (2, [], 2)])).count() == 0


def test_what_can_not_be_coded_says_so(spark):
    for rows in ([(1, [1.0] * 6, 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [70000.0] * 4, 1)]):
        with pytest.raises(ValueError):
            codes.encode(frame(spark, rows))


def test_no_candidate_is_lost_in_any_cell():
    rng = np.random.default_rng(4)
    for cell in (1, 7, 64, 500):
        books = rng.integers(-300, 300, (2, 40, 3))
        vectors = np.concatenate([rng.integers(-300, 300, (500, 6)), books.transpose(1, 0, 2).reshape(40, 6)])
        index, distance = codes.Coder(books, cell).assign(vectors)
        for p in range(2):
            d = ((vectors[:, None, p * 3: p * 3 + 3] - books[p][None]) ** 2).sum(2)
            assert (index[:, p] == d.argmin(1)).all() and (distance[:, p] == d.min(1)).all()


def test_cells_are_remembered():
    books = np.zeros((1, 2, 2), np.int64) + np.array([[0, 0], [100, 100]])
    coder = codes.Coder(books, 10)
    coder.assign(np.array([[1, 1], [2, 3], [9, 9], [95, 99]]))
    assert len(coder.cells[0].kept) == 2 and [len(x) for x in coder.cells[0].kept.values()] == [1, 1]
