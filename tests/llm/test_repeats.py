"""Repeated passages: hot groups of equal texts, many spans in one text, and the bytes covered against brute force."""

import collections
import random

import pytest

from tidemark.llm import substrings


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def repeats(spark, rows, parts=4):
    return substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()


def covered(rows, kept):
    found = collections.defaultdict(set)
    for r in rows:
        if r["kept"] == kept:
            found[r["doc_id"]] |= set(range(r["start"], r["start"] + r["length"]))
    return found


def test_a_hot_group_of_long_equal_texts(spark):
    """Each copy is one row, whatever the text's length, and carries the group's size."""
    rng = random.Random(1)
    text = words(rng, 17_000)
    assert len(text) > 100_000
    rows = [(i, text) for i in range(10, 410)] + [(5, words(rng, 300)), (6, text[:60] + words(rng, 100)), (900, None), (901, "short"), (902, "short")]
    got = repeats(spark, rows)
    whole = [r for r in got if r["length"] == len(text)]
    assert len(whole) == 400 and {r["keep_id"] for r in whole} == {10} and {r["copies"] for r in whole} == {400}
    assert [r["doc_id"] for r in whole if r["kept"]] == [10] and not {5, 900, 901, 902} & {r["doc_id"] for r in got}


def test_many_spans_in_one_text(spark):
    rng = random.Random(2)
    passages = [words(rng, 60) for _ in range(500)]
    rows = [(i, f"{words(rng, 5)}! {p} ?{words(rng, 5)}") for i, p in enumerate(passages)]
    rows.append((1000, "".join(f"{words(rng, 3)}; {p} ." for p in passages)))
    got = [r for r in repeats(spark, rows) if r["doc_id"] == 1000]
    text = rows[-1][1].encode()
    assert len(got) == 500 and {r["keep_id"] for r in got} == set(range(500)) and not any(r["kept"] for r in got)
    for r in got:
        assert text[r["start"]: r["start"] + r["length"]].decode().strip() == passages[r["keep_id"]]


@pytest.mark.parametrize("seed", [3, 4])
def test_covered_bytes_equal_brute_force(spark, seed):
    """All bytes of passages put together from earlier ones are covered; nothing of a text's own is, but for what agrees by chance at the ends."""
    rng = random.Random(seed)
    pool = [words(rng, 60) for _ in range(12)]
    rows, spans = [], collections.defaultdict(set)
    seen = set()
    for i in range(80):
        text = ""
        for _ in range(rng.randint(1, 4)):
            text += words(rng, rng.randint(3, 30)) + "#"
            k = rng.randrange(len(pool))
            cut = pool[k]
            if k in seen:
                spans[i] |= set(range(len(text), len(text) + len(cut)))
            seen.add(k)
            text += cut + "|"
        rows.append((i, text))
    got = covered(repeats(spark, rows), False)
    for i, want in spans.items():
        assert want <= got[i]
        assert len(got[i] - want) <= 12 * rows[i][1].count("#")
    assert all(i in spans for i in got)
