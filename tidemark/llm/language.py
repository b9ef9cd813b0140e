"""Language identification with hyperdimensional profiles.

* Every letter has a random vector of +1 and -1, made from the letter's code point alone, so all tasks agree.
* A trigram is bound: the product of its letters' vectors, each permuted (rotated) by its place in the trigram.
* A text is bundled: the sum of the vectors of all its trigrams. Words are lower-cased runs of letters; all other
  characters count as one boundary between them, and a boundary is a symbol like a letter.
* A language's prototype is the bundle of all its training texts. A text gets the language whose prototype has the
  largest cosine with its own bundle; ties go to the first in alphabetical order.

Sums are linear, so the work is done on trigram counts: a task binds each trigram of a slice of texts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ensure_columns, in_batches, kept_by_worker, slices, whole_texts

DIMENSIONS = 512
UNKNOWN = "und"
#: Length of the texts whose trigrams are counted in one dense matrix.
COUNTED = 1 << 20
_BITS = np.uint64(21)
_MASK = np.uint64((1 << 21) - 1)


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return kept_by_worker("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all trigrams of the texts, and for each the number of its text. Texts without a letter have none."""
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = _letters()[points]
    keep = letter | np.concatenate(([True], letter[:-1] | (owner[1:] != owner[:-1]))) if len(points) else letter
    points, owner, letter = points[keep], owner[keep], letter[keep]
    symbols = np.where(letter, points, 0).astype(np.uint64)
    if len(symbols) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    keys = symbols[:-2] << (_BITS * np.uint64(2)) | symbols[1:-1] << _BITS | symbols[2:]
    whole = (owner[:-2] == owner[2:]) & letter[1:-1]
    return keys[whole], owner[:-2][whole]


def bind(keys: np.ndarray, dimensions: int) -> np.ndarray:
    """The vector of each trigram key, as int8 rows."""
    split = [(keys >> (_BITS * np.uint64(s)) & _MASK).astype(np.int64) for s in (2, 1, 0)]
    points, places = np.unique(np.concatenate(split), return_inverse=True)
    table = np.stack([np.random.default_rng(int(p) + 1).integers(0, 2, dimensions, np.int8) * 2 - 1 for p in points]) if len(points) else np.zeros((0, dimensions), np.int8)
    first, second, third = places.reshape(3, -1)
    return np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[second] * table[third]


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram keys of the texts and the matrix of their counts per text."""
    keys, owner = trigrams(texts)
    distinct, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(owner * np.int64(len(distinct)) + place, minlength=len(texts) * len(distinct)) if len(keys) else np.zeros(0)
    return distinct, counts.reshape(len(texts), len(distinct)).astype(np.float32)


def _parts(texts: list[str] | list[bytes]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > COUNTED:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def prototypes(docs: DataFrame, training: Column, *, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of all training texts of each value of ``lang``; rows with null lang or text teach nothing.

    Every task sends one vector per language, added up by language and dimension on the cluster; the driver gets
    the sums, ``dimensions`` numbers per language. Repeated rows count as often as they stand; an empty table teaches no language.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in slices(batches, "text"):
            langs = part.column("lang").to_pylist()
            for begin, end in _parts(texts):
                distinct, counts = counted([t.decode() for t in texts[begin:end]])
                if not len(distinct):
                    continue
                vectors = bind(distinct, dimensions).astype(np.float32)
                names = sorted(set(langs[begin:end]))
                of = np.array([names.index(x) for x in langs[begin:end]])
                by_lang = np.stack([counts[of == k].sum(axis=0) for k in range(len(names))])
                for name, v in zip(names, (by_lang @ vectors).astype(np.float64), strict=True):
                    sums[name] = sums.get(name, 0) + v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sent = in_batches(rows, work, "lang string, v array<double>")
    totals = sent.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in totals:
        out.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["x"]
    return {k: v for k, v in sorted(out.items()) if v.any()}


def _best(texts: list[str], profiles: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """For each text the language of the nearest prototype, and the cosine."""
    best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    names = sorted(profiles)
    if not names:
        return best, score
    matrix = np.stack([profiles[n] / np.linalg.norm(profiles[n]) for n in names])
    for begin, end in _parts(texts):
        distinct, counts = counted(texts[begin:end])
        if not len(distinct):
            continue
        bundles = (counts @ bind(distinct, matrix.shape[1]).astype(np.float32)).astype(np.float64)
        length = np.linalg.norm(bundles, axis=1)
        cosine = bundles @ matrix.T / np.where(length > 0, length, 1)[:, None]
        lettered = counts.sum(axis=1) > 0
        for i, k in enumerate(cosine.argmax(axis=1)):
            if lettered[i]:
                best[begin + i], score[begin + i] = names[k], min(1.0, max(0.0, cosine[i, k]))
    return best, score


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], *, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the key columns, ``lang_pred`` and ``score`` (the cosine, 0 at least).

    ``und`` with score 0 if the text is null, holds no letter, or nothing was learned. Ties go to the language that comes first by name. Repeated rows
    and null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    ensure_columns(docs, *keys, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            best, score = _best([t.decode() for t in texts], profiles)
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keys))], pa.array(best), pa.array(score)], names=[*keys, "lang_pred", "score"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return in_batches(whole_texts(docs, keys=keys), work, f"{schema}, lang_pred string, score double")


def identified(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """docs with all its columns, without the rows that ``identify`` gives no language: null texts and texts without a letter.

    If nothing was learned, rows whose text holds a letter stay. Nulls in other columns, repeated rows and empty tables stay as they are.
    """
    ensure_columns(docs, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            best = _best([t.decode() for t in texts], profiles)[0] if profiles else [any(map(str.isalpha, t.decode())) or UNKNOWN for t in texts]
            yield part.filter(pa.array([b != UNKNOWN for b in best], pa.bool_()))

    return in_batches(docs, work, docs.schema)


def held_out() -> Column:
    """Rows that teach nothing: crc32 of the id's text leaves 2 when divided by 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
