"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import with_imports

#: Bytes of text that a Python task turns into objects at a time; whatever the rows of an Arrow batch hold.
SLICE_BYTES = 8 << 20


_KEPT: dict[str, object] = {}


def kept_by_worker(kind: str, make: Callable[[], object]) -> object:
    """The state of one kind (an encoder, hashes of words) that a Python worker keeps between tasks.

    A worker holds one kind at a time: what another operator left is dropped, so stages that follow one another don't add up.
    """
    if kind not in _KEPT:
        _KEPT.clear()
        _KEPT[kind] = make()
    return _KEPT[kind]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_texts(docs: DataFrame, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and the text alone, null texts as empty; all other columns are left behind."""
    return docs.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text))


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of this package."""
    return with_imports(df).mapInArrow(work, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts Arrow batches so that each part holds about ``most`` bytes of the text column, one row at least.

    Yields the part and its texts as UTF-8 bytes (null as empty).
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield _part(batch, column, begin, i)
                begin, held = i, 0
            held += n + 64
        if begin < len(sizes):
            yield _part(batch, column, begin, len(sizes))


def _part(batch: pa.RecordBatch, column: str, begin: int, end: int) -> tuple[pa.RecordBatch, list[bytes]]:
    part = batch.slice(begin, end - begin)
    kind = pa.large_binary() if pa.types.is_large_string(part.column(column).type) else pa.binary()
    return part, [x or b"" for x in part.column(column).cast(kind).to_pylist()]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ensure_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
