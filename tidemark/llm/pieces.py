"""SentencePiece encoding by a table of prefixes, and decoding.

A merge-type model (BPE) gives each prefix of a text one encoding, so each prefix has one last token. The table stores it:

* An automaton over all pieces finds the pieces that end at a position.
* Such a piece is the prefix's last token if the token before it, the last one of the shorter prefix, is compatible:
  if merging the two pieces' characters gives these two pieces again. Exactly one candidate passes.
* The ids are recovered backwards from the end.

Compatibility needs no merging: as a piece always ranks behind its parts, a merge happens at its rank, and two pieces
fail if some piece across their border ranks before the pieces that its two halves go into on either side.

No piece holds a space mark after another character, so a text's ids are those of its units (a word with the mark before
it), one after another. Units repeat; a worker keeps the ids of those it met. Pieces made of several marks share one score, which
leaves their order to positions; units that begin with several marks are merged directly.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import ensure_columns, in_batches, kept_by_worker, slices, tokenizer_path, whole_texts

MARK = "▁"
#: Units, and pairs of pieces, that a worker keeps; beyond, it starts anew. About 200 MB together.
KEPT_UNITS = 600_000
KEPT_PAIRS = 400_000
LONGEST_KEPT = 64
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NEVER = float("inf")


class PrefixEncoder:
    """Encoder and decoder of one worker for one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        kind = model.SentencePiece
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("not a plain merge-type model")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("a model without normalisation, with a space before the text and byte fallback, is needed")
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a space mark after another character")
        self.ids = normal
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        #: By piece of two characters or more: its place in the order of merges (a better score comes first).
        self.rank = {p: -model.pieces[i].score for p, i in normal.items() if len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        for p in normal:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.single = {p for p in normal if len(p) == 1}
        self.spines: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.kept: dict[bytes, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a text by merging: the best score first, the leftmost of equal ones."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap = [(r, i, i + 1, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or parts[i] + parts[j] != whole or right[i] != j:
                continue
            parts[i], parts[j], right[i] = whole, None, right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < len(parts) and (r := self.rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, b, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def _spines(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The growing right end of a piece and its growing left end, each step with the rank at which it is merged on;
        None if merging the piece's characters doesn't give the piece."""
        if piece in self.spines:
            return self.spines[piece]
        parts, ends = list(piece), ([piece[-1]], [piece[0]])
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
            for steps, end in zip(ends, (parts[-1], parts[0]), strict=True):
                if steps[-1] != end:
                    steps.append(end)
        found = None
        if len(parts) == 1:
            found = tuple([(s, self.rank[after] if after else _NEVER) for s, after in zip(steps, [*steps[1:], None], strict=True)] for steps in ends)
        self.spines[piece] = found
        return found

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of a and b gives a and b."""
        left, right = self._spines(a), self._spines(b)
        if left is None or right is None:
            return False
        rank = self.rank
        for y, y_until in right[1]:
            for x, x_until in left[0]:
                r = rank.get(x + y)
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def last_tokens(self, unit: str) -> list[str]:
        """For each prefix of the unit (of one character or more) its last token."""
        last: list[str] = [""] * (len(unit) + 1)
        pairs, single = self.pairs, self.single
        done = 0
        for end, piece in self.automaton.iter(unit):
            end += 1
            while done < end - 1:  # characters where no piece ends
                done += 1
                if not last[done]:
                    last[done] = unit[done - 1]
            if last[end]:
                continue
            before = last[end - len(piece)]
            if not before:
                ok = end == len(piece) and self._spines(piece) is not None
            else:
                ok = pairs.get((before, piece))
                if ok is None:
                    ok = pairs[before, piece] = self.compatible(before, piece)
            if ok:
                last[end] = piece
                done = end
        for i in range(1, len(unit) + 1):
            if not last[i]:
                if unit[i - 1] in single:
                    raise AssertionError(f"no last token at {i} of {unit!r}")
                last[i] = unit[i - 1]
        return last[1:]

    def unit(self, unit: str) -> bytes:
        if unit.startswith(MARK * 2):
            tokens = self.merged(unit)
        else:
            last, tokens, at = self.last_tokens(unit), [], len(unit)
            while at:
                tokens.append(last[at - 1])
                at -= len(last[at - 1])
            tokens.reverse()
        out: list[int] = []
        for t in tokens:
            if t in self.ids:
                out.append(self.ids[t])
            else:
                out += [self.bytes[b] for b in t.encode()]
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts (UTF-8), as little-endian unsigned 32-bit; without begin and end ids."""
        if len(self.kept) > KEPT_UNITS:
            self.kept.clear()
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        mark = MARK.encode()
        split = []
        for t in texts:
            if not t:
                split.append([])
            elif b"  " in t or t[:1] == b" " or t[-1:] == b" " or mark in t:
                split.append([u.encode() for u in _UNIT.findall(MARK + t.decode().replace(" ", MARK))])
            else:
                split.append(t.split(b" "))
        new = set().union(*split) - self.kept.keys()
        for u in new:  # units without the mark are words: the mark belongs before them
            text = u.decode()
            self.kept[u] = self.unit(text if text.startswith(MARK) else MARK + text)
        get = self.kept.__getitem__
        out = [b"".join(map(get, units)) for units in split]
        for u in new:
            if len(u) > LONGEST_KEPT:
                del self.kept[u]
        return out


def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder for a model file; kept between tasks."""
    return kept_by_worker(f"prefixes of {path}", lambda: PrefixEncoder(path))


def encode_and_decode(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """One row per row of docs: ``doc_id``, ``ids`` (little-endian unsigned 32-bit, with begin and end id) and ``decoded``.

    A null or empty text gives the two ids and an empty text. Repeated rows and null ids are kept; other columns are ignored. A text of any length is
    encoded whole, one at a time if it is longer than a slice; an empty table gives no rows.
    """
    ensure_columns(docs, "doc_id", "text")
    model = model or tokenizer_path("piece_bpe_32k.model")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        begin, end = (np.array([i], "<u4").tobytes() for i in (own.library.bos_id(), own.library.eos_id()))
        for part, texts in slices(batches, "text"):
            ids = [begin + x + end for x in own.encode(texts)]
            decoded = [own.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return in_batches(whole_texts(docs), work, "doc_id bigint, ids binary, decoded string")
