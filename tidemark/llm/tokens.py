"""Ids of whole texts under a word tokenizer, exactly as the tokenizers library gives them.

The library's normaliser, pre-tokenizer and model never look across white space, so the ids of a text are the
ids of its pieces between white space, one after another. Pieces repeat a lot; each is encoded by the library
once per worker and kept as the bytes of its little-endian unsigned 32-bit ids. Texts that hold the start of
a special token's name ("<|") go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import kept_by_worker

#: Pieces that a worker keeps; beyond, it starts anew (frequent pieces come back at once). About 100 MB.
KEPT_PIECES = 500_000
#: Bytes of text encoded together: the more, the fewer look-ups of pieces that repeat.
SLICE_BYTES = 12 << 20
#: Words that the library encodes in one call, as one text.
CALL_WORDS = 1000
#: Longer pieces are encoded but not kept.
LONGEST_KEPT = 64
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


class PieceIds:
    """Encoder of one worker; ``texts`` are UTF-8 bytes, results bytes of uint32 ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kept: dict[bytes, bytes] = {}
        vocabulary = self.library.get_vocab()
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words made of letters alone: one unit of the model each, so its ids end at a token with the word-end suffix."""
        out: list[bytes] = []
        calls = [words[i:i + CALL_WORDS] for i in range(0, len(words), CALL_WORDS)]
        for call, joined in zip(calls, self._encode([b" ".join(c) for c in calls]), strict=True):
            ends = (4 * (np.flatnonzero(self.last[np.frombuffer(joined, "<u4")]) + 1)).tolist()
            if len(ends) != len(call):
                out += self._encode(call)
            else:
                out += [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _learn(self, pieces: set[bytes]) -> None:
        """Puts the ids of all pieces into ``kept``.

        A piece like ``word,`` ends in ASCII punctuation after an ASCII letter. The pre-tokenizer always cuts
        there (apostrophes aside, which are no part of the rule), so only its two parts need encoding.
        """
        kept = self.kept
        parts, cut = set(), []
        for p in pieces:
            stem = p.rstrip(_PUNCTUATION)
            if len(stem) < len(p) and stem and stem[-1] in _LETTERS:
                tail = p[len(stem):]
                cut.append((p, stem, tail))
                parts.add(stem)
                parts.add(tail)
            else:
                parts.add(p)
        need = pa.array([p for p in parts if p not in kept], pa.binary()).cast(pa.string())
        letters = pc.utf8_is_alpha(need)
        for group, encode in ((need.filter(letters), self._encode_words), (need.filter(pc.invert(letters)), self._encode)):
            group = group.cast(pa.binary()).to_pylist()
            kept.update(zip(group, encode(group), strict=True))
        for p, stem, tail in cut:
            kept[p] = kept[stem] + kept[tail]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        whole = [i for i, t in enumerate(texts) if b"<|" in t]
        if whole:
            rest = iter(self._encode_plain([t for t in texts if b"<|" not in t]))
            return [self._encode([t])[0] if b"<|" in t else next(rest) for t in texts]
        return self._encode_plain(texts)

    def _encode_plain(self, texts: list[bytes]) -> list[bytes]:
        """Splits all texts at once, looks up each distinct piece once and gathers the ids of all pieces."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string())))
        pieces = lists.flatten().dictionary_encode()
        if not len(pieces):
            return [b""] * len(texts)
        distinct = pieces.dictionary.cast(pa.binary()).to_pylist()
        kept = self.kept
        new = {p for p in distinct if p not in kept}
        self._learn(new)
        ids = [kept[p] for p in distinct]
        for p in new:
            if len(p) > LONGEST_KEPT:
                del kept[p]
        flat = np.frombuffer(b"".join(ids), "<u4")
        # a slice holds less than 2 ** 31 ids, as a byte of text gives one id at most
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        del distinct, ids
        at = np.cumsum(size, dtype=np.int32) - size
        index = pieces.indices.to_numpy()
        sizes = size[index]
        ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)))
        places = np.repeat(at[index] - ends[:-1], sizes)
        places += np.arange(ends[-1], dtype=np.int32)
        taken = flat[places].tobytes()
        del places
        bounds = (4 * ends[lists.offsets.to_numpy()].astype(np.int64)).tolist()
        return [taken[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def encoder(path: str) -> PieceIds:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    return kept_by_worker(f"pieces of {path}", lambda: PieceIds(path))
