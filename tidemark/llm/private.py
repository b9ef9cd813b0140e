"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Kinds with a fixed definition (email, ip, card, phone) are always reported; two more are proposed by this operator and
kept only if checksum and context give them a score of at least ``keep``: iban (mod 97) and ssn (its shape is common, so it
needs a context word). All searches take time linear in the text: no pattern can rescan a long run of digits or
letters from each of its characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ensure_columns, in_batches, slices, whole_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
KEEP = 0.5
#: Score of a span by its kind alone; a context word near it adds BONUS.
PLAIN = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
BONUS = 0.2
#: Characters before and after a span in which context words count.
NEAR = 48
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mailto|contact|write)\b", re.I), "ip": re.compile(r"\b(?:ip|address|host|server|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|payment)\b", re.I), "phone": re.compile(r"\b(?:phone|call|tel|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|transfer)\b", re.I), "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
}
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_NUMBER = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_WORD = re.compile(r"[A-Z0-9]++")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    """Whether the sum of the digits, every second one from the right doubled, ends in 0."""
    plain, doubled = digits[-1::-2], digits[-2::-2].translate(_DOUBLED)
    return (sum(map(int, plain)) + sum(map(int, doubled))) % 10 == 0


def mod97(code: str) -> bool:
    """Whether an international account number's check digits hold."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and a domain with a dot; found from each @ outwards."""
    free = before = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            lead = text[max(free, before): at]
            start = at - (len(lead) - len(lead.rstrip(_LOCAL)))
            if start < at:
                yield start, m.end()
                free = m.end()
        before = at + 1
        at = text.find("@", before)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: of each stretch of capitals and digits the longest part from its start to a word's end whose check digits hold.

    The stretch may go on after the number (BIC, a year, the next number), so the search goes on at the number's end, or behind the
    first word if no part holds. A stretch has 34 capitals and digits at most, so the time stays linear.
    """
    m = _IBAN.search(text)
    while m:
        ends = [w.end() for w in _WORD.finditer(text, m.start(), m.end())]
        end = next((e for e in reversed(ends) if 15 <= len(code := text[m.start(): e].replace(" ", "")) <= 34 and mod97(code)), None)
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or ends[0])


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def spans(text: str, keep: float = KEEP) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) of one text, by kind in the order of KINDS, then by start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            for x in _IP.finditer(text, m.start(), m.end()):
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in x[0].split(".")):
                    found.append(("ip", *x.span()))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    found += [("iban", *x) for x in ibans(text)]
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out = []
    for kind, start, end in found:
        near = text[max(0, start - NEAR): start] + " " + text[end: end + NEAR]
        score = min(1.0, PLAIN[kind] + BONUS * bool(CONTEXT[kind].search(near)))
        if kind in BASE or score >= keep:
            out.append((kind, start, end, score))
    return out


def mask(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span as [kind]; where spans overlap, the earliest (then longest) names the stretch they cover."""
    parts, at = [], 0
    for kind, start, end, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find(docs: DataFrame, *, keep: float = KEEP) -> DataFrame:
    """One row per row of docs: ``doc_id`` and ``spans``, an array of (kind, start, end, score) in code points.

    A null or empty text has no spans. Repeated rows and null ids are kept as they are; other columns are ignored; an empty table gives no rows.
    """
    ensure_columns(docs, "doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t.decode(), keep)] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return in_batches(whole_texts(docs), work,
                      f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind string, start bigint, end bigint, score double>>")


def redact(docs: DataFrame, *, keep: float = KEEP) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in brackets; null texts stay null, all other columns, repeated rows and empty tables as they are."""
    ensure_columns(docs, "text")
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            known = part.column(place).is_valid().to_pylist()
            new = [mask(t, spans(t, keep)) if ok else None for t, ok in zip((t.decode() for t in texts), known, strict=True)]
            yield part.set_column(place, part.schema.field(place), pa.array(new, part.schema.field(place).type))

    return in_batches(docs, work, docs.schema)


def of_kinds(*kinds: str) -> Column:
    """The spans of these kinds."""
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def joined(*kinds: str) -> Column:
    """The spans of these kinds as kind:start:end, comma-joined."""
    return F.array_join(F.transform(of_kinds(*kinds), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
