"""PII spans: regular expressions propose, checksums confirm, context scores.

Base kinds (email, ip, card, phone) follow their patterns exactly: leftmost,
non-overlapping per kind, a match that fails its check is dropped and not
retried. They start above the threshold, so context never removes one. The
added kinds need a checksum (``iban``: mod 97) or a supporting word nearby
(``local_phone``, ``ssn``, ``short_card``); their score is
prior + checksum + context and only spans at or over ``THRESHOLD`` count.

Null texts count as empty: no spans. Texts of any length are read whole, and
every scan is linear. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "short_card", "local_phone", "ssn")
KINDS = BASE_KINDS + EXTRA_KINDS
THRESHOLD = 0.5
#: Code points on each side that may hold a supporting word.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")

# Prior score of a kind and the words that support it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.3, "short_card": 0.1, "local_phone": 0.2, "ssn": 0.2}
SUPPORT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"), "short_card": ("card", "visa", "mastercard", "amex", "credit", "debit"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "fax"), "ssn": ("ssn", "social"),
}
_NEAR = {k: re.compile(r"(?<![a-z])(?:" + "|".join(w) + r")(?![a-z])") for k, w in SUPPORT.items()}
CHECKSUM_BONUS, CONTEXT_BONUS = 0.3, 0.35


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        else:
            last = max(last, at + 1)  # a later local part can't reach back over this @
        at = text.find("@", max(last, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        chain = m.group()
        if chain.count(".") < 3:
            continue
        parts, at = chain.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _near(kind: str, low: str, start: int, end: int) -> bool:
    return bool(_NEAR[kind].search(low, max(0, start - CONTEXT), start) or _NEAR[kind].search(low, end, end + CONTEXT))


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans, by kind in ``KINDS`` order, then
    start; code points, end exclusive."""
    text = text or ""
    found: list[tuple[str, int, int, bool]] = [("email", s, e, False) for s, e in _emails(text)]
    if not found and not any(d in text for d in "0123456789"):
        return []
    found += [("ip", s, e, False) for s, e in _ips(text)]
    short = []
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() <= 37 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end(), True))
        elif 13 <= len(d) <= 15 and luhn(d):
            short.append(("short_card", m.start(), m.end(), True))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            found.append(("phone", m.start(), m.end(), False))
    base = [(s, e) for _, s, e, _ in found]
    for m in _IBAN.finditer(text):
        value = m.group().replace(" ", "")
        # the pattern may run on into a following word in capitals
        for n in range(len(value), 14, -1):
            if mod97(value[:n]):
                end, left = m.start(), n
                while left:
                    left -= text[end] != " "
                    end += 1
                if end == len(text) or not text[end].isalnum():
                    found.append(("iban", m.start(), end, True))
                    break
    found += short
    found += [("local_phone", m.start(), m.end(), False) for m in _LOCAL_PHONE.finditer(text)]
    found += [("ssn", m.start(), m.end(), False) for m in _SSN.finditer(text)]
    low, out = text.lower(), []
    if len(low) != len(text):  # a few letters grow when lower-cased
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for kind, s, e, summed in found:
        if kind not in BASE_KINDS and any(s < be and bs < e for bs, be in base):
            continue
        score = min(1.0, PRIOR[kind] + CHECKSUM_BONUS * summed + CONTEXT_BONUS * _near(kind, low, s, e))
        if score >= THRESHOLD:
            out.append((kind, s, e, score))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def _join(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def spans(text: str | Column) -> Column:
    """All spans of a text column as an array of structs."""

    def each(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            rows = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find_spans(t.as_py())] for t in texts]
            yield pa.array(rows, _ARROW)

    each.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, SPAN_TYPE)(text)


def redact_text(text: str) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the
    earlier, then longer, wins."""
    out, at = [], 0
    for kind, s, e, _ in sorted(find_spans(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
        elif e > at:  # the rest of an overlapping span goes too
            at = e
    return "".join(out) + text[at:]


def redact(text: str | Column) -> Column:
    """The text without its personal data; null stays null."""

    def each(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array([None if t is None else redact_text(t) for t in (x.as_py() for x in texts)], pa.string())

    each.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, "string")(text)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, SHA-256 of the base
    span list, the list of all spans and the highest score."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                all_spans = find_spans(t.as_py())
                base = [x for x in all_spans if x[0] in BASE_KINDS]
                rows.append([*(sum(x[0] == k for x in base) for k in BASE_KINDS),
                             hashlib.sha256(_join(base).encode()).hexdigest(), _join(all_spans),
                             max((x[3] for x in all_spans), default=0.0)])
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            cols = [pa.array([r[i] for r in rows], types[i]) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "max_score"])

    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(each, "id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, max_score double")
    return out.withColumnRenamed("id", id_col)
