"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Spans are code points, end exclusive, leftmost and non-overlapping within a kind. The base kinds (email, ip, card,
phone) are always kept; ``iban`` needs its mod-97 check and ``ssn`` needs a positive context.

Null or empty text gives no spans; repeated rows give one result row each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, kind_count, mapped, slices, span_digest, sql_spans, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, as a match ends with a whole run: no start inside a run is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.A)  # other scripts may touch it
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")

# Score before context, and after a checksum has confirmed the span.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": re.compile(r"mail|contact|write to|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|server|host|adresse", re.I),
    "card": re.compile(r"card|visa|credit|debit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|ruf|appel|llame", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social|security|insured", re.I),
}
AGAINST = re.compile(r"version|order|serial|isbn|part no|invoice", re.I)
CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """One look at each ``@``: its local part is the run before it, so long runs without an ``@`` cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def propose(text: str) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) of the confirmed spans of every kind, kind after kind."""
    for start, end in emails(text):
        yield start, "email", end
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(int(x) <= 255 if len(x) < 9 else not x.strip("0") or len(x.lstrip("0")) < 4 and int(x.lstrip("0")) <= 255 for x in m[0].split(".")):
            yield m.start(), "ip", m.end()
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), "card", m.end()
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.start(), "phone", m.end()
    for m in IBAN.finditer(text):
        if 15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code):
            yield m.start(), "iban", m.end()
    for m in SSN.finditer(text):
        if CONTEXT["ssn"].search(text, max(0, m.start() - CONTEXT_CHARS), m.end() + CONTEXT_CHARS):
            yield m.start(), "ssn", m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
    value = PRIOR[kind]
    if any(CONTEXT[kind].search(x) for x in near):
        value += (1 - value) / 2
    if any(AGAINST.search(x) for x in near):
        value /= 2
    return value


def spans_of(text: str | None) -> list[dict]:
    if not text:
        return []
    found = sorted(propose(text), key=lambda x: (x[0], KINDS.index(x[1])))
    return [{"kind": k, "start": s, "end": e, "score": score(text, k, s, e)} for s, k, e in found]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans, ordered by start, then kind. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spans_of(t) for t in batch.column(1).to_pylist()], kind)], ["doc_id", "spans"])

    return mapped(id_and_text(docs, id_col, text_col), run, f"doc_id long, spans {SPAN}")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return detect(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[kind_count(spans, k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_digest(spans, BASE), 256).alias("base_sha256"),
        span_digest(spans).alias("spans"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


_digits = "regexp_replace(part, '[^0-9]', '', 'g')"
_digit = f"cast(substr({_digits}, k, 1) AS int)"
_luhn = f"list_sum([CASE WHEN (len({_digits}) - k) % 2 = 0 THEN {_digit} WHEN {_digit} > 4 THEN 2 * {_digit} - 9 ELSE 2 * {_digit} END for k in range(1, len({_digits}) + 1)]) % 10 = 0"
_iban = "replace(part, ' ', '')"
_turned = f"concat(substr({_iban}, 5), substr({_iban}, 1, 4))"
# A letter is two digits; the remainder is carried from character to character.
_mod97 = f"list_reduce([cast(0 AS bigint)] || [CASE WHEN ascii(c) >= 65 THEN ascii(c) + 945 ELSE ascii(c) - 48 END for c in string_split({_turned}, '')], lambda a, v: CASE WHEN v >= 1000 THEN (a * 100 + v - 1000) % 97 ELSE (a * 10 + v) % 97 END) = 1"
# The patterns for an engine without lookaround: an ssn is a whole run of digits and hyphens.
SQL_PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max([coalesce(try_cast(concat('0', ltrim(x, '0')) AS hugeint), 256) for x in string_split(part, '.')]) <= 255"),
    "card": (CARD.pattern, f"len({_digits}) BETWEEN 12 AND 19 AND {_luhn}"),
    "phone": (PHONE.pattern, f"len({_digits}) BETWEEN 9 AND 15"),
    "iban": (IBAN.pattern, f"len({_iban}) BETWEEN 15 AND 34 AND {_mod97}"),
    "ssn": ("[0-9-]+", "regexp_full_match(part, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
}


def _sql_near(pattern: str) -> str:
    return f"(regexp_matches(before, '(?i){pattern}') OR regexp_matches(behind, '(?i){pattern}'))"


_prior = " ".join(f"WHEN '{k}' THEN cast({v} AS double)" for k, v in PRIOR.items())
_context = " OR ".join(f"(kind = '{k}' AND {_sql_near(p.pattern)})" for k, p in CONTEXT.items())
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
parts AS ({" UNION ALL ".join(sql_spans(rank, kind, *SQL_PATTERNS[kind]) for rank, kind in enumerate(KINDS))}),
placed AS (SELECT p.i, rank, kind, start, stop, substr(t, cast(greatest(start - {CONTEXT_CHARS}, 0) + 1 AS bigint), cast(least(start, {CONTEXT_CHARS}) AS bigint)) AS before, substr(t, cast(stop + 1 AS bigint), {CONTEXT_CHARS}) AS behind FROM parts AS p JOIN d ON p.i = d.i),
told AS (SELECT *, CASE kind {_prior} END AS prior, {_context} AS context, {_sql_near(AGAINST.pattern)} AS against FROM placed),
scored AS (SELECT *, concat(kind, ':', start, ':', stop) AS s, (CASE WHEN context THEN prior + (1 - prior) / 2 ELSE prior END) / (CASE WHEN against THEN 2 ELSE 1 END) AS score FROM told WHERE kind <> 'ssn' OR context),
n AS (SELECT i, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(s, ',' ORDER BY start, rank) FILTER (rank <= 3) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans, max(score) AS top_score FROM scored GROUP BY i)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(top_score, 0) AS top_score FROM d LEFT JOIN n ON d.i = n.i
"""
