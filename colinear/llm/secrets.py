"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are always reported: ``assign`` (a named secret with a value of 6 or more characters), ``access`` (access
identifiers) and ``hex`` (24 or more hexadecimal digits). Weak candidates say little alone: ``keyid`` (a named user or
key identifier), ``blob`` (a long mixed token) and ``endpoint`` (a URL). A weak candidate is reported only when a
complementary part lies within SCOPE code points: an identifier needs a secret, a blob an identifier or endpoint, an
endpoint a secret or access identifier. That is an interval join: a part is filed under every tile of SCOPE code points
from its start to its end, each (document, tile, role) is summed up by its first start and last end, and a candidate
probes every tile from SCOPE before its start to SCOPE after its end, so dense documents cost no pairs and the rows grow
with the length of the parts. The sums are exact: parts on both sides of a candidate's scope never share a tile.

Spans are code points, end exclusive, leftmost and non-overlapping within a kind. They are found by putting a mark
around every match and adding up the lengths of what lies between the marks; U+0001, the mark, is read as U+0002, which
no pattern holds either. Null or empty text has no spans; an empty table gives an empty result; repeated rows give one
result row each, and rows without an id are told apart by their text. Spans that start together are ordered by kind. A
very long text is one row's work, which grows with its length and its matches. Other columns are passed through a
struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, kind_count, span_digest, sql_spans, stored, table

# The base patterns.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # the maximal runs of 24 or more, as a longest leftmost match takes a whole run

KEYID = r"(?i:(access[_-]?key[_-]?id|client[_-]?id|key[_-]?id|username))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@=-]{4,})"
BLOB = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+={0,2}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?"

BASE = ("assign", "access", "hex")
WEAK = ("keyid", "blob", "endpoint")
KINDS = (*BASE, *WEAK)
ROLE = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "identifier", "keyid": "identifier", "endpoint": "endpoint"}
NEEDS = {"keyid": ("secret",), "blob": ("identifier", "endpoint"), "endpoint": ("secret", "identifier")}
SCOPE = 200
MASK = "[secret]"
CHUNK = 256  # items whose results are put together at once
CUT = 32  # spans from which a text is masked by its characters, so that its beginning is not walked again for each
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


# Literals of which a text must hold one for the kind's pattern to match at all, compared in lower case where ``lower``.
LITERALS = {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey"), "keyid": ("username", "client", "key"), "access": ("AKIA",), "endpoint": ("http",)}


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value computed once for a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def _scanned(items: Column, state: Column, step, kind: str) -> Column:  # noqa: ANN001
    """All that step(state, item) -> (state, array to append) appends, item after item, as an array of ``kind``.

    An array that grows by one is copied each time. So items are taken in chunks of CHUNK, whose results are listed and
    joined at the end: the cost grows with the number of items, and only its square over CHUNK squared.
    """
    none, lists = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, item: Column) -> Column:
        after, more = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], more).alias("out"))

    def chunk(acc: Column, k: Column) -> Column:
        done = F.aggregate(F.slice(items, k * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    chunks = F.sequence(F.lit(0), F.ceil(F.size(items) / CHUNK).cast("int") - 1)
    found = F.aggregate(chunks, F.struct(state.alias("state"), lists.alias("out")), chunk)["out"]
    return F.when(F.size(items) > 0, F.flatten(found)).otherwise(none)


def _found(text: Column, lower: Column, kind: str, pattern: str, holds) -> Column:  # noqa: ANN001
    """Spans of the pattern's matches for which holds(match) is true; texts without its literals are not searched."""
    rank = KINDS.index(kind)

    def step(state: Column, part: Column) -> tuple[Column, Column]:
        end = state["at"] + F.length(part)
        span = F.struct(state["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        taken = F.when(state["match"] & holds(part), F.array(span)).otherwise(F.array().cast(SPAN))
        return F.struct(end.alias("at"), (~state["match"]).alias("match")), taken.cast(SPAN)

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"))
    marked = F.split(F.regexp_replace(text, pattern, "\u0001$0\u0001"), "\u0001", -1)
    spans = _let(marked, lambda x: _scanned(x, begin, step, SPAN[6:-1]))
    none = F.array().cast(SPAN)
    likely = F.lit(kind not in LITERALS)
    for word in LITERALS.get(kind, ()):
        likely = likely | (lower if kind in ("assign", "keyid") else text).contains(word)
    return F.when(likely, spans).otherwise(none)


def parts(text: Column, lower: Column) -> Column:
    """All parts of every kind, ordered by start, then kind. lower: the text in lower case."""
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")
    every = (
        _found(text, lower, "assign", ASSIGN, lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 6),
        _found(text, lower, "access", ACCESS, lambda x: F.length(x) >= 20),
        _found(text, lower, "hex", HEX, lambda x: F.lit(True)),
        _found(text, lower, "keyid", KEYID, lambda x: F.lit(True)),
        _found(text, lower, "blob", BLOB, mixed),
        _found(text, lower, "endpoint", ENDPOINT, lambda x: F.lit(True)),
    )
    return F.array_sort(F.concat(*every))


def _role(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, r in ROLE.items() for x in (k, r)]), kind)


def _linkable(spans: Column) -> Column:
    """Whether a document has a weak candidate and more than one role at all."""
    return F.exists(spans, lambda s: s["kind"].isin(*WEAK)) & (F.size(F.array_distinct(F.transform(spans, lambda s: _role(s["kind"])))) > 1)


def _linked(keyed: DataFrame) -> DataFrame:
    """(id, hash, linked): the weak candidates with a complementary part in scope, for each text that has any."""
    part = keyed.where(_linkable(F.col("parts"))).select("id", "hash", F.explode("parts").alias("p")).select("id", "hash", "p.*").distinct()
    tile = lambda at: F.floor(at / SCOPE).cast("long")
    filed = part.withColumn("tile", F.explode(F.sequence(tile(F.col("start")), tile(F.col("end")))))
    tiles = filed.groupBy("id", "hash", "tile", _role(F.col("kind")).alias("role")).agg(F.min("start").alias("first"), F.max("end").alias("last"))
    near = F.explode(F.sequence(tile(F.col("start") - SCOPE), tile(F.col("end") + SCOPE)))
    needs = F.element_at(F.create_map(*[x for k, r in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, r)))]), F.col("kind"))
    probe = part.where(F.col("kind").isin(*WEAK)).select("id", "hash", "start", "rank", "end", "kind", near.alias("tile"), needs.alias("needs"))
    in_scope = (F.col("first") - F.col("end") <= SCOPE) & (F.col("start") - F.col("last") <= SCOPE) & F.array_contains("needs", F.col("role"))
    hit = probe.join(tiles, ["id", "hash", "tile"]).where(in_scope).select("id", "hash", "start", "rank", "end", "kind").distinct()
    return hit.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("linked"))


def _base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def _with_parts(docs: DataFrame) -> DataFrame:
    """The rows with ``id``, ``hash`` and ``parts``. The generator keeps filters on parts from computing them twice."""
    plain = F.coalesce("text", F.lit(""))
    clean = docs.withColumn("clean", F.when(plain.contains("\u0001"), F.translate(plain, "\u0001", "\u0002")).otherwise(plain)).withColumn("low", F.lower("clean"))
    return clean.select(*docs.columns, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("hash"), F.explode(F.array(parts(F.col("clean"), F.col("low")))).alias("parts"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (base and linked), ordered by start, then kind. Only parts of few documents are shuffled for links."""
    keyed = stored(_with_parts(id_and_text(docs, id_col, text_col)).select("doc_id", "id", "hash", "parts"))
    found = keyed.select("doc_id", "id", "hash", _base(F.col("parts")).alias("base")).join(_linked(keyed), ["id", "hash"], "left")
    return found.select("doc_id", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN)))).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """The text with each maximal covered stretch replaced by MASK."""

    def masked(chars: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            n = F.greatest(end - start, F.lit(0))
            return F.when(chars.isNull(), F.substring(text, start + 1, n)).otherwise(F.array_join(F.slice(chars, start + 1, n), ""))

        def step(at: Column, s: Column) -> tuple[Column, Column]:
            piece = F.when((s["start"] < at) & (at > 0), F.array().cast("array<string>")).otherwise(F.array(between(at, s["start"]), F.lit(MASK)))
            return F.greatest(at, s["end"]), piece

        last = F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        return F.concat(F.array_join(_scanned(spans, F.lit(0), step, "string"), ""), between(last, F.length(text)))

    return F.when(F.size(spans) > 0, _let(F.when(F.size(spans) > CUT, F.split(text, "")), masked)).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns, with every reported secret masked. Only documents with candidates are joined.

    The rows are stored with their parts, which are so found once.
    """
    columns = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    keyed = stored(_with_parts(inner).withColumn("linkable", _linkable(F.col("parts"))).drop("doc_id", "text"))
    plain = keyed.where("NOT linkable").select("row", _base(F.col("parts")).alias("spans"))
    joined = keyed.where("linkable").join(_linked(keyed.where("linkable")), ["id", "hash"], "left")
    joined = joined.select("row", F.array_sort(F.concat(_base(F.col("parts")), F.coalesce("linked", F.array().cast(SPAN)))).alias("spans"))
    both = plain.unionByName(joined)
    return both.select(*[_masked(F.col("row")[c].cast("string"), F.col("spans")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[kind_count(spans, k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_digest(spans, BASE), 256).alias("base_sha256"),
        span_digest(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["kind"].isin(*WEAK))).cast("long").alias("n_linked"),
    )


# The patterns for an engine without lookbehind: whole runs, whose length is asked for afterwards.
SQL_PATTERNS = {
    "assign": (ASSIGN, f"length(regexp_extract(part, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 6"),
    "access": (ACCESS, "length(part) >= 20"),
    "hex": ("[0-9a-f]+", "length(part) >= 24"),
    "keyid": (KEYID, "true"),
    "blob": ("[A-Za-z0-9+/]+={0,2}", "length(rtrim(part, '=')) >= 32 AND regexp_matches(part, '[0-9]') AND regexp_matches(part, '[a-z]') AND regexp_matches(part, '[A-Z]')"),
    "endpoint": (ENDPOINT, "true"),
}


_needs = " OR ".join(f"(w.kind = '{weak}' AND p.kind IN ({', '.join(repr(k) for k, r in ROLE.items() if r in roles)}))" for weak, roles in NEEDS.items())
OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
parts AS ({" UNION ALL ".join(sql_spans(rank, kind, *SQL_PATTERNS[kind]) for rank, kind in enumerate(KINDS))}),
linked AS (SELECT DISTINCT w.* FROM parts AS w JOIN parts AS p ON w.i = p.i AND p.start - w.stop <= {SCOPE} AND w.start - p.stop <= {SCOPE} AND ({_needs}) WHERE w.rank > 2),
spans AS (SELECT *, concat(kind, ':', start, ':', stop) AS s FROM (SELECT * FROM parts WHERE rank <= 2 UNION ALL SELECT * FROM linked) AS x),
n AS (SELECT i, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(s, ',' ORDER BY start, rank) FILTER (rank <= 2) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans, count(*) FILTER (rank > 2) AS n_linked FROM spans GROUP BY i)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN n ON d.i = n.i
"""
