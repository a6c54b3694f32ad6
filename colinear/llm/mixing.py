"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is its target share of all characters over its own share. Each document's number of copies inverts the
Poisson distribution of that mean at a uniform number hashed from the seed and its id, so any task gives the same answer
and a source of n documents gives n * rate copies on average. A rate above DRAW is the sum of the fewest equal ones that
are not, each inverted at a number of its own (independent Poisson numbers add up to one), so tables stay short and a
document's work grows with its copies. Copies are put in the order of a hash: a global shuffle.

Without given weights the targets are the sources' characters to the power TEMPERATURE. Sources of no characters have
rate 0 and give no copies; a null source is a source of its own; a null id hashes as the text ``null``; repeated rows
are replicated alike and tie in the order. Given weights of sources that do not occur are ignored, sources without a given
weight have 0. An empty table gives no copies. Texts are only measured, whatever their length; columns named ``copy`` or
``mix_key`` give way to those of the result, others pass through a struct, so their names cannot clash.

The table of rates has one row for each source. It is broadcast only up to BROADCAST_SOURCES of them, counted first;
beyond that it is joined, where adaptive execution splits a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SEED = "mix-1"
TEMPERATURE = 0.5
DRAW = 16.0  # the largest mean of one draw
BROADCAST_SOURCES = 10_000
NO_SOURCE = "\u0000"


def distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2 ..., to where the rest is below 1e-16, for a rate of DRAW at most."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(mix_source, rate) over all documents. Two sums over the sources reach the driver."""
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE))
    mass = docs.select(source.alias("mix_source"), F.length(f"`{text_col}`").alias("n")).groupBy("mix_source").agg(F.sum("n").cast("double").alias("chars")).where("chars > 0")
    if weights is None:
        weight = F.pow("chars", F.lit(TEMPERATURE))
    else:
        pairs = [F.lit(x) for k, w in weights.items() for x in (k, float(w))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("mix_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    mass = stored(mass.withColumn("weight", weight).where("weight > 0"))
    all_ = mass.agg(F.sum("weight").alias("weight"), F.sum("chars").alias("chars")).first()
    if all_.weight is None:
        return mass.select("mix_source", F.col("weight").alias("rate"))
    return mass.select("mix_source", (F.col("weight") / F.lit(all_.weight) * F.lit(all_.chars) / F.col("chars")).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of each document as often as drawn, with ``copy`` (from 1) and ``mix_key``, in the order of mix_key."""
    keep = docs.columns if keep is None else keep
    keep = [c for c in keep if c not in ("copy", "mix_key")]
    draws = F.ceil(F.col("rate") / DRAW).cast("int")
    cdf = stored(rates(docs, weights, source_col, text_col).where("rate > 0").select("mix_source", draws.alias("draws"), distribution(F.col("rate") / draws).alias("cdf")))
    if cdf.count() <= BROADCAST_SOURCES:
        cdf = F.broadcast(cdf)
    own = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), own.alias("own"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE)).alias("mix_source"))
    below = lambda *parts: F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), F.col("own"), *parts)))
    more = F.aggregate(F.sequence(F.lit(2), F.col("draws")), F.lit(0), lambda n, j: n + below(j.cast("string")))
    drawn = row.join(cdf, "mix_source").withColumn("n", below() + F.when(F.col("draws") > 1, more).otherwise(0)).where("n > 0")
    copies = drawn.select("row", "own", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = copies.select(*[F.col("row")[c].alias(c) for c in keep], F.col("copy").cast("long").alias("copy"), F.md5(F.concat_ws("-", F.lit(seed), F.lit("order"), F.col("own"), F.col("copy").cast("string"))).alias("mix_key"))
    return keyed.orderBy("mix_key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies by id: the columns that OP8_SQL compares."""
    return replicate(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op8_mixing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed training documents: every copy with all columns of its document, texts shuffled along."""
    return replicate(table(spark, sf_dir, "documents"))


def _sql(*columns: str) -> str:
    c = ", ".join(columns)
    return f"""
WITH RECURSIVE mass AS (
  SELECT coalesce(source, chr(0)) AS s, cast(sum(length(text)) AS double) AS chars FROM documents GROUP BY 1 HAVING sum(length(text)) > 0),
rate AS (SELECT s, pow(chars, {TEMPERATURE}) / sum(pow(chars, {TEMPERATURE})) OVER () * sum(chars) OVER () / chars AS whole FROM mass),
drawn AS (SELECT s, cast(ceil(whole / {DRAW}) AS bigint) AS draws, whole / ceil(whole / {DRAW}) AS r FROM rate),
cdf AS (
  SELECT s, r, draws, 0 AS k, -r AS log_p, exp(-r) AS p FROM drawn
  UNION ALL
  SELECT s, r, draws, k + 1, log_p + ln(r) - ln(cast(k + 1 AS double)), p + exp(log_p + ln(r) - ln(cast(k + 1 AS double))) FROM cdf WHERE k + 1 <= ceil(r + 12 * sqrt(r) + 20)),
listed AS (SELECT s, draws, list(p) AS ps FROM cdf GROUP BY s, draws),
one AS (
  SELECT row_number() OVER () AS i, documents.*, coalesce(cast(doc_id AS varchar), 'null') AS own, draws, ps
  FROM documents JOIN listed ON s = coalesce(source, chr(0))),
each AS (SELECT i, own, ps, unnest(range(1, draws + 1)) AS j FROM one),
uniform AS (
  SELECT *, cast(cast('0x' || substr(md5('{SEED}-' || own || CASE WHEN j = 1 THEN '' ELSE '-' || j END), 1, 13) AS bigint) AS double) / 4503599627370496.0 AS u FROM each),
counted AS (SELECT i, cast(sum(len(list_filter(ps, lambda p: p <= u))) AS bigint) AS n FROM uniform GROUP BY i),
copies AS (SELECT one.*, unnest(range(1, n + 1)) AS copy FROM one JOIN counted ON one.i = counted.i)
SELECT {c}, cast(copy AS bigint) AS copy, md5('{SEED}-order-' || own || '-' || copy) AS mix_key FROM copies
"""


OP8_SQL = _sql("doc_id", "source")
OP8_ROWS_SQL = _sql("doc_id", "text", "lang", "source", "n_chars")
