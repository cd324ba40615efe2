"""Operator 9: mixing sources to target weights by Poisson replication.

A source's rate is its target share of all characters over its actual share, so the mix is as large as the input on average. Each document's
number of copies is Poisson with that rate: the first 52 bits of md5(seed:doc_id) give a uniform number, and the distribution is inverted
(the copies are as many as cumulative probabilities that don't exceed it). Documents are exploded by their counts, and dealt and sorted by
md5(seed:mix:doc_id:copy), a random global order that is the same on every run.

Shares count a text's characters plus one. Without explicit weights a source's target is its size to the power of `exponent` (0.5 flattens,
1 keeps). Given weights are relative; sources that aren't named get none. Null sources are the source ''. Null texts count as empty. Rows
of equal doc_id are copied alike, null ids as the id ''. An empty table gives an empty result. Other columns are kept; copy, repeats, rate and mix_key are
added, and replaced where they clash. A small source gets as many copies as its target asks for, unless a caller
holds rates at `most`. Cumulative tables begin 12 standard deviations below large rates (FAR_RATE), where
less than 1e-20 of the copies' distribution is left out, and more than COPIES_IN_A_TASK copies of one document are dealt over tasks.

Rates are joined by broadcast while the cumulative tables have at most BROADCAST_ROWS numbers; beyond, by a join on source and a salt, so
that a hot source is dealt over SALTS tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BROADCAST_ROWS, SALTS = 1_000_000, 64
FAR_RATE, COPIES_IN_A_TASK = 400.0, 10_000
SEED = "tidemark"
ADDED = ("copy", "repeats", "rate", "mix_key")


def _uniform(key: Column) -> Column:
    """0 to 1 from 52 bits of md5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, source: str = "source", text: str = "text", most: float | None = None) -> DataFrame:
    """source, rate: the mean number of copies of each source's documents."""
    sized = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).agg(F.sum(F.length(F.coalesce(text, F.lit(""))) + 1).alias("chars"))
    if weights is None:
        target = F.pow(F.col("chars").cast("double"), F.lit(exponent))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights can't be negative")
        named = [F.when(F.col("source") == k, F.lit(float(w))) for k, w in weights.items()]
        target = F.coalesce(*named, F.lit(0.0))
    sized = written(sized.withColumn("target", target), "sources")
    total = sized.agg(F.sum("chars").cast("double"), F.sum("target")).first()
    if not total[1]:
        return sized.select("source", F.lit(0.0).alias("rate"))
    rate = F.col("target") / F.lit(total[1]) * F.lit(total[0]) / F.col("chars")
    return sized.select("source", (rate if most is None else F.least(rate, F.lit(most))).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, seed: str = SEED, source: str = "source", text: str = "text", most: float | None = None) -> DataFrame:
    """docs replicated to the weights in a random global order, with copy (from 1), repeats, rate and mix_key."""
    docs = docs.drop(*ADDED)
    found = rates(docs, weights, exponent, source, text, most)
    r = F.col("rate")
    first = F.when(r >= FAR_RATE, F.floor(r - 12 * F.sqrt(r) - 20)).otherwise(0).cast("int")
    last = F.ceil(r + 12 * F.sqrt(r) + 20).cast("int")
    numbers = found.agg(F.sum(last - first)).first()[0] or 0
    # Cumulative probabilities, each term from the one before; the first by Stirling's series, since exp(-rate) is 0 for large rates.
    step = lambda acc, j: F.struct(
        (acc["p"] * r / j).alias("p"), (acc["c"] + acc["p"] * r / j).alias("c"), F.concat(acc["all"], F.array(acc["c"] + acc["p"] * r / j)).alias("all")
    )
    k = F.col("_first").cast("double")
    factorial = k * F.log(k) - k + F.log(2 * math.pi * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k)
    p = F.when(F.col("_first") > 0, F.exp(k * F.log(r) - r - factorial)).otherwise(F.exp(-r))
    start = F.struct(p.alias("p"), p.alias("c"), F.array(p).alias("all"))
    upto = F.aggregate(F.sequence(F.col("_first") + 1, last), start, step, lambda acc: acc["all"])
    tables = found.withColumn("_first", first).select(F.col("source").alias("_source"), "rate", "_first", upto.alias("_upto"))
    own = docs.withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    if numbers <= BROADCAST_ROWS:
        joined = own.join(F.broadcast(tables), "_source")
    else:
        salted = tables.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int")).join(salted, ["_source", "_salt"]).drop("_salt")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    u = _uniform(F.concat(F.lit(f"{seed}:"), ident))
    counted = joined.withColumn("repeats", (F.col("_first") + F.size(F.filter("_upto", lambda c: c <= u))).cast("long")).drop("_first", "_upto", "_source").where("repeats > 0")
    from_, to = F.lit(1).cast("long"), F.col("repeats")
    if (found.agg(F.max(last)).first()[0] or 0) > COPIES_IN_A_TASK:
        counted = counted.withColumn("_from", F.explode(F.sequence(from_, to, F.lit(COPIES_IN_A_TASK).cast("long")))).repartition("doc_id", "_from")
        from_, to = F.col("_from"), F.least(F.col("repeats"), F.col("_from") + COPIES_IN_A_TASK - 1)
    copies = counted.withColumn("copy", F.explode(F.sequence(from_, to))).drop("_from")
    keyed = copies.withColumn("mix_key", F.md5(F.concat(F.lit(f"{seed}:mix:"), ident, F.lit(":"), F.col("copy").cast("string"))))
    return keyed.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copy, repeats, rate, mix_key, and the md5 of the text that was carried along, of every copy."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "repeats", F.round("rate", 9).alias("rate"), "mix_key", F.md5("text").alias("text_md5"))


OP9_SQL = """
WITH sized AS (
  SELECT coalesce(source, '') AS src, sum(length(coalesce(text, '')) + 1)::DOUBLE AS chars FROM documents GROUP BY 1),
rated AS (
  SELECT src, pow(chars, 0.5) / (SELECT sum(pow(chars, 0.5)) FROM sized) * (SELECT sum(chars) FROM sized) / chars AS rate FROM sized),
terms AS (
  SELECT src, rate, j, exp(-rate + j * ln(rate) - lgamma(j + 1)) AS p
  FROM rated, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT))) AS t(j)),
upto AS (
  SELECT src, rate, sum(p) OVER (PARTITION BY src ORDER BY j ROWS UNBOUNDED PRECEDING) AS c FROM terms),
tables AS (SELECT src, rate, list(c) AS cs FROM upto GROUP BY src, rate),
counted AS (
  SELECT d.doc_id, d.source, d.text, t.rate,
    len(list_filter(t.cs, lambda c: c <= CAST('0x' || substr(md5('tidemark:' || d.doc_id), 1, 13) AS BIGINT) / 4503599627370496.0)) AS repeats
  FROM documents d JOIN tables t ON coalesce(d.source, '') = t.src)
SELECT doc_id, source, copy, repeats, round(rate, 9) AS rate, md5('tidemark:mix:' || doc_id || ':' || copy) AS mix_key, md5(text) AS text_md5
FROM counted, unnest(generate_series(1, repeats)) AS c(copy)
"""
