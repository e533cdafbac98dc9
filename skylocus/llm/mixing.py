"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

Every source has a mean repetition rate, target weight x total size / own size. A document's number
of copies is the inverse of the Poisson distribution function at a uniform number taken from a hash
of its id and a seed, so that a rerun, or a rerun of one lost task, gives the same copies. A mean
above ``STEP`` is split into equal parts with a number each; the sum of independent Poisson counts is
Poisson, and no distribution function underflows. Copies are then dealt over the cluster and ordered
by a hash of id and copy number.

Cases: a null source is a source of its own; a null text has size 0; a source whose texts are all
empty, or that has no target weight, has rate 0. Repeated rows of one id get the same count, each for
itself. Only the size of a text counts, however long. An id that is null hashes as the empty string. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Largest mean that is inverted at once.
STEP = 16.0
#: Values of the distribution function that are kept: beyond 80 the tail at mean 16 is under 2**-53.
TERMS = 80
#: A rates table of at most so many sources, some 1 KB each, is broadcast; a larger one is joined by salted keys.
BROADCAST_SOURCES = 2000
#: Parts into which each source is dealt in the salted join.
SALTS = 256
#: Copies of one document that one task makes at least before they are dealt out by runs of as many.
BURST = 1024
#: Hex digits of the hash that make a uniform number, 4 bits each.
DIGITS = 13


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the hash of the parts."""
    digest = F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def rates(docs: DataFrame, weights: Mapping[str, float] | None, source_col: str, text_col: str) -> DataFrame:
    """source, rate, parts, cdf. ``weights`` of None: every source weighs the same."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).alias("size"))
    sizes = cut(sizes, "mix-sizes")
    total = sizes.agg(F.sum("size").alias("total"), F.count(F.when(F.col("size") > 0, 1)).alias("sources"))
    if weights is None:
        weight = F.lit(1.0) / F.col("sources")
    else:
        whole = float(sum(weights.values()))
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v / whole))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("source", F.lit(""))), F.lit(0.0))
    # total is one row, known as such from the aggregate
    rate = F.when(F.col("size") > 0, weight * F.col("total") / F.col("size")).otherwise(F.lit(0.0))
    found = sizes.join(F.broadcast(total)).select("source", rate.alias("rate"))
    found = found.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))

    return found.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["cdf"]))


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with columns mix_rate, mix_copies, mix_copy (from 0) and mix_key, a row per copy, in shuffled order.

    Columns of these names that ``docs`` has are replaced; all others stay, whatever their names.
    """
    docs = docs.drop(*({"mix_rate", "mix_copies", "mix_copy", "mix_key"} - {id_col, source_col, text_col}))
    source, parts, cdf, salt, piece = (fresh(docs, f"mix_{x}") for x in ("source", "parts", "cdf", "salt", "piece"))
    found = cut(rates(docs, weights, source_col, text_col), "mix-rates").toDF(source, "mix_rate", parts, cdf)
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    if found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(found), F.col(source_col).eqNullSafe(F.col(source)), "inner")
    else:
        salted = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = fresh(docs, "mix_mine")
        joined = docs.withColumn(mine, F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int"))
        joined = joined.join(salted, F.col(source_col).eqNullSafe(F.col(source)) & (F.col(mine) == F.col(salt)), "inner").drop(mine, salt)
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: uniform(seed, own, j.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(cdf, lambda c: c <= u)))
    counted = joined.withColumn("mix_copies", count).where("mix_copies > 0").drop(source, parts, cdf)

    def exploded(some: DataFrame, first: Column, copies: Column) -> DataFrame:
        return some.withColumn("mix_copy", F.explode(F.sequence(first, first + copies - 1)))

    if found.where(F.col("mix_rate") > BURST).isEmpty():
        copies = exploded(counted, F.lit(0), F.col("mix_copies"))
    else:  # a document of very many copies is dealt out by runs of them, before they are made
        few = exploded(counted.where(F.col("mix_rate") <= BURST), F.lit(0), F.col("mix_copies"))
        many = counted.where(F.col("mix_rate") > BURST).withColumn(piece, F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1, F.lit(BURST))))
        many = exploded(many.repartition(piece, F.xxhash64(own)), F.col(piece), F.least(F.lit(BURST), F.col("mix_copies") - F.col(piece)))
        copies = few.unionByName(many.drop(piece))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), own, F.col("mix_copy").cast("string"))))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def _sql(seed: str = "mix-1") -> str:
    u = f"('0x' || substr(md5('{seed}:' || id || ':' || j), 1, {DIGITS}))::BIGINT::DOUBLE / {16**DIGITS}::DOUBLE"
    return f"""
WITH d AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS id FROM documents),
s AS (SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS size FROM d GROUP BY source),
t AS (SELECT sum(size) AS total, count(*) FILTER (WHERE size > 0) AS sources FROM s),
r AS (SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE / sources * total / size ELSE 0.0::DOUBLE END AS rate FROM s, t),
q AS (SELECT *, greatest(1, ceil(rate / {STEP}))::INTEGER AS parts FROM r),
f AS (SELECT source, rate, parts, k, exp(-rate / parts) * product(CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE rate / parts / k END) OVER (PARTITION BY source ORDER BY k) AS p
      FROM q, range(0, {TERMS + 1}) AS g(k)),
c AS (SELECT source, rate, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM f),
u AS (SELECT id, d.source, rate, {u} AS x FROM (SELECT DISTINCT id, source FROM d) d, q, range(1, q.parts + 1) AS g(j) WHERE d.source IS NOT DISTINCT FROM q.source),
n AS (SELECT u.id, u.source, any_value(u.rate) AS rate, count(c.k) AS copies FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.x GROUP BY u.id, u.source)
SELECT doc_id, sha256(text) AS text_sha256, d.source, round(rate, 9) AS mix_rate, copies::INTEGER AS mix_copies, m.k::INTEGER AS mix_copy, md5('{seed}:order:' || d.id || ':' || m.k) AS mix_key
FROM d JOIN n ON d.id = n.id AND d.source IS NOT DISTINCT FROM n.source, range(0, n.copies) AS m(k)
"""


ORACLE_SQL = _sql()
