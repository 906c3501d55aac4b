"""Records of several sources mixed to target shares of the tokens (problem 7).

Systematic sampling. All documents of a source have the same expected copies: the share of the mixture's size over
the source's size. The size is the largest at which no source needs more than its permitted repeats. Along each
source, in order of length, expected copies are summed up from one random offset, and a document comes out once
for every whole number that its step crosses. As lengths are in order, the tokens follow the shares closely; of ``OFFSETS``
random offsets each source takes the one that comes nearest to its tokens.

The prefix sum is a rank times a constant, and ranks come from counts of parts (see ``ranks``), so a source that holds
most of the rows is no bottleneck. Sources without tokens come out with nothing and are reported; the others keep
their proportions. A size may be asked for; beyond what the caps on repeats allow it isn't reached, and :func:`shares`
tells by which source. Documents without tokens, null and unlisted sources are in no mixture. A null ``max_repeats`` means 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.ranks import ranked
from paperloom.session import durable

SEED, OFFSETS = 20, 32


def rates(counts: DataFrame, targets: DataFrame, source: str = "source", size: float | None = None) -> DataFrame:
    """``targets`` with source_tokens, mix_tokens and ``rate``, the expected copies of each of the source's documents.

    mix_tokens is the largest size at which no source is used more than permitted, or ``size`` where that is less.
    """
    wanted = targets.groupBy("mix_id", source).agg(F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    sizes = counts.groupBy(source).agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    joined = wanted.join(sizes, source, "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    here = (F.col("source_tokens") > 0) & (F.col("target_share") > 0)
    most = F.when(here, F.col("max_repeats") * F.col("source_tokens") / F.col("target_share"))
    least = joined.groupBy("mix_id").agg(F.min(most).alias("mix_tokens"), F.min_by(source, most).alias("limited_by"), F.sum(F.when(here, F.col("target_share"))).alias("_reached"))
    if size is not None:  # of the sources that are there
        asked = F.lit(float(size)) / F.col("_reached")
        least = least.withColumn("limited_by", F.when(F.col("mix_tokens") < asked, F.col("limited_by"))).withColumn("mix_tokens", F.least("mix_tokens", asked))
    rate = F.when(here, F.least(F.col("target_share") * F.col("mix_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return joined.join(least.drop("_reached"), "mix_id").withColumn("rate", rate)


def _offset(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _copies(offset: Column | str) -> Column:
    """Whole numbers that the step of a row's rank crosses."""
    u = F.col(offset) if isinstance(offset, str) else offset
    crossed = F.floor(u + (F.col("rank") + 1) * F.col("rate")) - F.floor(u + F.col("rank") * F.col("rate"))
    return F.least(crossed, F.col("max_repeats").cast("bigint"))


def mixed(counts: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: float | None = None) -> DataFrame:
    """(mix_id, source, key, copy, n_tokens): the records of each mixture, ``copy`` counted from 1.

    Other columns of ``counts`` are left out, whatever their names.
    """
    counts = counts.select(key, source, "n_tokens").where(F.col(source).isNotNull() & (F.col("n_tokens") > 0))
    bucket = F.floor(F.log2(F.col("n_tokens") + 1) * 8)
    placed = durable(ranked(counts.withColumn("_bucket", bucket), [source], ["_bucket"], ["n_tokens", key]))
    asked = durable(rates(counts, targets, source, size).where("rate > 0"))  # as many rows as targets
    asked = asked.select("mix_id", source, "rate", "max_repeats", (F.col("rate") * F.col("source_tokens")).alias("wanted"))
    # every offset's tokens in one pass; each task's sums are merged, no row is shuffled
    tried = placed.join(F.broadcast(asked), source)
    offsets = [_offset("mix_id", source, F.lit(i)) for i in range(OFFSETS)]
    sums = tried.groupBy("mix_id", source, "wanted").agg(*[F.sum(_copies(u) * F.col("n_tokens")).alias(f"_{i}") for i, u in enumerate(offsets)])
    ways = F.array(*[F.struct(F.abs(F.col(f"_{i}") - F.col("wanted")).alias("off"), u.alias("offset")) for i, u in enumerate(offsets)])
    chosen = durable(sums.select("mix_id", source, F.array_min(ways)["offset"].alias("offset")))
    out = placed.join(F.broadcast(asked.join(chosen, ["mix_id", source])), source).withColumn("_copies", _copies("offset")).where("_copies > 0")
    return out.select("mix_id", source, key, F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")).alias("copy"), "n_tokens")


def shares(result: DataFrame, targets: DataFrame, counts: DataFrame | None = None, source: str = "source", size: float | None = None) -> DataFrame:
    """For each target: the share of the mixture's tokens that was reached, and what it was made of.

    With the ``counts`` that were mixed: ``unused_tokens`` of the source's stay out of the mixture; ``limited_by`` names the
    source whose cap sets the mixture's size.
    """
    got = result.groupBy("mix_id", source).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("copy").alias("most_repeats"), F.sum(F.when(F.col("copy") == 1, F.col("n_tokens"))).alias("_once"))
    totals = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    joined = targets.join(got, ["mix_id", source], "left").join(totals, "mix_id", "left")
    share = F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0))
    columns = ["mix_id", source, "target_share", share.alias("actual_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "records", "most_repeats")], "max_repeats"]
    if counts is None:
        return joined.select(*columns)
    kept = counts.where(F.col(source).isNotNull() & (F.col("n_tokens") > 0))
    sizes = rates(kept, targets, source, size).select("mix_id", source, "source_tokens", "limited_by")
    return joined.join(sizes, ["mix_id", source], "left").select(*columns, (F.col("source_tokens") - F.coalesce("_once", F.lit(0))).alias("unused_tokens"), "limited_by")
