"""Mixing sources to target weights with DataFrame functions only.

Token shares of the sources are raised to an exponent and normalised. The exponent is bisected: it is the largest in
[0, 1] at which the weights reach a target entropy and no source has to be repeated more than a limit. Weights times the
token budget give each source its tokens: whole epochs of the source, and a part of one more. Every source is cut into
blocks by a hash; an epoch takes the blocks in an order of its own, and the last epoch stops within one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import aliased, written

STEPS = 40  # halvings of the exponent's range


def token_shares(docs: DataFrame) -> DataFrame:
    """docs with n_tokens: blank-separated words of the whole text, 0 if null."""
    return docs.withColumn("n_tokens", F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long"))


def _weight(array, exponent):
    """Normalised powers of the shares in an array of structs."""
    powers = F.transform(array, lambda s: F.pow(s["share"], exponent))
    return powers, F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)


def weights(sources: DataFrame, budget, entropy: float, repeats: float) -> DataFrame:
    """(source, tokens, weight) from (source, tokens): one row a source.

    entropy: the least entropy of the weights as a part of the logarithm of the number of sources. repeats: the most
    epochs of a source. A smaller exponent raises the entropy but repeats small sources more, so the exponent is the
    largest that meets the entropy and, if that one repeats a source too often, the smallest that does not.
    Sources without tokens get weight 0. The sources are a short list (their names), folded in one row for the bisection.
    """
    total = sources.where("tokens > 0").agg(
        F.sum("tokens").alias("all_tokens"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("source", F.col("tokens").cast("double").alias("share")))).alias("given"))
    total = total.withColumn("given", F.transform("given", lambda s: F.struct(s["source"].alias("source"), (s["share"] / F.col("all_tokens")).alias("share"))))

    def enough_entropy(exponent):
        powers, norm = _weight(F.col("given"), exponent)
        spread = F.aggregate(powers, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / norm * F.log(x / norm)).otherwise(0.0))
        return spread >= F.lit(entropy) * F.log(F.col("n"))

    def few_repeats(exponent):
        _, norm = _weight(F.col("given"), exponent)
        most = F.aggregate(F.col("given"), F.lit(0.0), lambda a, s: F.greatest(a, F.pow(s["share"], exponent) / norm / s["share"]))
        return most * budget(F.col("all_tokens")) <= F.lit(repeats) * F.col("all_tokens") * F.lit(1 + 1e-9)

    def bisected(holds, low_holds):
        """The edge of a condition that holds at 0 and up to it (or else from it up to 1), from the side where it holds."""
        start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

        def halve(s, _):
            middle = (s["low"] + s["high"]) / 2
            up = holds(middle) if low_holds else ~holds(middle)
            return F.struct(F.when(up, middle).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(middle).alias("high"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)
        return F.when(holds(F.lit(1.0)), 1.0).otherwise(found["low"]) if low_holds else found["high"]

    total = total.withColumn("by_entropy", bisected(enough_entropy, True))
    total = total.withColumn("exponent", F.when(few_repeats(F.col("by_entropy")), F.col("by_entropy")).otherwise(
        F.greatest(F.col("by_entropy"), bisected(few_repeats, False))))
    powers, norm = _weight(F.col("given"), F.col("exponent"))
    out = total.select("exponent", F.explode(F.arrays_zip(F.col("given.source").alias("source"), F.transform(powers, lambda p: p / norm).alias("weight"))).alias("w"))
    out = out.select("exponent", F.col("w.source").alias("source"), F.col("w.weight").alias("weight"))
    return (sources.join(out, sources["source"].eqNullSafe(out["source"]), "left")
            .select(sources["source"], "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight")))


def _hash(*parts):
    """A number of 60 bits from the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 15), 16, 10).cast("long")


def plan(sized: DataFrame, share: float, entropy: float, repeats: float) -> tuple[DataFrame, DataFrame]:
    """What to take of every source and block, from rows (doc_id, source, n_tokens).

    The first table has (source, epochs, part, n_blocks): whole epochs and the tokens of one more. The second has (source,
    block, epoch, place, before): the place of a block in an epoch's permutation, and the tokens before it in the last,
    partial epoch. A source has about as many blocks as the root of its rows, so neither its blocks nor the documents of
    one block become a long list.
    """
    sources = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    weighed = weights(sources.select("source", "tokens"), lambda all_tokens: F.floor(all_tokens * F.lit(share)).cast("double"), entropy, repeats)
    budget = sources.agg(F.floor(F.sum("tokens") * F.lit(share)).alias("budget"))
    target = (weighed.join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s").crossJoin(F.broadcast(budget))
              .withColumn("target", F.floor(F.col("weight") * F.col("budget"))))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("tokens"), F.lit(0))), F.lit(0))
    per_source = target.select(
        "source", epochs.alias("epochs"), F.coalesce(F.col("target") - epochs * F.col("tokens"), F.lit(0)).alias("part"),
        F.ceil(F.sqrt("n")).cast("long").alias("n_blocks"))
    per_source = written(per_source, "sources")
    blocks = (_blocked(sized, per_source).groupBy("source", "block", "epochs", "part").agg(F.sum("n_tokens").alias("tokens"))
              .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs")))))
    order = Window.partitionBy("source", "epoch").orderBy(_hash(F.col("block"), F.col("epoch")), "block")
    placed = blocks.withColumn("place", F.row_number().over(order)).withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    # written, so that their sizes are known: small ones are broadcast and texts need no shuffle
    placed = placed.where("epoch < epochs OR before < part").select("source", "block", "epoch", "place", "before", "tokens")
    return per_source, written(placed, "placed")


def _blocked(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    other = per_source.withColumnRenamed("source", "_source")
    return (sized.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("block", F.pmod(_hash(F.col("doc_id")), F.col("n_blocks"))))


def mixed(docs: DataFrame, share: float = 1.0, entropy: float = 0.95, repeats: float = 4.0) -> DataFrame:
    """The rows of docs once for every epoch that takes them, with n_tokens, epoch, block and place (of the block) appended.

    The budget is `share` of all tokens. Whole epochs take every document of a source. The last epoch takes whole blocks
    in its order while they fit, and of the first block that does not fit the documents, by hash and then doc_id, whose running
    sum of tokens fits. A null source is a source of its own; documents without tokens come with every whole epoch of
    their source, and sources without tokens are left out. Columns named like an output are replaced, all others stay. Empty
    tables give no rows.
    """
    docs, names = aliased(docs.drop("n_tokens", "epoch", "block", "place"), "doc_id", "source", "text")
    sized = token_shares(docs)
    per_source, placed = plan(sized.select("doc_id", "source", "n_tokens"), share, entropy, repeats)
    blocked = _blocked(sized, per_source)
    other = placed.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "epoch", "place", "before", "tokens")
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    taken = blocked.join(other, on).drop("_source", "_block")
    whole = taken.where("epoch < epochs OR before + tokens <= part")
    torn = taken.where("epoch = epochs AND before + tokens > part")
    running = F.sum("n_tokens").over(
        Window.partitionBy("source", "block").orderBy(_hash(F.col("doc_id"), F.col("epoch")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    torn = torn.withColumn("running", running).where("before + running <= part").drop("running")
    return whole.unionByName(torn).select(*docs.columns, "n_tokens", "epoch", "block", "place").withColumnsRenamed(names)
