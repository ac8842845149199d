"""Mixing sources by temperature, realised as budgeted permutations of blocks.

Method. The share ``p`` of a source is its part of all tokens (words separated by white space). The weights are
``p^a`` divided by their sum; ``a = 1`` keeps the shares, ``a = 0`` makes all sources equal. The exponent is the
smallest in [0, 1] that keeps the number of passes over any source within ``max_repeats`` and, if given, the entropy of
the weights (in nats) at or below ``target_entropy``. Both grow as ``a`` falls, so it is found by repeated division of
the interval, each round an aggregate over the table of sources, and never leaves the allowed side.

Budget. Source ``s`` gets ``weight * budget`` tokens. Without a budget it is the smallest with which every source is
passed over at least once, so that no document is lost and smaller sources are repeated. A quota is spent in whole
passes and one partial pass. The rows of a source are dealt into blocks by a hash of their id; in each pass the blocks
are permuted by a hash of block and pass, and the partial pass ends inside one block, whose rows are taken in hash order
as long as they fit. Sums run over the table of blocks and, for the block cut, over its distinct keys; a source is never
ordered as a whole, however many rows it has.

All steps are DataFrame operations. The tables of sources and of blocks are broadcast only after their size has been
checked. Defined cases: a null or empty text has no tokens; a source without tokens has no weight and is passed over
once; a null source is a source of its own; rows of equal id in a source are taken or left together; an empty table gives
an empty table; result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowscope.llm.scale import checked_broadcast
from flowscope.operators.scale import cut_lineage

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
ROUNDS, SECTIONS = 6, 16
SEED = 7


def token_count(text_col: str) -> Column:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def hashed(*parts: Column | str) -> Column:
    """First 16 digits of the MD5 of the parts, joined by colons; nulls are empty."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def exponent(totals: DataFrame, max_repeats: float, target_entropy: float | None = None, budget: int | None = None) -> float:
    """The smallest exponent within the limits; 1.0 if even the plain shares break them."""
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return 1.0
    shares = cut_lineage(totals.filter("tokens > 0").select((F.col("tokens") / F.lit(total)).alias("p")), "shares")
    low, high = 0.0, 1.0
    grid = F.array(*[F.lit(i / SECTIONS) for i in range(SECTIONS + 1)])
    for _ in range(ROUNDS):
        a = F.lit(low) + F.col("g") * F.lit(high - low)
        power = F.pow("p", a)
        sums = shares.withColumn("g", F.explode(grid)).groupBy("g").agg(
            F.sum(power).alias("z"), F.sum(power * F.ln("p")).alias("zl"), F.min("p").alias("least"), F.max("p").alias("most"))
        most = F.pow("least", a - 1.0)
        passes = most / F.pow("most", a - 1.0) if budget is None else most / F.col("z") * F.lit(float(budget) / total)
        within = passes <= max_repeats
        if target_entropy is not None:
            within = within & (F.ln("z") - a * F.col("zl") / F.col("z") <= target_entropy)
        best = sums.filter(within).agg(F.min("g")).first()[0]
        if best is None:
            return 1.0
        low, high = (low + max(0.0, best - 1.0 / SECTIONS) * (high - low)), low + best * (high - low)
        if best == 0.0:
            return high
    return high


def quotas(totals: DataFrame, a: float, budget: int | None = None) -> DataFrame:
    """``totals`` with ``weight``, ``quota`` in tokens, whole ``passes`` and the ``rest`` of the quota."""
    total, most = totals.agg(F.sum("tokens"), F.max("tokens")).first()
    total, most = total or 1, most or 1
    with_p = totals.withColumn("p", F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(total)))
    power = F.coalesce(F.pow("p", F.lit(a)), F.lit(0.0))
    weighed = with_p.withColumn("weight", power / F.lit(with_p.agg(F.sum(power)).first()[0] or 1.0))
    if budget is None:
        quota = F.floor(F.col("tokens") * F.pow(F.col("tokens") / F.lit(most), F.lit(a) - 1.0))
    else:
        quota = F.floor(F.col("weight") * budget)
    quota = F.coalesce(quota, F.lit(0)).cast("bigint")
    passes = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1)
    return weighed.withColumn("quota", quota).withColumn("passes", passes.cast("bigint")).withColumn(
        "rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(0)).drop("p")


class Mix:
    """The plan of a mix: ``sources`` with their weights and ``blocks`` with the passes they take part in."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                 max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, budget: int | None = None,
                 block_tokens: int = BLOCK_TOKENS, seed: int = SEED):
        self.id_col, self.source_col, self.seed = f"`{id_col}`", f"`{source_col}`", seed
        thin = cut_lineage(docs.select(
            F.struct(F.col(self.source_col).alias("s")).alias("source"), hashed(F.col(self.id_col), F.lit(seed)).alias("h"), token_count(text_col).alias("tokens")), "tokens")
        totals = cut_lineage(thin.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "sources")
        self.n_sources = totals.count()
        self.exponent = exponent(totals, max_repeats, target_entropy, budget)
        n_blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("bigint")
        self.sources = cut_lineage(quotas(totals, self.exponent, budget).withColumn("n_blocks", n_blocks), "quotas")
        sizes = checked_broadcast(self.sources.select("source", "n_blocks", "passes", "rest"), self.n_sources)
        placed = thin.join(sizes, "source").withColumn("block", self._block(F.col("h")))
        blocks = placed.groupBy("source", "block", "passes", "rest").agg(F.sum("tokens").alias("tokens"))
        turns = blocks.withColumn("pass", F.explode(F.expr("sequence(0L, passes)"))).withColumn(
            "order", hashed(F.col("source.s"), F.col("block"), F.col("pass"), F.lit(seed)))
        before = Window.partitionBy("source", "pass").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
        turns = cut_lineage(turns.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "turns")
        last = F.col("pass") == F.col("passes")
        whole = ~last | (F.col("start") + F.col("tokens") <= F.col("rest")) & (F.col("rest") > 0)
        cut = last & (F.col("start") < F.col("rest")) & (F.col("start") + F.col("tokens") > F.col("rest"))
        cuts = turns.filter(cut).select("source", "block", "pass", (F.col("rest") - F.col("start")).alias("room"))
        keys = placed.select("source", "block", "h", F.col("tokens").alias("t")).join(checked_broadcast(cuts, self.n_sources), ["source", "block"])
        keys = keys.withColumn("turn", self._turn(F.col("h"), F.col("pass"))).groupBy("source", "block", "pass", "room", "turn").agg(F.sum("t").alias("t"))
        used = F.sum("t").over(Window.partitionBy("source").orderBy("turn"))
        ends = keys.withColumn("used", used).filter("used <= room").groupBy("source", "block", "pass").agg(F.max("turn").alias("until"))
        taken = turns.filter(whole).select("source", "block", "pass", "start", F.lit("~").alias("until")).unionByName(
            turns.join(ends, ["source", "block", "pass"]).select("source", "block", "pass", "start", "until"))
        self.blocks = cut_lineage(taken, "blocks")
        self.n_blocks = self.blocks.count()

    @staticmethod
    def _block(h: Column) -> Column:
        return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.col("n_blocks"))

    @staticmethod
    def _turn(h: Column, pass_: Column) -> Column:
        return hashed(h, pass_)

    def realise(self, docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
        """The rows of the mix, each as often as its passes, with ``pass``, ``block`` and ``progress``.

        ``progress`` in [0, 1) is the share of the source's quota that stands before the block; ordered by it, every
        stretch of the mix has the sources in the ratio of their weights.
        """
        results = ("pass", "block", "progress")
        carried = [c for c in (docs.columns if carry is None else carry) if c not in results]
        sizes = checked_broadcast(self.sources.select(F.col("source").alias("__s"), "n_blocks", "quota", F.col("tokens").alias("__all")), self.n_sources)
        rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.struct(F.col(self.source_col).alias("s")).alias("__s"),
                           hashed(F.col(self.id_col), F.lit(self.seed)).alias("__h")).join(sizes, "__s").withColumn("__b", self._block(F.col("__h")))
        turns = self.blocks.select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.col("pass").alias("__p"), "start", "until")
        met = rows.join(checked_broadcast(turns, self.n_blocks), ["__s", "__b"])
        met = met.filter((F.col("until") == "~") | (self._turn(F.col("__h"), F.col("__p")) <= F.col("until")))
        progress = (F.col("__p") * F.col("__all") + F.col("start")) / F.greatest(F.col("quota"), F.lit(1))
        return met.select(*[F.col(f"`{c}`") for c in carried], F.col("__p").alias("pass"), F.col("__b").alias("block"), progress.alias("progress"))
