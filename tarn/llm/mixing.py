"""Mixing sources to target weights.

Token shares are raised to an exponent and normalised. The exponent is bisected until the weights
have the wanted entropy, or until no source is repeated more often than allowed. The weights are then
realised as whole passes over each source plus one budgeted pass: documents fall into blocks by hash,
each pass permutes the blocks, and the budgeted pass takes blocks in that order until its tokens are
spent, cutting the last block by document.

Only a table of (source, block) totals is ever sorted; documents are never moved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.store import save

#: Above this many rows the plan is joined by a shuffle, below by broadcast (some 40 bytes a row).
BROADCAST_ROWS = 200_000
#: Midpoints of so many bisection levels are evaluated by one job.
LEVELS = 4


@dataclass(frozen=True)
class Mix:
    """``entropy`` (nats) or ``max_repeats`` fixes the exponent; ``budget`` is in tokens.

    Without a budget, it is the smallest that reads every source at least once, so nothing is dropped.
    """

    entropy: float | None = None
    max_repeats: float | None = None
    budget: float | None = None
    blocks: int = 4096
    block_tokens: int = 100_000
    seed: int = 17
    highest: float = 8.0


def tokens(text: Column) -> Column:
    """Words between ASCII white space; a text without words, or null, counts as one token."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("bigint")


def _keyed(docs: DataFrame, mix: Mix, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Adds ``__source`` and ``__h``, the document's place in every ordering."""
    return docs.withColumns({
        "__source": F.col(source_col).cast("string"),
        "__h": F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col)), F.lit(mix.seed)),
    })


def exponent(sources: DataFrame, mix: Mix) -> float:
    """Bisect the exponent over ``sources(share)``; each job evaluates the midpoints of LEVELS levels.

    Entropy falls as the exponent grows, so the root is the exponent of that entropy; an unreachable
    target gives the nearest end of [0, highest]. Repetition falls too: the result is the smallest
    exponent in [0, 1] that keeps to the limit.
    """
    low, high = 0.0, mix.highest if mix.entropy is not None else 1.0
    for _ in range(40 // LEVELS):
        n = 2**LEVELS
        points = [low + (high - low) * k / n for k in range(1, n)]
        grid = sources.select("share", F.explode(F.array(*map(F.lit, points))).alias("a"))
        power = F.pow("share", F.col("a"))
        seen = {
            r["a"]: r
            for r in grid.groupBy("a").agg(
                F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("zl"), F.max(power / F.col("share")).alias("most"),
                F.min(power / F.col("share")).alias("least"),
            ).collect()
        }
        for _ in range(LEVELS):
            mid = low + (high - low) / 2
            r = seen[min(seen, key=lambda a: abs(a - mid))]
            if mix.entropy is not None:
                right = math.log(r["z"]) - r["a"] * r["zl"] / r["z"] > mix.entropy
            else:
                # repeats of the most and the least repeated source, without or with a fixed budget
                times = r["most"] / r["least"] if mix.budget is None else r["most"] / r["z"] * mix.budget
                right = times > mix.max_repeats
            low, high = (mid, high) if right else (low, mid)
    return high


def plan(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per (source, block): weight, epochs, whole passes, and how much of the last pass it joins.

    Columns: ``source, block, blocks, tokens, weight, epochs, passes, last_rank, cut``; ``cut`` is the
    largest document hash of the block that the last pass takes (null: none).
    """
    sized = save(
        _keyed(docs, mix, id_col, source_col, text_col).select("__source", "__h", tokens(F.col(text_col)).alias("n")),
        "sizes",
    )
    by_source = save(sized.groupBy("__source").agg(F.sum("n").alias("t")), "sources")
    total = by_source.agg(F.sum("t")).first()[0]
    shares = by_source.withColumn("share", F.col("t") / F.lit(float(total or 1)))
    if not total:
        a, z, least, budget = 1.0, 1.0, 1.0, 0.0
    else:
        a = 1.0
        if mix.entropy is not None or mix.max_repeats is not None:
            # a budget is known to ``exponent`` as a multiple of the corpus
            scaled = mix if mix.budget is None else Mix(mix.entropy, mix.max_repeats, mix.budget / total)
            a = exponent(shares, scaled)
        r = shares.agg(
            F.sum(F.pow("share", F.lit(a))).alias("z"), F.min(F.pow("share", F.lit(a - 1.0))).alias("least")
        ).first()
        z, least = r["z"], r["least"]
        budget = mix.budget if mix.budget is not None else total * z / least
    weights = shares.select(
        F.col("__source").alias("source"), F.col("t"),
        (F.pow("share", F.lit(a)) / z).alias("weight"),
        F.least(F.lit(mix.blocks), F.ceil(F.col("t") / mix.block_tokens)).cast("int").alias("blocks"),
    ).withColumn("epochs", F.round(F.lit(float(budget)) * F.col("weight") / F.col("t"), 9))
    weights = weights.withColumn("passes", F.floor("epochs").cast("int"))

    placed = _join(sized, weights, ["source"]).withColumn("block", _block("__h", "blocks"))
    blocks = placed.groupBy("source", "block").agg(
        F.sum("n").alias("tokens"), *[F.first(c).alias(c) for c in ("t", "weight", "blocks", "epochs", "passes")]
    )
    rank = F.xxhash64(F.lit(mix.seed), F.col("source"), F.col("block"), F.col("passes"))
    # at most ``blocks`` rows a source, a parameter
    order = Window.partitionBy("source").orderBy(rank, "block")
    blocks = blocks.withColumns({
        "last_rank": F.row_number().over(order) - 1,
        "upto": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    left = F.round((F.col("epochs") - F.col("passes")) * F.col("t")).cast("bigint") - F.col("upto") + F.col("tokens")
    blocks = save(blocks.withColumn("left", left), "blocks")

    border = blocks.where("left > 0 and left < tokens").select("source", "block", "left")
    inside = _join(
        placed.select(F.col("source").alias("__source"), "block", "__h", "n"), border, ["source", "block"]
    )
    spent = F.sum("n").over(Window.partitionBy("source", "block").orderBy("__h"))  # equal hashes go together
    cuts = inside.withColumn("spent", spent).where("spent <= left").groupBy("source", "block").agg(F.max("__h").alias("h"))
    same = F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.block") == F.col("c.block"))
    cut = F.when(F.col("left") >= F.col("tokens"), F.lit(2**63 - 1)).otherwise(F.col("h"))
    return blocks.alias("b").join(cuts.alias("c"), same, "left").select(
        *[F.col(f"b.{c}") for c in ("source", "block", "blocks", "tokens", "weight", "epochs", "passes", "last_rank")],
        cut.alias("cut"),
    )


def _block(h: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.col(h)), F.col(blocks)).cast("int")


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with null-safe source; the right side is broadcast only when it was counted to be small."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.col("__source").eqNullSafe(F.col("__r_source"))
    for k in keys[1:]:
        cond = cond & (F.col(k) == F.col(f"__r_{k}"))
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = left.join(F.broadcast(right) if small else right, cond)
    return out.drop(*[f"__r_{k}" for k in keys[1:]], "__source").withColumnRenamed("__r_source", "source")


def mix_documents(
    docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs``, each as often as its source's passes ask, with how it is placed in the stream.

    Adds ``mix_pass, mix_block, mix_rank, mix_epochs, mix_weight, mix_at``: sorting by ``mix_at`` (the
    block's place in [0, 1)) and ``mix_rank`` interleaves the sources in their weights. A null source
    is a source of its own; repeated rows are placed alike; an empty table stays empty; a text longer than its
    source's last pass is in the whole passes only. Names that clash with the added columns are replaced.
    """
    chosen = save(plan(docs, mix, id_col, source_col, text_col), "plan")
    added = ["mix_pass", "mix_block", "mix_rank", "mix_epochs", "mix_weight", "mix_at"]
    own = docs.drop(*added)
    keyed = _keyed(own, mix, id_col, source_col, text_col)
    counts = chosen.select("source", "blocks").distinct().withColumnRenamed("blocks", "__blocks")
    # (source, block) rows can be many; sources alone decide the block count, blocks the passes
    at = _join(keyed.withColumnRenamed(source_col, "__own_source"), counts, ["source"])
    at = at.withColumnRenamed("source", "__source").withColumn("__b", _block("__h", "__blocks"))
    steps = chosen.select(
        "source", F.col("block").alias("__b"), F.col("passes").alias("__passes"), F.col("cut").alias("__cut"),
        F.col("epochs").alias("mix_epochs"), F.col("weight").alias("mix_weight"),
    )
    joined = _join(at, steps, ["source", "__b"])
    copies = F.col("__passes") + F.coalesce((F.col("__h") <= F.col("__cut")).cast("int"), F.lit(0))
    out = joined.withColumn("__copies", copies).where("__copies > 0").withColumn(
        "mix_pass", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))
    )
    rank = F.xxhash64(F.lit(mix.seed), F.col("source"), F.col("__b"), F.col("mix_pass"))
    place = F.pmod(rank, F.lit(1 << 30)) / F.lit(float(1 << 30))
    return out.withColumns({
        "mix_block": F.col("__b"), "mix_rank": F.xxhash64("__h", "mix_pass"),
        "mix_at": F.least((F.col("mix_pass") + place) / F.greatest(F.col("mix_epochs"), F.lit(1e-9)), F.lit(1.0)),
    }).drop("source").withColumnRenamed("__own_source", source_col).select(*own.columns, *added)
