"""Work along an order without giving a key to one task: values carried forward, as-of joins, cooldowns, exact quantiles.

A key may hold any share of the rows. Rows are dealt by ranges of (key, order), so a hot key is cut into slices; what a slice needs from
the ones before it is a single value, which is found from one row for each slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.storage import save, scope

#: So many brackets of ``quantiles`` are broadcast: some 10 MB. More meet the values by a shuffle.
FEW = 100_000


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, keep: bool = True) -> DataFrame:
    """``df`` with ``value`` of each row replaced by the last one that is not null at or before it, within ``by`` along ``order``.

    ``order`` should tell apart the rows of a key (it also decides where a hot key is cut). Nulls in ``by`` are a key of their own; rows before a key's first value keep null.
    """
    keys = [*by, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = save(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed", keep).withColumn("__part", F.shiftright("__at", 33))
    # the last value of each key in each slice, for the keys that a slice begins with: only these reach over its edge
    heads = placed.groupBy("__part").agg(F.min_by(F.struct(*by), "__at").alias("__key"))  # a row for each slice
    held = placed.groupBy("__part", F.struct(*by).alias("__key")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__at"))).alias("__last"))
    firsts = heads.select(F.col("__key").alias("__first")).distinct()
    over = held.join(F.broadcast(firsts), F.col("__key").eqNullSafe(F.col("__first")), "left_semi")
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    over = over.withColumn("__carried", F.last("__last", ignorenulls=True).over(before))
    carried = over.join(heads.select(F.col("__part").alias("__of_part"), F.col("__key").alias("__of_key")), (F.col("__part") == F.col("__of_part")) & F.col("__key").eqNullSafe(F.col("__of_key")))
    carried = save(carried.where("__carried IS NOT NULL").select("__of_part", "__of_key", "__carried"), "carried", keep)  # at most a row for each slice
    upto = Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("__own", F.last(value, ignorenulls=True).over(upto))
    met = own.join(F.broadcast(carried), (F.col("__part") == F.col("__of_part")) & F.struct(*by).eqNullSafe(F.col("__of_key")), "left")
    return met.withColumn(value, F.coalesce("__own", "__carried")).select(*df.columns)


def asof_join(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, fact_ts: str, valid_from: str = "valid_from", valid_to: str = "valid_to", how: str = "inner"
) -> DataFrame:
    """Each fact with the version of its key that was valid at its time, as ``scd.scd2_join`` gives it, for keys with many facts or versions.

    Facts and versions go through one sorted pass, in which the last version is carried forward; no fact meets more than one version, and a
    hot key is cut into slices of time. Versions of a key must not overlap. ``how``: inner or left. Facts without key or time match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how!r}")
    far = F.lit(2**63 - 1)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    if how == "inner":
        fact = fact.where(F.col(fact_key).isNotNull() & F.col(fact_ts).isNotNull())
    facts = fact.select(
        F.col(fact_key).alias("__k"), micros(fact_ts).alias("__t"), F.lit(1).alias("__kind"), F.monotonically_increasing_id().alias("__tie"),
        F.struct(*[F.col(f"`{c}`") for c in fact.columns]).alias("__fact"),
    )
    versions = dim.where(F.col(dim_key).isNotNull() & F.col(valid_from).isNotNull()).select(
        F.col(dim_key).alias("__k"), micros(valid_from).alias("__t"), F.lit(0).alias("__kind"), F.coalesce(micros(valid_to), far).alias("__tie"),
        F.struct(*[F.col(f"`{c}`") for c in dim.columns]).alias("__version"),
    )
    both = facts.unionByName(versions, allowMissingColumns=True)
    joined = carry_forward(both, ["__k"], ["__t", "__kind", "__tie"], "__version").where("__kind = 1")
    end = F.col(f"__version.{valid_to}")
    valid = F.col("__version").isNotNull() & (end.isNull() | (F.col("__t") < F.unix_micros(end.cast("timestamp"))))
    if how == "inner":
        return joined.where(valid).select("__fact.*", "__version.*")
    return joined.select("__fact.*", *[F.when(valid, F.col(f"__version.`{c}`")).alias(c) for c in dim.columns])


def cooldown(events: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Events that fire, as ``retention.cooldown`` gives them, for keys of any size: by pointer jumping.

    Each event points to the first one of its key ``seconds`` or more later, found by carrying event times back over a sorted pass. The
    first event of a key fires, and so does what a firing event points to: each round follows the pointers from all that is marked and doubles
    their reach, so rounds grow with the logarithm of the longest chain. ``tie`` orders events of one time. Events without a time never fire.
    """
    timed = events.where(F.col(ts).isNotNull())
    if seconds <= 0:
        return timed
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    with scope():
        one = save(timed.select(F.col(key).alias("k"), micros.alias("t"), F.col(tie).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("e")), "timed")
        rows = save(one.withColumn("id", F.monotonically_increasing_id()), "events", keep=True)
        # backwards in time: an event comes before the probes of its own time, the later of two events of one time first
        back = rows.select("k", (-F.col("t")).alias("b"), F.lit(0).alias("probe"), F.col("tie"), F.col("id"), F.col("id").alias("next"))
        probes = rows.select("k", (-(F.col("t") + F.lit(seconds * 1_000_000))).alias("b"), F.lit(1).alias("probe"), F.col("tie"), "id", F.lit(None).cast("bigint").alias("next"))
        ranked = back.unionByName(probes).withColumn("rank", _descending(back, "tie"))
        jump = save(carry_forward(ranked.select("k", "b", "probe", "rank", "id", "next"), ["k"], ["b", "probe", "rank"], "next", keep=False).where("probe = 1 AND next IS NOT NULL").select("id", "next"), "pointers")
        first = rows.groupBy("k").agg(F.min(F.struct("t", "tie", "id")).alias("f")).select(F.col("f.id").alias("id"))
        marked = save(first, "marked")
        # only what is pointed to, or first, is ever followed
        useful = jump.select(F.col("next").alias("id")).distinct().unionByName(first).distinct()
        jump = save(jump.join(useful, "id", "left_semi"), "pointers")
        while not jump.isEmpty():
            reached = marked.join(jump, "id").select(F.col("next").alias("id"))
            marked = save(marked.unionByName(reached).distinct(), "marked")
            far = jump.select(F.col("id").alias("next"), F.col("next").alias("then"))
            jump = save(jump.join(far, "next").select("id", F.col("then").alias("next")), "pointers")
        marked = save(marked, "fired", keep=True)
    return rows.join(marked, "id", "left_semi").select("e.*")


def _descending(df: DataFrame, column: str):
    """A number or the hash of a value that orders the other way round; ties of one time are told apart by numbers."""
    kind = df.schema[column].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "double", "float"):
        raise ValueError(f"the tie-break of a cooldown is a number, not {kind}")
    return -F.col(column)


def quantiles(df: DataFrame, by: Sequence[str], column: str, at: Sequence[float], accuracy: int = 10_000, most: int = 1_000_000) -> DataFrame:
    """``by`` and ``q0, q1, ...``: the exact quantiles ``at`` of a numeric column, linear between neighbours, nulls left out.

    A sketch of each group brackets every quantile; a counting pass says which rank within its bracket is wanted, and the bracket is sketched
    again until it holds at most ``most`` distinct values or one; only these are counted one by one and sorted. So no task holds more of a group than that, however
    many distinct values the group has. A bracket that missed its rank is widened to the group's ends.
    """
    with scope():
        values = save(df.where(F.col(column).isNotNull()).select(*[F.col(c).alias(c) for c in by], F.col(column).cast("double").alias("v")), "values")
        total = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        wanted = F.array(*[F.struct(F.lit(k).alias("q"), F.lit(float(p)).alias("p")) for k, p in enumerate(at)])
        state = total.select(*by, "n", "least", "most", F.explode(wanted).alias("w")).select(
            *by, "w.q", ((F.col("n") - 1) * F.col("w.p")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("n").alias("inside"), F.lit(0).cast("bigint").alias("below"), "least", "most"
        )
        state = save(state, "brackets")
        few = state.count() <= FEW
        match = F.col("lo") <= F.col("v")
        for _ in range(8):
            if not state.where(F.col("inside") > most).where("lo < hi").limit(1).count():
                break
            narrow = save(_narrowed(values, state, by, accuracy, few), "narrowed")
            counted = _met(values, narrow, by, few).groupBy(*by, "q").agg(
                F.count(F.when(F.col("v") < F.col("lo"), 1)).alias("below"), F.count(F.when(match & (F.col("v") <= F.col("hi")), 1)).alias("inside")
            )
            new = _met(narrow.drop("below", "inside"), counted, [*by, "q"])
            kept = (F.col("below") <= F.floor("rank")) & (F.ceil("rank") < F.col("below") + F.col("inside"))
            new = new.withColumns({"good": kept})
            old = state.select(*[F.col(c).alias(c) for c in by], "q", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), F.col("below").alias("below0"), F.col("inside").alias("inside0"))
            new = _met(new, old, [*by, "q"])
            pick = lambda c: F.when(F.col("good"), F.col(c)).otherwise(F.col(f"{c}0")).alias(c)
            after = save(new.select(*by, "q", "rank", pick("lo"), pick("hi"), pick("inside"), pick("below"), "least", "most"), "brackets")
            same = after.agg(F.sum("inside")).first()[0] >= state.agg(F.sum("inside")).first()[0]
            state = after
            if same:
                break
        inside = _met(values, state, by, few).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        counts = inside.groupBy(*by, "q", "rank", "below", "v").agg(F.count(F.lit(1)).alias("c"))
        upto = Window.partitionBy(*by, "q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        ends = counts.withColumn("end", F.col("below") + F.sum("c").over(upto)).withColumn("start", F.col("end") - F.col("c"))
        hit = lambda r: F.max(F.when((F.col("start") <= r) & (r < F.col("end")), F.col("v")))
        found = ends.groupBy(*by, "q").agg(hit(F.floor("rank")).alias("a"), hit(F.ceil("rank")).alias("b"), F.first("rank").alias("rank"))
        part = F.col("rank") - F.floor("rank")
        # weighed as Spark's percentile does, to the last bit
        out = found.withColumn("x", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part))
        return save(out.groupBy(*by).agg(*[F.max(F.when(F.col("q") == k, F.col("x"))).alias(f"q{k}") for k in range(len(at))]), "quantiles", keep=True)


def _met(left: DataFrame, right: DataFrame, by: Sequence[str], few: bool = False) -> DataFrame:
    """Inner join on null-safe keys; the right side's keys go. With ``few`` the right side is broadcast, so that the left one stays where it is."""
    named = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
    match = F.lit(True)
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(F.broadcast(named) if few else named, match).drop(*[f"__r_{c}" for c in by])


def _narrowed(values: DataFrame, state: DataFrame, by: Sequence[str], accuracy: int, few: bool) -> DataFrame:
    """Brackets around each rank by a sketch of the values inside the old ones, two of its errors wide on both sides.

    Ranks with one bracket share its sketch; at first all of a group do.
    """
    spans = state.select(*by, "lo", "hi").distinct()
    inside = _met(values, spans, by, few).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    steps = [k / 1000 for k in range(1001)]
    sketch = inside.groupBy(*by, "lo", "hi").agg(F.percentile_approx("v", steps, accuracy).alias("marks"))
    met = _met(state, sketch, [*by, "lo", "hi"])
    place = (F.col("rank") - F.col("below")) / F.greatest(F.col("inside") - 1, F.lit(1)) * 1000
    low, high = F.greatest(F.floor(place) - 2, F.lit(0)), F.least(F.ceil(place) + 2, F.lit(1000))
    return met.select(
        *by, "q", "rank", F.col("marks")[low.cast("int")].alias("lo"), F.col("marks")[high.cast("int")].alias("hi"), "below", "inside", "least", "most"
    )


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What ``profile.column_stats`` tells of numeric columns, without a column's distinct values in one task.

    The columns become rows (name, value): minimum, maximum, mean and deviation are combined before the shuffle, distinct values are grouped before
    they are counted, and medians come from narrowed brackets. Values are taken as doubles.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")
    with scope():
        long = save(df.select(pairs).select("p.*"), "pairs", keep=True)
    plain = long.groupBy("column_name").agg(
        F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.avg("v").alias("mean_value"), F.stddev_samp("v").alias("stddev_value")
    )
    medians = quantiles(long, ["column_name"], "v", [0.5]).withColumnRenamed("q0", "median_value")
    distinct = long.where("v IS NOT NULL").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    out = plain.join(medians, "column_name", "left").join(distinct, "column_name", "left").fillna(0, ["n_distinct"])
    return out.select("column_name", "min_value", "max_value", "mean_value", "median_value", "stddev_value", "n_distinct")
