"""Problem 8: mixing sources to target weights by whole copies and Pareto order sampling.

The target of a source is its weight times the total of tokens. Whole copies of all its documents are certain; what
is left of the target is drawn without replacement: documents are ranked by random odds over inclusion odds, and the
first in that order are taken until the rest is reached.

A source may hold a third of all documents, so ranks are never made over a whole source: a histogram of the ranks
finds the one bin in which the target is crossed, and only that bin is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import ensure_checkpoint_dir
from lodestrata.llm.tokens import VOCABULARY, count_tokens

BINS = 1 << 16


def allocate(available: dict[str, int], targets: list[tuple[str, float, int]], total: int) -> dict[str, tuple[float, float]]:
    """(wanted, allotted) tokens by source; what a capped source can't give goes to the others by their weights.

    `targets` has one row per source, a count fixed by the configuration, so this small loop runs on the driver.
    """
    weights = {s: max(0.0, w or 0.0) for s, w, _ in targets if s is not None}
    most = {s: available.get(s, 0) * max(0, r if r is not None else 1) for s, _, r in targets if s is not None}
    scale = sum(weights.values()) or 1.0
    wanted = {s: w / scale * total for s, w in weights.items()}
    got = {s: 0.0 for s in weights}
    open_, left = {s for s in weights if weights[s] > 0}, float(total)
    while open_ and left > 0.5:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if got[s] + share * weights[s] >= most[s]}
        for s in full or open_:
            step = most[s] - got[s] if s in full else share * weights[s]
            got[s] += step
            left -= step
        open_ -= full
        if not full:
            break
    return {s: (wanted[s], got[s]) for s in weights}


def certain_first(sized: DataFrame, drawn: dict[str, tuple[float, float]], largest: dict[str, int], size_power: float) -> dict[str, float]:
    """The factor of each source's inclusion odds, factor * tokens ** size_power, from (tokens to draw, first factor).

    A document whose odds would be above one is certain; the odds of the others are then scaled to what is left. Each
    turn is one aggregation over the sources that still change, of which most need none.
    """
    out = {s: f for s, (_, f) in drawn.items()}
    least = {s: float("inf") for s in out}  # size from which documents are certain
    while size_power > 0:
        now = {s: f ** (-1 / size_power) for s, f in out.items() if f > 0 and f * largest.get(s, 0) ** size_power > 1}
        changed = {s: x for s, x in now.items() if x < least[s] * (1 - 1e-12)}
        if not changed:
            break
        least |= changed
        bounds = sized.sparkSession.createDataFrame([(s, float(x)) for s, x in changed.items()], "source string, least double")
        rows = sized.where("tokens > 0").join(F.broadcast(bounds), "source")  # at most a row for each source of the targets
        sure = F.col("tokens") >= F.col("least")
        for r in rows.groupBy("source").agg(F.coalesce(F.sum(F.when(sure, F.col("tokens"))), F.lit(0)).alias("sure"), F.coalesce(F.sum(F.when(~sure, F.pow("tokens", F.lit(size_power)) * F.col("tokens"))), F.lit(0.0)).alias("moment")).collect():
            rest = max(0.0, drawn[r.source][0] - r.sure)
            # certain documents keep odds of one: the factor never falls
            out[r.source] = max(out[r.source], rest / r.moment if r.moment else out[r.source])
    return out


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, size_power: float = 0.5, redistribute: bool = False, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: doc_id, source, tokens, copies (>= 1). report: source, weight, max_repeats, available_tokens,
    target_tokens, mixed_tokens, target_share, share_of_total (mixed tokens over the target total), actual_share (over
    what was mixed), documents, copies, capped.

    Sizes are tokens of a public tokenizer; the total is that of all documents, those of unlisted or null sources
    included, though these are never drawn. Null and empty texts have no tokens and are never drawn. A weight of
    zero or null and a source without documents give no rows in the selection and zeros in the report; a null
    max_repeats counts as 1; of a source listed twice the weights are summed and the larger cap holds. The chance of
    a document grows with its size to the power `size_power`. Documents whose odds would be
    above one are certain and the rest is scaled. The same seed gives the same mix. If an allotment is
    above what max_repeats allows, the source is capped and the mix is that much smaller, so that the
    others keep their share of the target total; with `redistribute` the others take the rest by their weights.
    """
    spark = documents.sparkSession
    sized = count_tokens(documents.select("doc_id", "source", "text"), ["doc_id", "source"], vocabulary=vocabulary)
    ensure_checkpoint_dir(spark)
    sized = sized.checkpoint()
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("int").alias("max_repeats"))
    listed = [(r.source, r.weight, r.max_repeats) for r in wanted.collect()]
    per_source = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum(F.pow("tokens", F.lit(size_power)) * F.col("tokens")).alias("moment"), F.max("tokens").alias("largest"))
    names = [s for s, _, _ in listed]
    sums = {r.source: r for r in per_source.where(F.col("source").isin(names)).collect()} if names else {}
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    available = {s: int(r.available or 0) for s, r in sums.items()}
    given = allocate(available, listed, total)
    plan = []
    for s, w, r in listed:
        has, (want, got) = available.get(s, 0), given[s]
        goal = got if redistribute else min(want, has * max(0, r))
        whole = int(goal // has) if has else 0
        rest = goal - whole * has if has else 0.0
        # Σ p·tokens = rest with p proportional to tokens ** size_power
        factor = rest / sums[s].moment if has and sums[s].moment else 0.0
        plan.append((s, w, r, has, float(want), float(goal), min(whole, r), float(rest) if whole < r else 0.0, float(factor), total))
    factors = certain_first(sized, {x[0]: (x[7], x[8]) for x in plan}, {s: sums[s].largest or 0 for s in sums}, size_power)
    plan = [(*x[:8], factors[x[0]], total) for x in plan]
    ddl = "source string, weight double, max_repeats int, available_tokens bigint, target_tokens double, goal double, whole int, rest double, factor double, total bigint"
    per = spark.createDataFrame(plan, ddl)

    chance = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("factor") * F.pow("tokens", F.lit(size_power))))
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = sized.where("tokens > 0").join(F.broadcast(per.select("source", "whole", "rest", "factor")), "source")
    # logarithm of the Pareto rank; bins of its arc tangent keep its order over the whole line
    drawn = drawn.withColumn("odds", F.log(u / (1 - u)) - F.log(chance / (1 - chance)))
    drawn = drawn.withColumn("bin", F.floor((F.atan("odds") / F.lit(3.141592653589793) + 0.5) * BINS).cast("int"))
    bins = drawn.where("rest > 0").groupBy("source", "bin").agg(F.sum("tokens").alias("bin_tokens"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)))  # at most BINS rows per listed source
    edge = bins.join(F.broadcast(per.select("source", "rest")), "source").where("before < rest and before + bin_tokens >= rest").select("source", F.col("bin").alias("edge"), "before")
    drawn = drawn.join(F.broadcast(edge), "source", "left")
    inside = Window.partitionBy("source", "bin").orderBy("odds", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = drawn.where("rest > 0 and bin = edge").withColumn("so_far", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    # the document that crosses the target is taken if that brings the total nearer to it
    at_edge = at_edge.withColumn("extra", (F.col("so_far") + F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    others = drawn.where("not (rest > 0 and bin <=> edge)").withColumn("extra", F.when((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bin") < F.col("edge"))), 1).otherwise(0))
    keep = ["doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")]
    selection = others.select(*keep).unionByName(at_edge.select(*keep)).where("copies > 0")

    reached = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    report = per.join(reached, "source", "left").select(
        "source", "weight", "max_repeats", "available_tokens",
        F.round("target_tokens").cast("bigint").alias("target_tokens"),
        F.coalesce("mixed", F.lit(0)).cast("bigint").alias("mixed_tokens"),
        F.when(F.col("total") > 0, F.col("target_tokens") / F.col("total")).otherwise(0.0).alias("target_share"),
        F.when(F.col("total") > 0, F.coalesce("mixed", F.lit(0)) / F.col("total")).otherwise(0.0).alias("share_of_total"),
        F.coalesce(F.col("mixed") / F.sum("mixed").over(Window.partitionBy(F.lit(1))), F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"),
        F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"),
        (F.col("goal") + 0.5 < F.col("target_tokens")).alias("capped"),
    )
    return selection, report
