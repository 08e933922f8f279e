"""Learning metrics of run logs: novelty, surprise, competence, replay, reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import blocks
from ..plans.blocks import trailing

# Fixed values.
START, RATE, HISTORY, WARM_UP, TARGET, LOW, HIGH = 0.1, 0.01, 1000, 50, 0.8, 0.001, 10.0
WINDOW, MASTERED, HIGH_ERROR, PROGRESS, NOISE = 60, 0.02, 0.08, 0.05, 0.35
MAX_BLOCKS, COOLDOWN = 24, 300
LIBRARY_SEEDS = ("echo hello", "ls -la", "pwd", "whoami", "uname -a", "cat /etc/os-release",
                 "ls /usr/bin | head", "seq 1 5")
PATH_SEEDS = ("~", "/tmp", "/etc/hostname", "/proc/cpuinfo")
INF = float("inf")


def mse(real: Column, predicted: Column) -> Column:
    diff = F.zip_with(real, predicted, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x) / F.size(real)


def novelty(runs: DataFrame, keys: list[str], step: str = "step", signature: str = "signature") -> DataFrame:
    """Reward ``1/sqrt(times seen)``, first-seen flag and running number of distinct behaviours."""
    seen = blocks.dense_index(runs, [*keys, signature], step, "times_seen")
    first = (F.col("times_seen") == 1)
    return (blocks.running_sums(seen, keys, step, {"coverage": F.when(first, 1).otherwise(0).cast("bigint")})
            .withColumn("is_new", first).withColumn("reward", 1.0 / F.sqrt(F.col("times_seen"))))


def surprise(errors: DataFrame, keys: list[str], step: str = "step", error: str = "error",
             start: float = START, rate: float = RATE, history: int = HISTORY) -> DataFrame:
    """Adaptive surprise detector in step order.

    Adds ``idx``, ``threshold`` (before judging), ``threshold_after``, ``surprising`` and ``novelty``
    (error over the mean of up to ``history`` earlier errors).  From the 50th error on, the threshold
    moves by ``rate`` toward 0.8 of the mean of the last 50.
    """
    cols = errors.columns
    halo = blocks.with_lookback(blocks.dense_index(errors, keys, step), keys, "idx", history)
    e = F.col(error)
    rows = (halo.withColumn("_recent", F.avg(e).over(trailing(keys, "idx", -(WARM_UP - 1))))
            .withColumn("_past", F.avg(e).over(trailing(keys, "idx", -history, -1)))
            .filter("_own").drop("_blk", "_own"))
    active = F.col("idx") >= WARM_UP
    rows = rows.withColumns({
        "a": F.when(active, 1.0 - rate).otherwise(1.0),
        "b": F.when(active, rate * TARGET * F.col("_recent")).otherwise(0.0),
        "lo": F.when(active, LOW).otherwise(-INF), "hi": F.when(active, HIGH).otherwise(INF)})
    out = blocks.clamped_scan(rows, keys, "idx", start)
    return out.select(*cols, "idx", F.col("before").alias("threshold"), F.col("after").alias("threshold_after"),
                      (e > F.col("before")).alias("surprising"),
                      F.coalesce(e / (F.col("_past") + 1e-8), e).alias("novelty"))


def surprise_stats(judged: DataFrame, keys: list[str], error: str = "error", history: int = HISTORY) -> DataFrame:
    last = judged.groupBy(*keys).agg(
        F.count("*").alias("total_predictions"), F.count_if("surprising").alias("total_surprises"),
        F.max_by("threshold_after", "idx").alias("threshold"))
    recent = (judged.select(*keys, "idx", error).join(last.select(*keys, "total_predictions"), keys)
              .filter(F.col("idx") > F.col("total_predictions") - history)
              .groupBy(*keys).agg(F.avg(error).alias("avg_surprise_recent")))
    return last.join(recent, keys).withColumn(
        "surprise_rate", F.col("total_surprises") / F.col("total_predictions"))


def _interpret(n: Column, mean: Column, old: Column, new: Column, std: Column, window: int) -> dict[str, Column]:
    full = n >= window
    progress = F.when(full & (old > 1e-8), (old - new) / old).otherwise(0.0)
    noise = F.when(full, std / (mean + 1e-8)).otherwise(0.0)
    stuck = full & (mean > HIGH_ERROR) & ~(progress > PROGRESS)
    return {"mean_error": mean, "progress": progress, "noise_ratio": noise,
            "mastered": full & (mean < MASTERED), "improving": progress > PROGRESS,
            "noisy": stuck & (noise > NOISE), "needs_capacity": stuck & (noise <= NOISE)}


def competence(errors: DataFrame, keys: list[str], step: str = "step", error: str = "error",
               window: int = WINDOW) -> DataFrame:
    """State of each key (usually a family) over its last ``window`` errors.

    Only the last rows per key are kept, and the rank filter already applies before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(step))
    last = (errors.select(*keys, step, error).withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= window))
    newer = F.col("_r") <= window - window // 2
    agg = last.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(error).alias("_m"), F.avg(F.when(~newer, F.col(error))).alias("_old"),
        F.avg(F.when(newer, F.col(error))).alias("_new"), F.stddev_pop(error).alias("_s"))
    return agg.withColumns(_interpret(*[F.col(c) for c in ("n", "_m", "_old", "_new", "_s")], window)
                           ).drop("_m", "_old", "_new", "_s")


def competence_history(errors: DataFrame, keys: list[str], step: str = "step", error: str = "error",
                       window: int = WINDOW) -> DataFrame:
    """The same state after every single error."""
    cols = errors.columns
    halo = blocks.with_lookback(blocks.dense_index(errors, keys, step), keys, "idx", window)
    recent = window - window // 2
    def over(fn, first: int, last: int) -> Column:
        return fn(error).over(trailing(keys, "idx", first, last))
    rows = halo.withColumns({
        "_n": F.least(F.col("idx"), F.lit(window)), "_m": over(F.avg, -(window - 1), 0),
        "_old": over(F.avg, -(window - 1), -recent), "_new": over(F.avg, -(recent - 1), 0),
        "_s": over(F.stddev_pop, -(window - 1), 0)}).filter("_own")
    return (rows.withColumns(_interpret(*[F.col(c) for c in ("_n", "_m", "_old", "_new", "_s")], window))
            .select(*cols, "idx", "mean_error", "progress", "noise_ratio", "mastered", "improving", "noisy",
                    "needs_capacity"))


def label(state: DataFrame) -> DataFrame:
    return state.withColumn("label", F.when(F.col("mastered"), "mastered").when(F.col("noisy"), "noisy")
                            .when(F.col("needs_capacity"), "underfit").when(F.col("improving"), "learning")
                            .otherwise("exploring"))


def curiosity(noisy: Column) -> Column:
    return F.when(noisy, 0.1).otherwise(1.0)


def _listed(cond: Column) -> Column:
    names = F.array_sort(F.collect_list(F.when(cond, F.col("family"))))
    return F.when(F.size(names) == 0, "[]").otherwise(
        F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']")))


def policy(state: DataFrame, keys: list[str], window: int = WINDOW, max_blocks: int = MAX_BLOCKS,
           cooldown: int = COOLDOWN, blocks_now: int = 0, since_growth: int = 10 ** 9) -> DataFrame:
    """Family to grow for, and the stall report, per campaign (rows: keys, family, competence columns).

    Families are a small vocabulary, so the two name lists stay short.
    """
    full = F.col("n") >= window
    open_ = full & ~F.col("mastered")
    agg = state.groupBy(*keys).agg(
        F.max_by("family", F.when(F.col("needs_capacity"), F.struct("mean_error", "family"))).alias("_stuck"),
        F.count_if("needs_capacity").alias("_n_stuck"), F.count_if(open_).alias("_open"),
        F.count_if(open_ & (F.col("improving") | F.col("needs_capacity"))).alias("_moving"),
        F.count_if(open_ & F.col("noisy")).alias("_noisy"),
        _listed(open_).alias("_open_names"), _listed(open_ & F.col("noisy")).alias("_noisy_names"))
    may_grow = F.lit(blocks_now < max_blocks and since_growth >= cooldown)
    stalled = (F.col("_open") > 0) & (F.col("_moving") == 0)
    report = (F.when(~stalled, F.lit(None).cast("string"))
              .when(F.lit(blocks_now >= max_blocks), F.concat(
                  F.lit("STALL: at max capacity and no family improving; unmastered="), F.col("_open_names")))
              .when(F.col("_noisy") == F.col("_open"), F.concat(
                  F.lit("STALL(benign): remaining unmastered families are all unlearnable noise "),
                  F.col("_noisy_names"))))
    return agg.select(*keys, F.when(may_grow & (F.col("_n_stuck") > 0), F.col("_stuck")).alias("grow_for"),
                      report.alias("stall_report"))


def forgetting(history: DataFrame, keys: list[str], step: str = "step", value: str = "loss") -> DataFrame:
    """Points whose last ten values average above 1.2 times the ten before (the first ten early on)."""
    cols = history.columns
    halo = blocks.with_lookback(blocks.dense_index(history, keys, step), keys, "idx", 20)
    early = F.avg(F.when(F.col("idx") <= 10, F.col(value))).over(
        Window.partitionBy(*keys, "_blk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    older = F.when(F.col("idx") > 20, F.avg(value).over(trailing(keys, "idx", -19, -10))).otherwise(early)
    rows = (halo.withColumn("recent_avg", F.avg(value).over(trailing(keys, "idx", -9)))
            .withColumn("older_avg", older).filter("_own"))
    return rows.select(*cols, "idx", "recent_avg", "older_avg",
                       ((F.col("idx") > 10) & (F.col("recent_avg") > F.col("older_avg") * 1.2)).alias("forgetting"))


def ema(rows: DataFrame, keys: list[str], step: str = "step", value: str = "value", alpha: float = 0.1,
        start: float = 0.0) -> DataFrame:
    """Exponential moving average ``alpha * new + (1 - alpha) * current`` in step order."""
    cols = rows.columns
    idx = blocks.dense_index(rows, keys, step).withColumns({
        "a": F.lit(1.0 - alpha), "b": alpha * F.col(value).cast("double"), "lo": F.lit(-INF), "hi": F.lit(INF)})
    return blocks.clamped_scan(idx, keys, "idx", start).select(*cols, F.col("after").alias("ema"))


def library(runs: DataFrame, keys: list[str], cap: int | None = None) -> DataFrame:
    """Commands that worked, in order of first success; the first only where a library size (seeds included) is given."""
    good = (runs.filter((F.col("exit_code") == 0) & ~F.col("command").isin(*LIBRARY_SEEDS))
            .groupBy(*keys, "command").agg(F.min("step").alias("step")))
    ranked = blocks.dense_index(good, keys, "step", "rank").withColumn("rank", F.col("rank").cast("int"))
    return ranked if cap is None else ranked.filter(F.col("rank") <= cap - len(LIBRARY_SEEDS))


def harvested_paths(runs: DataFrame, keys: list[str], cap: int | None = None, seen_chars: int | None = None) -> DataFrame:
    """Path-like tokens of the output, in order of first sight; ``seen_chars`` limits what of an output is looked at.

    A campaign is never sorted as a whole: counts of new paths are summed over steps, and only the paths of
    one step are ordered.
    """
    seen = F.col("stdout") if seen_chars is None else F.substring("stdout", 1, seen_chars)
    hits = F.posexplode(F.regexp_extract_all(seen, F.lit("/[A-Za-z0-9_./-]+"), 0))
    first = (runs.select(*keys, "step", hits.alias("pos", "path")).filter(~F.col("path").isin(*PATH_SEEDS))
             .groupBy(*keys, "path").agg(F.min(F.struct("step", "pos")).alias("_at"))
             .select(*keys, "path", "_at.step", "_at.pos"))
    fresh = first.groupBy(*keys, "step").agg(F.count("*").alias("_n"))
    before = blocks.running_sums(fresh, keys, "step", {"_upto": F.col("_n")}).select(*keys, "step", (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "step").orderBy("pos"))
    out = (first.withColumn("_r", inside).join(before, [*keys, "step"])
           .withColumn("rank", (F.col("_before") + F.col("_r")).cast("int")).drop("_before", "_r"))
    return out if cap is None else out.filter(F.col("rank") <= cap - len(PATH_SEEDS))


def _unit_hash(seed: str, keys: list[str], step: str) -> Column:
    """Reproducible draw in (0, 1] from the md5 of seed and row identity."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in [*keys, step]]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / float(2 ** 52)


def replay_table(transitions: DataFrame, keys: list[str], capacity: int = 50_000, step: str = "step") -> DataFrame:
    """The last ``capacity`` transitions per key."""
    idx = blocks.dense_index(transitions, keys, step)
    total = transitions.groupBy(*keys).agg(F.count("*").alias("_n"))
    return idx.join(total, keys).filter(F.col("idx") > F.col("_n") - capacity).drop("_n")


def replay_sample(transitions: DataFrame, keys: list[str], batch: int, old_ratio: float = 0.4, recent: int = 500,
                  power: float = 1.0, offset: float = 1e-3, seed: str = "0", step: str = "step") -> DataFrame:
    """Batch per key: uniform draws from the recent rows plus error-weighted draws from all rows.

    A weighted draw without replacement keeps the smallest ``-ln(u)/w``; ``u`` is a seeded hash, so
    the sample is reproducible (and differs from draws of a random generator).  Buffers no larger
    than the batch come back whole.  ``old_ratio=0`` with ``recent`` at least the buffer is the uniform variant.
    """
    n_recent = int(batch * (1 - old_ratio))
    idx = replay_table(transitions, keys, 2 ** 62, step)
    total = transitions.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = idx.join(total, keys)
    whole = rows.filter(F.col("_n") <= batch).withColumn("part", F.lit("all"))
    big = rows.filter(F.col("_n") > batch)
    u1, u2 = _unit_hash(seed + "r", keys, step), _unit_hash(seed + "o", keys, step)
    weight = F.pow(F.col("error") + offset, F.lit(power))
    def draw(df: DataFrame, key: Column, n: int, part: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("_key", step)
        return (df.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
                .drop("_key", "_r").withColumn("part", F.lit(part)))
    new = draw(big.filter(F.col("idx") > F.col("_n") - recent), u1, n_recent, "recent")
    old = draw(big, -F.ln(u2) / weight, batch - n_recent, "old")
    return whole.unionByName(new).unionByName(old).drop("_n")


def bucket(vec: Column) -> Column:
    """Vector rounded half-even to one decimal, as a text key."""
    return F.array_join(F.transform(vec, lambda x: (F.bround(x, 1) + 0.0).cast("string")), ",")


def rank_candidates(candidates: DataFrame, state: DataFrame, state_visits: DataFrame,
                    action_visits: DataFrame) -> DataFrame:
    """Best candidate per decision; rows (decision_id, pos, family, pred, action).

    Score: weighted family error + 0.5/sqrt(1+visits of predicted state) + 0.3/sqrt(1+visits of action).
    ``state`` has (family, mean_error, noisy); visits have (bucket, visits).
    """
    rows = candidates.withColumns({"_s": bucket(F.col("pred")), "_a": bucket(F.col("action"))})
    j = (rows.join(state.select("family", "mean_error", "noisy"), "family", "left")
         .join(state_visits.select(F.col("bucket").alias("_s"), F.col("visits").alias("_ns")), "_s", "left")
         .join(action_visits.select(F.col("bucket").alias("_a"), F.col("visits").alias("_na")), "_a", "left"))
    score = (curiosity(F.coalesce("noisy", F.lit(False))) * F.coalesce("mean_error", F.lit(1.0))
             + 0.5 / F.sqrt(1 + F.coalesce("_ns", F.lit(0))) + 0.3 / F.sqrt(1 + F.coalesce("_na", F.lit(0))))
    best = F.max(F.struct(F.round(score, 9).alias("score"), (-F.col("pos")).alias("p"), F.col("family")))
    return j.groupBy("decision_id").agg(best.alias("b")).select(
        "decision_id", (-F.col("b.p")).alias("pos"), F.col("b.family").alias("family"), F.col("b.score").alias("score"))


def report(state: DataFrame, novelty_rows: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Per campaign: families seen, mastered and noisy, coverage, generalisation and last-5 trends."""
    fam = state.groupBy(*keys).agg(
        F.count("*").alias("families_seen"), F.count_if("mastered").alias("mastered"),
        F.count_if("noisy").alias("noisy_skipped"), F.count_if("improving").alias("improving"))
    cov = novelty_rows.groupBy(*keys).agg(F.max("coverage").alias("coverage"))
    w = Window.partitionBy(*keys).orderBy(F.desc("step"))
    last = history.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 5)
    def trend(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("step", c))), lambda x: x[c])
    tail = last.groupBy(*keys).agg(
        trend("train_err").alias("train_err_trend"), trend("heldout_err").alias("heldout_err_trend"),
        F.max_by(F.struct("train_err", "heldout_err"), "step").alias("_now"))
    return fam.join(cov, keys, "left").join(tail, keys, "left").withColumn(
        "generalizing", F.col("_now.heldout_err") <= F.col("_now.train_err") * 1.5).drop("_now")


def epoch_means(metrics: DataFrame, columns: list[str]) -> DataFrame:
    return metrics.groupBy("epoch").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])


def append_history(points: DataFrame, path: str) -> None:
    points.write.mode("append").parquet(path)
