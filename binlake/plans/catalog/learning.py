"""Novelty, surprise, competence, replay and reports over run logs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import learn
from ._register import Catalog

QUERIES = Catalog()
q = QUERIES.query
KEYS = ["campaign"]
DIGITS = 11  # averages of short decimals: no ties at this place


def r6(df, *cols):
    return df.withColumns({c: F.round(c, DIGITS) for c in cols})


@q("errors", """SELECT campaign, step, times_seen, times_seen = 1 AS is_new, CAST(count(*) FILTER (times_seen = 1) OVER (PARTITION BY campaign ORDER BY step) AS BIGINT) AS coverage,
    round(1 / sqrt(times_seen), 11) AS reward FROM (SELECT *, row_number() OVER (PARTITION BY campaign, family, k % 10 ORDER BY step) AS times_seen FROM errors)""")
def learn_novelty(t):
    e = t.errors().withColumn("signature", F.concat_ws("|", "family", (F.col("k") % 10).cast("string")))
    return r6(learn.novelty(e, KEYS).select("campaign", "step", "times_seen", "is_new", "coverage", "reward"), "reward")


SURPRISE = """ix AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY step) AS idx,
    avg(error) OVER (PARTITION BY campaign ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS recent,
    avg(error) OVER (PARTITION BY campaign ORDER BY step ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING) AS past FROM errors),
th AS (SELECT campaign, 0 AS idx, 0.1::DOUBLE AS t_before, 0.1::DOUBLE AS t_after FROM (SELECT DISTINCT campaign FROM errors) UNION ALL
    SELECT th.campaign, ix.idx, th.t_after, CASE WHEN ix.idx < 50 THEN th.t_after ELSE greatest(0.001, least(10, th.t_after + 0.01 * (0.8 * ix.recent - th.t_after))) END
    FROM th JOIN ix ON ix.campaign = th.campaign AND ix.idx = th.idx + 1)"""


@q("errors", """SELECT campaign, step, ix.idx, round(t_before, 11) AS threshold, round(t_after, 11) AS threshold_after, error > t_before AS surprising,
    round(coalesce(error / (past + 1e-8), error), 11) AS novelty FROM ix JOIN th USING (campaign, idx)""", SURPRISE)
def learn_surprise(t):
    out = learn.surprise(t.errors(), KEYS).select("campaign", "step", "idx", "threshold", "threshold_after", "surprising", "novelty")
    return r6(out, "threshold", "threshold_after", "novelty")


@q("errors", """SELECT campaign, count(*) AS total_predictions, count(*) FILTER (error > t_before) AS total_surprises, round(arg_max(t_after, idx), 11) AS threshold,
    round(avg(error), 11) AS avg_surprise_recent, round(count(*) FILTER (error > t_before) / count(*), 11) AS surprise_rate FROM ix JOIN th USING (campaign, idx) GROUP BY campaign""", SURPRISE)
def learn_surprise_stats(t):
    return r6(learn.surprise_stats(learn.surprise(t.errors(), KEYS), KEYS), "threshold", "avg_surprise_recent", "surprise_rate")


def state(part: str, w: int) -> str:
    """SQL of the competence state of each ``part`` over its last w errors."""
    cols = f"{part}, n, round(m, 11) AS mean_error, round(pr, 11) AS progress, round(nz, 11) AS noise_ratio"
    return f"""l AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY step DESC) AS r FROM errors),
s0 AS (SELECT {part}, count(*) AS n, avg(error) AS m, avg(error) FILTER (r > {w - w // 2}) AS o, avg(error) FILTER (r <= {w - w // 2}) AS nw, stddev_pop(error) AS sd
    FROM l WHERE r <= {w} GROUP BY {part}),
s1 AS (SELECT *, CASE WHEN n >= {w} AND o > 1e-8 THEN (o - nw) / o ELSE 0 END AS pr, CASE WHEN n >= {w} THEN sd / (m + 1e-8) ELSE 0 END AS nz FROM s0),
st AS (SELECT {cols}, n >= {w} AND m < 0.02 AS mastered, pr > 0.05 AS improving, n >= {w} AND m > 0.08 AND pr <= 0.05 AND nz > 0.35 AS noisy,
    n >= {w} AND m > 0.08 AND pr <= 0.05 AND nz <= 0.35 AS needs_capacity, m AS raw_mean FROM s1)"""


@q("errors", "SELECT * EXCLUDE (raw_mean) FROM st", state("campaign", 60))
def learn_competence(t):
    return r6(learn.competence(t.errors(), KEYS), "mean_error", "progress", "noise_ratio")


@q("errors", """SELECT * EXCLUDE (raw_mean), CASE WHEN mastered THEN 'mastered' WHEN noisy THEN 'noisy' WHEN needs_capacity THEN 'underfit' WHEN improving THEN 'learning'
    ELSE 'exploring' END AS label FROM st""", state("campaign, family", 10))
def learn_family_labels(t):
    return r6(learn.label(learn.competence(t.errors(), ["campaign", "family"], window=10)), "mean_error", "progress", "noise_ratio")


@q("errors", """SELECT campaign, step, idx, round(m, 11) AS mean_error, round(pr, 11) AS progress, round(nz, 11) AS noise_ratio, idx >= 10 AND m < 0.02 AS mastered, pr > 0.05 AS improving,
    idx >= 10 AND m > 0.08 AND pr <= 0.05 AND nz > 0.35 AS noisy, idx >= 10 AND m > 0.08 AND pr <= 0.05 AND nz <= 0.35 AS needs_capacity FROM (
    SELECT *, CASE WHEN idx >= 10 AND o > 1e-8 THEN (o - nw) / o ELSE 0 END AS pr, CASE WHEN idx >= 10 THEN sd / (m + 1e-8) ELSE 0 END AS nz FROM (
    SELECT campaign, step, row_number() OVER p AS idx, avg(error) OVER (p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, stddev_pop(error) OVER (p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS sd,
    avg(error) OVER (p ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS o, avg(error) OVER (p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS nw
    FROM errors WINDOW p AS (PARTITION BY campaign ORDER BY step)))""")
def learn_competence_history(t):
    out = learn.competence_history(t.errors().select("campaign", "step", "error"), KEYS, window=10).drop("error")
    return r6(out, "mean_error", "progress", "noise_ratio")


@q("errors", """SELECT campaign, arg_max(family, [raw_mean::VARCHAR, family]) FILTER (needs_capacity) AS grow_for,
    CASE WHEN count(*) FILTER (op) = 0 OR count(*) FILTER (op AND (improving OR needs_capacity)) > 0 OR count(*) FILTER (op AND noisy) < count(*) FILTER (op) THEN NULL
    ELSE 'STALL(benign): remaining unmastered families are all unlearnable noise [''' || array_to_string(list_sort(list(family) FILTER (op AND noisy)), ''', ''') || ''']' END AS stall_report
    FROM (SELECT *, n >= 10 AND NOT mastered AS op FROM st) GROUP BY campaign""", state("campaign, family", 10))
def learn_policy(t):
    return learn.policy(learn.competence(t.errors(), ["campaign", "family"], window=10), KEYS, window=10)


@q("errors", """SELECT campaign, step, idx, round(ra, 11) AS recent_avg, round(oa, 11) AS older_avg, idx > 10 AND ra > 1.2 * oa AS forgetting FROM (SELECT *, CASE WHEN idx > 20 THEN o20 ELSE o10 END AS oa FROM (
    SELECT campaign, step, row_number() OVER p AS idx, avg(error) OVER (p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ra, avg(error) OVER (p ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS o20,
    avg(CASE WHEN i <= 10 THEN error END) OVER p AS o10 FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY step) AS i FROM errors)
    WINDOW p AS (PARTITION BY campaign ORDER BY step)))""")
def learn_forgetting(t):
    return r6(learn.forgetting(t.errors().select("campaign", "step", F.col("error").alias("loss")), KEYS).drop("loss"), "recent_avg", "older_avg")


@q("errors", "SELECT campaign, step, round(v, 11) AS ema FROM em JOIN ix USING (campaign, idx)", """ix AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY step) AS idx FROM errors),
em AS (SELECT DISTINCT campaign, 0 AS idx, 0::DOUBLE AS v FROM errors UNION ALL SELECT em.campaign, ix.idx, 0.1 * ix.error + 0.9 * em.v FROM em JOIN ix ON ix.campaign = em.campaign AND ix.idx = em.idx + 1)""")
def learn_ema(t):
    return r6(learn.ema(t.errors().select("campaign", "step", F.col("error").alias("value")), KEYS).drop("value"), "ema")


@q("errors", """SELECT campaign, step, idx FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY step) AS idx, count(*) OVER (PARTITION BY campaign) AS n FROM errors) WHERE idx > n - 30""")
def learn_replay_table(t):
    return learn.replay_table(t.errors(), KEYS, 30).select("campaign", "step", "idx")


U = "((CAST('0x' || substr(md5('{s}:' || campaign || ':' || step), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE)"


@q("errors", f"""SELECT campaign, step, part FROM (SELECT campaign, step, 'all' AS part, 1 AS r, 1 AS lim FROM rp WHERE n <= 64
    UNION ALL SELECT campaign, step, 'recent', row_number() OVER (PARTITION BY campaign ORDER BY {U.format(s='0r')}, step), 38 FROM rp WHERE n > 64 AND idx > n - 50
    UNION ALL SELECT campaign, step, 'old', row_number() OVER (PARTITION BY campaign ORDER BY -ln({U.format(s='0o')}) / (error + 0.001), step), 26 FROM rp WHERE n > 64) WHERE r <= lim""",
   "rp AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY step) AS idx, count(*) OVER (PARTITION BY campaign) AS n FROM errors)")
def learn_replay_sample(t):
    return learn.replay_sample(t.errors(), KEYS, 64, recent=50).select("campaign", "step", "part")


CANDS = "(SELECT campaign * 100 + step % 20 AS decision_id, step AS pos, family, k FROM errors)"


@q("errors", """SELECT decision_id, arg_max(pos, [score, -pos]) AS pos, arg_max(family, [score, -pos]) AS family, max(score) AS score FROM (
    SELECT decision_id, pos, c.family, round(CASE WHEN coalesce(s.noisy, false) THEN 0.1 ELSE 1 END * coalesce(s.m, 1) + 0.5 / sqrt(1 + coalesce(a.n, 0)) + 0.3 / sqrt(1 + coalesce(b.n, 0)), 9) AS score
    FROM """ + CANDS + """ c LEFT JOIN (SELECT family, avg(k) / 500 AS m, family = 'view' AS noisy FROM errors GROUP BY family) s USING (family)
    LEFT JOIN (SELECT k // 10 AS b, count(*) % 7 AS n FROM errors GROUP BY 1) a ON a.b = c.k // 10 LEFT JOIN (SELECT k % 5 AS b, count(*) % 11 AS n FROM errors GROUP BY 1) b ON b.b = c.k % 5) GROUP BY decision_id""")
def learn_rank_candidates(t):
    e = t.errors()
    tens, fives = (F.floor(F.col("k") / 10)).cast("double"), (F.col("k") % 5).cast("double")
    cands = e.select((F.col("campaign") * 100 + F.col("step") % 20).alias("decision_id"), F.col("step").alias("pos"), "family",
                     F.array(tens + 0.01).alias("pred"), F.array(fives - 0.02).alias("action"))
    fam = e.groupBy("family").agg((F.avg("k") / 500).alias("mean_error")).withColumn("noisy", F.col("family") == "view")
    def visits(value, n):
        return e.groupBy(learn.bucket(F.array(value)).alias("bucket")).agg((F.count("*") % n).alias("visits"))
    return learn.rank_candidates(cands, fam, visits(tens, 7), visits(fives, 11))


def _report_parts(t):
    e = t.errors()
    novel = learn.novelty(e.withColumn("signature", F.col("family")), KEYS)
    hist = e.select("campaign", "step", F.col("error").alias("train_err"), (F.col("k") / 100).alias("heldout_err"))
    return learn.competence(e, ["campaign", "family"], window=10), novel, hist


@q("errors", """SELECT campaign, families_seen, mastered, noisy_skipped, improving, families_seen AS coverage, train_err_trend, heldout_err_trend, generalizing FROM (SELECT campaign, count(*) AS families_seen,
    count(*) FILTER (mastered) AS mastered, count(*) FILTER (noisy) AS noisy_skipped, count(*) FILTER (improving) AS improving FROM st GROUP BY campaign) JOIN (
    SELECT campaign, string_agg(printf('%.6f', error), ',' ORDER BY step) AS train_err_trend, string_agg(printf('%.6f', k / 100), ',' ORDER BY step) AS heldout_err_trend, arg_max(k / 100 <= error * 1.5, step) AS generalizing
    FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY step DESC) AS rr FROM errors) WHERE rr <= 5 GROUP BY campaign) USING (campaign)""", state("campaign, family", 10))
def learn_report(t):
    from .runlogs import show
    out = learn.report(*_report_parts(t), KEYS)
    return out.withColumns({c: show(F.col(c)) for c in ("train_err_trend", "heldout_err_trend")})


@q("ev", "SELECT user_id AS epoch, round(avg(value), 4) AS total_loss, round(avg(k), 4) AS recon_loss, round(avg((event_type = 'error')::INT), 4) AS is_surprising FROM ev GROUP BY user_id")
def learn_epoch_means(t):
    rows = t.ev().select(F.col("user_id").alias("epoch"), F.col("value").alias("total_loss"), F.col("k").alias("recon_loss"),
                         (F.col("event_type") == "error").cast("int").alias("is_surprising"))
    cols = ["total_loss", "recon_loss", "is_surprising"]
    return learn.epoch_means(rows, cols).withColumns({c: F.round(c, 4) for c in cols})


@q("vectors", """SELECT a.addr, round(list_sum([(x[1] - x[2]) ** 2 for x in list_zip(a.vector, b.vector)]) / 64, 6) AS mse FROM vectors a JOIN vectors b ON b.addr = a.addr + 1""")
def learn_mse(t):
    v = t.vectors()
    nxt = v.select((F.col("addr") - 1).alias("addr"), F.col("vector").alias("other"))
    return v.join(nxt, "addr").select("addr", F.round(learn.mse(F.col("vector"), F.col("other")), 6).alias("mse"))
