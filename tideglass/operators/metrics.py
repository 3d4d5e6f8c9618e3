"""Scores of predictions: log loss, Brier, accuracy, reliability, calibration error, bootstrap, drift (M*)."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..session import checkpointed

# Resamples, seed and bounds of the bootstrap; sizes of the drift check.
RESAMPLES, SEED, LOW, HIGH = 500, 20260901, 0.10, 0.90
RECENT_DAYS, MIN_MATCHES, MIN_RISE = 7, 40, 0.02


def score_columns() -> list[Column]:
    """Aggregates over (radiant_win, p): null on no rows, never 0."""
    won, p = F.col("radiant_win"), F.col("p")
    return [F.avg(rules.row_log_loss(won, p)).alias("log_loss"), F.avg(rules.row_brier(won, p)).alias("brier"), F.avg(rules.row_hit(won, p)).alias("accuracy"), F.count(F.lit(1)).alias("n"), F.count_distinct("match_id").alias("matches")]


def by_bucket(scored: DataFrame, *keys: str) -> DataFrame:
    """Scores by game-minute bucket, in clock order by bucket_first."""
    return scored.groupBy(*keys, rules.bucket(F.col("minute")).alias("bucket"), rules.bucket_first(F.col("minute")).alias("bucket_first")).agg(*score_columns())


def reliability(scored: DataFrame, *keys: str, bins: int = 10) -> DataFrame:
    """Mean prediction, share won and rows of each tenth."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(*keys, at.alias("bin")).agg(F.avg("p").alias("predicted"), F.avg(F.col("radiant_win").cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


def _bin_gaps(bins: int = 10) -> list[Column]:
    """Sum of outcome less prediction in each bin; its size is the bin's rows times its gap."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return [F.coalesce(F.sum(F.when(at == i, F.col("radiant_win").cast("double") - F.col("p"))), F.lit(0.0)).alias(f"gap_{i}") for i in range(bins)]


def _ece(bins: int = 10) -> Column:
    return sum((F.abs(F.col(f"gap_{i}")) for i in range(bins)), F.lit(0.0)) / F.col("n")


def calibration_error(scored: DataFrame, *keys: str) -> DataFrame:
    """Expected calibration error, with the bins as columns of one aggregate."""
    sums = scored.groupBy(*keys).agg(*_bin_gaps(), F.count(F.lit(1)).alias("n"))
    return sums.select(*keys, _ece().alias("ece"))


def percentile(values: Column, fraction: float) -> Column:
    """The value at index int(fraction * n) of the sorted array, at most the last."""
    return F.get(F.array_sort(values), F.least(F.floor(fraction * F.size(values)).cast("int"), F.size(values) - 1))


def _match_sums(scored: DataFrame) -> DataFrame:
    gap = rules.row_log_loss(F.col("radiant_win"), F.col("p")) - rules.row_log_loss(F.col("radiant_win"), F.col("baseline"))
    sums = scored.withColumn("bucket", rules.bucket(F.col("minute"))).groupBy("match_id", "baseline_name", "bucket")
    return sums.agg(F.min("start_time").alias("start_time"), F.sum(gap).alias("gap"), F.count(F.lit(1)).alias("n"))


def _judged(found: DataFrame) -> DataFrame:
    """margin and verdict from the interval."""
    verdict = F.when(F.col("high") < 0, "better").when(F.col("low") > 0, "worse").otherwise("tied")
    return found.select("baseline_name", "bucket", "difference", "low", "high", ((F.col("high") - F.col("low")) / 2).alias("margin"), verdict.alias("verdict"), "matches")


#: Poisson(1) counts by the uniform value below which they lie; a count over 12 has probability 2e-11.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])


def poisson_weights(match_ids: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """How often each resample draws each match: Poisson(1), a function of (match, resample, seed) alone."""
    x = match_ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    uniform = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, uniform.ravel(), "right").reshape(uniform.shape).astype(np.float64)


_RESAMPLED = "baseline_name string, bucket string, resample int, gap double, n double"


def paired_differences(scored: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Block bootstrap by match of the difference of log losses to a baseline.

    scored: match_id, start_time, minute, radiant_win, p, baseline, baseline_name. Every resample
    draws each match a Poisson(1) number of times, from a hash of match, resample and seed. So no
    group is gathered: partitions of any size add up their own matches' weighted sums, and only
    one row for each (baseline, bucket, resample) and task is shuffled.
    Returns baseline_name, bucket, difference, low, high, margin, verdict, matches.
    """
    sums = checkpointed(_match_sums(scored))
    per_match = sums.groupBy("match_id").agg(F.collect_list(F.struct("baseline_name", "bucket", "gap", "n")).alias("parts"))  # at most buckets x baselines

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                weights = poisson_weights(piece["match_id"].to_numpy(), resamples, seed)
                rows: dict[tuple[str, str], list] = {}
                for i, parts in enumerate(piece["parts"].to_pylist()):
                    for x in parts:
                        rows.setdefault((x["baseline_name"], x["bucket"]), []).append((i, x["gap"], x["n"]))
                for key, found in rows.items():
                    index, values = np.array([r[0] for r in found]), np.array([r[1:] for r in found], float)
                    total[key] = total.get(key, 0.0) + weights[index].T @ values
        for (name, bucket), x in total.items():
            columns = [[name] * resamples, [bucket] * resamples, np.arange(resamples, dtype=np.int32), x[:, 0], x[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["baseline_name", "bucket", "resample", "gap", "n"])

    drawn = per_match.mapInArrow(add_up, _RESAMPLED).groupBy("baseline_name", "bucket", "resample").agg((F.sum("gap") / F.sum("n")).alias("mean"))
    means = drawn.where("mean IS NOT NULL AND NOT isnan(mean)").groupBy("baseline_name", "bucket").agg(F.collect_list("mean").alias("means"))
    bounds = means.select(F.col("baseline_name").alias("of"), F.col("bucket").alias("at"), percentile(F.col("means"), LOW).alias("low"), percentile(F.col("means"), HIGH).alias("high"))
    plain = sums.groupBy("baseline_name", "bucket").agg((F.sum("gap") / F.sum("n")).alias("difference"), F.count(F.lit(1)).alias("matches"))
    return _judged(plain.join(F.broadcast(bounds), (F.col("baseline_name") == F.col("of")) & (F.col("bucket") == F.col("at"))))  # one row a (baseline, bucket)


def paired_differences_seeded(scored: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """The same from the draws of ``random.Random(seed:name:bucket).choices`` over the matches in time order.

    For reports that must repeat such draws exactly: these are one sequence over all matches of a
    (baseline, bucket), so each of these groups is one task's work. ``paired_differences`` is not so
    bound.
    """
    sums = _match_sums(scored)

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_time", "match_id"])
        name, bucket = pdf["baseline_name"].iloc[0], pdf["bucket"].iloc[0]
        gaps, rows, n = pdf["gap"].to_numpy(float), pdf["n"].to_numpy(float), len(pdf)
        # the draws of random.Random(...).choices, taken from the same generator state in bulk
        state = random.Random(f"{seed}:{name}:{bucket}").getstate()[1]
        draws = np.random.RandomState()
        draws.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
        means = []
        for _ in range(resamples):
            at = (draws.random_sample(n) * n).astype(np.int64)
            means.append(float(gaps[at].sum() / rows[at].sum()))
        means.sort()
        low, high = (means[min(int(f * len(means)), len(means) - 1)] for f in (LOW, HIGH))
        return pd.DataFrame([(name, bucket, pdf["gap"].sum() / pdf["n"].sum(), low, high, len(pdf))], columns=["baseline_name", "bucket", "difference", "low", "high", "matches"])

    return _judged(sums.groupBy("baseline_name", "bucket").applyInPandas(resample, "baseline_name string, bucket string, difference double, low double, high double, matches long"))


def gate(differences: DataFrame) -> DataFrame:
    """One row: failures, ties, passes."""
    return differences.agg(F.count_if(F.col("verdict") == "worse").alias("failures"), F.count_if(F.col("verdict") == "tied").alias("ties")).withColumn("passes", F.col("failures") == 0)


def drift(scored: DataFrame, now: str, keys: tuple[str, ...] = ("model_version", "segment")) -> DataFrame:
    """Recent calibration error against everything before, by ``keys``.

    now: a timestamp literal. Rows with a null key (no known segment) are not judged. threshold, verdict: null and 'not enough data' where a window is too small.
    """
    recent = F.col("predicted_at") >= F.expr(f"timestamp_ntz'{now}' - INTERVAL {RECENT_DAYS} DAYS")
    marked = scored.dropna(subset=list(keys)).withColumn("recent", recent)
    both = marked.groupBy(*keys, "recent").agg(*_bin_gaps(), F.count(F.lit(1)).alias("n"), F.count_distinct("match_id").alias("matches")).withColumn("ece", _ece())
    pick = lambda c, r: F.max(F.when(F.col("recent") == r, F.col(c)))
    wide = both.groupBy(*keys).agg(*[pick(c, r).alias(f"{'recent' if r else 'earlier'}_{c}") for r in (True, False) for c in ("ece", "matches", "n")])
    least = F.least(F.coalesce("recent_matches", F.lit(0)), F.coalesce("earlier_matches", F.lit(0)))
    enough = least >= MIN_MATCHES
    wide = wide.withColumn("threshold", F.when(enough, F.greatest(rules.noise_floor(least), F.lit(MIN_RISE)))).withColumn("rise", F.when(enough, F.col("recent_ece") - F.col("earlier_ece")))
    return wide.withColumn("verdict", F.when(~enough, "not enough data").when(F.col("rise") > F.col("threshold"), "drifting").when(F.col("rise") < -F.col("threshold"), "improving").otherwise("ok"))


def report(bucket_scores: DataFrame) -> DataFrame:
    """One line of text a bucket."""
    return bucket_scores.orderBy("bucket_first").select(F.format_string("%-6s log loss %.4f  brier %.4f  accuracy %.3f  n %d", "bucket", "log_loss", "brier", "accuracy", "n").alias("line"))
