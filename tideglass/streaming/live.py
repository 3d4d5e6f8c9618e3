"""Live games scored as a stream."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from .. import schemas
from ..functions import rules
from ..operators.normalize import live_standing, parse_checked
from ..operators.prematch import LIVE_BLOCK, live_block, with_block
from ..operators.snapshots import FEATURES, features, snapshots_live
from ..operators.upserts import latest_per_key
from ..session import checkpointed
from ..sources.tables import KeyedTable, query_id

Scorer = Callable[[DataFrame], DataFrame]


def baseline_scorer(rows: DataFrame) -> DataFrame:
    """The fixed fallback where no model is active."""
    return rows.withColumns({"p": rules.bounded(rules.baseline_probability(F.col("gold_adv_norm"), F.col("minute"))), "model_version": F.lit("baseline")})


def score_games(games: DataFrame, context: DataFrame, history: DataFrame, scorer: Scorer = baseline_scorer, player_ratings: DataFrame | None = None) -> DataFrame:
    """Feed entries of started games: state, features and prediction; drafting ones are left out.

    context: league_id, tier, valve_tier, is_lan, format. history: team_id, maps. With
    player_ratings the skill block of the sides' accounts is joined, else it is at its defaults.
    """
    s = snapshots_live(games).join(context.select("league_id", "tier", "valve_tier", "is_lan", "format"), "league_id", "left")
    standing = live_standing(F.col("format"))
    s = s.withColumns({c: standing[c] for c in ("game_in_series", "is_conditional_game")})
    for side in ("radiant", "dire"):
        s = s.join(history.select(F.col("team_id").alias(f"{side}_team_id"), F.col("maps").alias(f"{side}_maps")), f"{side}_team_id", "left")
    if player_ratings is not None:
        s = with_live_block(games, s, player_ratings)
    keep = ["match_id", "league_id", "tier", "valve_tier", "stream_delay_s", "radiant_maps", "dire_maps"]
    scored = scorer(features(s, *keep))
    return scored.withColumns({"team_history": rules.notability(F.col("radiant_maps"), F.col("dire_maps")), "tier": rules.display_tier(F.col("valve_tier"), F.col("tier"))})


def prediction_rows(scored: DataFrame) -> DataFrame:
    """Rows of the prediction log; the tier is the one at serving time."""
    pairs = [x for n in FEATURES for x in (F.lit(n), F.col(n))]
    return scored.select("match_id", F.col("minute").cast("int").alias("minute"), F.current_timestamp().alias("predicted_at"), "model_version", F.col("p").alias("p_radiant"), F.create_map(*pairs).alias("features"), "league_id", "valve_tier")


def split_games(games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(games that can be scored, the others with a reason): one bad game does not stop a tick."""
    board, both = F.col("scoreboard"), F.col("scoreboard.radiant").isNotNull() & F.col("scoreboard.dire").isNotNull()
    reason = (
        F.when(F.col("match_id").isNull(), "no match_id").when(F.coalesce(board["duration"], F.lit(0.0)) > 86400, "impossible duration")
        .when(both & ((F.size(board["radiant"]["players"]) > 5) | (F.size(board["dire"]["players"]) > 5)), "more than five players a side")
    )
    marked = games.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def with_live_block(games: DataFrame, scored_input: DataFrame, player_ratings: DataFrame) -> DataFrame:
    """Live states with the skill block of their accounts."""
    return with_block(scored_input, live_block(snapshots_live(games).select("match_id", "radiant_accounts", "dire_accounts"), player_ratings), LIVE_BLOCK)


def each_that_works(games: DataFrame, run: Callable[[DataFrame], DataFrame], key: str = "match_id") -> tuple[list[DataFrame], list[tuple[DataFrame, str]]]:
    """(stored results, games that failed with what was raised): one failing game costs no other.

    ``run`` goes over all games at once; where that fails, over halves of them by key, down to single
    ones. Where not one of several games works, the fault is not theirs and is raised.
    """

    def halves(part: DataFrame) -> tuple[list, list]:
        try:
            return [checkpointed(run(part))], []
        except Exception as e:  # noqa: BLE001  whatever a scorer or a payload raises
            keys = sorted(r[0] for r in part.select(key).distinct().collect())  # a tick's games, or fewer
            if len(keys) == 1:
                return [], [(part, f"{type(e).__name__}: {e}"[:500])]
            middle = F.lit(keys[len(keys) // 2])
            sides = [halves(part.where(c)) for c in (F.col(key) < middle, F.col(key) >= middle)]
            made, failed = sides[0][0] + sides[1][0], sides[0][1] + sides[1][1]
            if not made:
                raise
            return made, failed

    return halves(games)


#: Entries of the feed: what a live board shows of a game.
FEED = "match_id long, league_id long, tier string, valve_tier string, stream_delay_s int, radiant_maps long, dire_maps long, minute double, p double, model_version string, team_history long, captured_at timestamp"
#: Seconds that an entry lives, and that a claim holds.
FEED_SECONDS, CLAIM_SECONDS = 120, 900


def feed_table(spark: SparkSession, out: str) -> KeyedTable:
    return KeyedTable(spark, f"{out}/feed", FEED, ["match_id"], buckets=1)


def store_feed(table: KeyedTable, entries: DataFrame, batch: tuple[str, int] | None = None, ttl_seconds: int = FEED_SECONDS) -> None:
    """The newest entry of each game replaces its last one; stale ones and old versions go, so that neither rows nor files add up.

    An entry that comes late, with an older time than the stored one, does not replace it.
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        newest = latest_per_key(old.unionByName(new), ["match_id"], F.col("captured_at").desc())
        return live_feed(newest, ttl_seconds)

    everything = table.spark.range(1).select(F.col("id").alias("match_id"))  # the one bucket
    table.commit(entries.select(*[c.split()[0] for c in FEED.split(", ")]), merge, batch=batch, touching=everything)
    table.vacuum(keep=3, older_than=ttl_seconds)


def run_live(
    games: DataFrame, context: Callable[[], DataFrame], history: Callable[[], DataFrame], out: str, checkpoint: str, scorer: Scorer = baseline_scorer, every: str | None = "30 seconds",
    player_ratings: Callable[[], DataFrame] | None = None, leagues: KeyedTable | None = None,
) -> StreamingQuery:
    """Every tick: raw boards first, then predictions, then the feed.

    Raw boards, predictions and dead letters of a batch have a folder of its own, which a repeated
    batch overwrites; the feed is one small table, committed last. games: parsed boards, or their texts
    as one column payload, of which those that are no boards become dead letters by themselves. Games that cannot be scored, by
    their shape or because scoring them fails, go to ``dead_letters`` with the reason. leagues: a
    table of leagues (league_id first in its keys) in which unseen ones are registered.
    """
    def tick(batch: DataFrame, batch_id: int) -> None:
        if batch.columns == ["payload"]:
            batch, misshapen = parse_checked(batch.persist(), schemas.LIVE)
        else:
            misshapen = None
        batch = batch.persist()
        batch.select("match_id", F.current_timestamp().alias("captured_at"), F.to_json(F.struct("*")).alias("payload")).write.mode("overwrite").parquet(f"{out}/raw/batch={batch_id}")
        if leagues is not None:
            leagues.insert_absent(batch.where("league_id > 0").select("league_id").distinct())
        good, bad = split_games(batch)
        made, failed = each_that_works(good, lambda g: score_games(g, context(), history(), scorer, player_ratings() if player_ratings else None))
        letter = lambda df: df.select("match_id", "reason", F.to_json(F.struct("*")).alias("payload"))
        letters = [] if misshapen is None else [misshapen.select("match_id", "reason", "payload")]
        letters += [letter(bad), *[letter(g.withColumn("reason", F.lit(e))) for g, e in failed]]
        reduce(DataFrame.unionByName, letters).write.mode("overwrite").parquet(f"{out}/dead_letters/batch={batch_id}")
        scored = reduce(DataFrame.unionByName, made)
        prediction_rows(scored).write.mode("overwrite").parquet(f"{out}/predictions/batch={batch_id}")
        store_feed(feed_table(batch.sparkSession, out), scored.withColumn("captured_at", F.current_timestamp()), (query_id(batch, checkpoint), batch_id))
        batch.unpersist()

    writer = games.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_feed(spark: SparkSession, out: str, ttl_seconds: int = FEED_SECONDS) -> DataFrame:
    """The entries of the last tick's version that are not yet stale."""
    return live_feed(feed_table(spark, out).read(), ttl_seconds)


def live_feed(feed: DataFrame, ttl_seconds: int = FEED_SECONDS) -> DataFrame:
    """Entries that are not yet stale."""
    return feed.where(F.col("captured_at") > F.current_timestamp() - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def first_per_minute(predictions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of predictions without repeated polls of a minute."""
    return predictions.withWatermark("predicted_at", delay).dropDuplicatesWithinWatermark(["match_id", "minute", "model_version"])


def finished(predictions: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """A stream of matches that had no prediction for ten minutes."""
    return predictions.withWatermark("predicted_at", gap).groupBy("match_id", F.session_window("predicted_at", gap)).agg(F.count(F.lit(1)).alias("n")).select("match_id", "session_window.start", "session_window.end", "n")


class _Claims(StatefulProcessor):
    """One claim a key and, within it, one request: until when, kept as a value that expires by itself."""

    def __init__(self, seconds: int):
        self.milliseconds = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", _UNTIL, self.milliseconds)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        at = np.sort(np.concatenate([f["requested_at"].astype("datetime64[ms]").astype(np.int64).to_numpy() for f in rows]))  # all frames, so that the first request claims
        held = self.until.get()
        until, claims = held[0] if held else -1, []
        k = int(np.searchsorted(at, until))
        while k < len(at):
            claims.append(int(at[k]))
            until = claims[-1] + self.milliseconds
            k = int(np.searchsorted(at, until))
        if claims:
            self.until.update((until,))
            yield pd.DataFrame({"key": [key[0]] * len(claims), "claimed_ms": claims})

    def close(self) -> None:
        pass


_UNTIL = StructType([StructField("until", LongType())])


def throttled(requests: DataFrame, key: str = "league_id", seconds: int = CLAIM_SECONDS) -> DataFrame:
    """At most one request a key in ``seconds``: the first claims it, later ones fall.

    requests: a stream with ``key`` (long) and requested_at. The key is the job's id, so at most one
    request of a job is queued. A claim expires from the state store ``seconds`` after it was made;
    the session needs the RocksDB state store (``session.build_session`` sets it).
    """
    keyed = requests.where(F.col("requested_at").isNotNull()).select(F.col(key).alias("key"), F.col("requested_at").cast("timestamp").alias("requested_at"))
    return keyed.groupBy("key").transformWithStateInPandas(_Claims(seconds), "key long, claimed_ms long", "append", "ProcessingTime")


def publish(scored: DataFrame) -> DataFrame:
    """key, value rows for a message sink."""
    return scored.select(F.col("match_id").cast("string").alias("key"), F.to_json(F.struct("match_id", "minute", "p", "model_version")).alias("value"))
