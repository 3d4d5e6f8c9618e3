"""Results that arrive later: which maps to ask for, and what their payloads fill in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import details
from .upserts import fill_gaps

# Sources of results in the order of preference.
SOURCES = ("stratz_match", "opendota_match")


def outcome_source(training_source_available: bool) -> str:
    """The training source where it answers, since its payload also makes a map trainable; else the other."""
    return SOURCES[0] if training_source_available else SOURCES[1]


def to_fetch(wanted: DataFrame, raw: DataFrame, source: str, limit: int, newest_first: bool = True) -> DataFrame:
    """Ids of ``wanted`` (match_id) without a payload of ``source``, at most ``limit``: one job's top-k."""
    held = raw.where(F.col("source") == source).select("match_id")
    order = F.col("match_id").desc() if newest_first else F.col("match_id").asc()
    return wanted.select("match_id").distinct().join(held, "match_id", "left_anti").orderBy(order).limit(limit)


def resolve(matches: DataFrame, unresolved: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches with results of fetched payloads filled in, ids that stay unresolved).

    Known values stay: a payload fills gaps only. Maps that the table lacks are added.
    """
    wanted = unresolved.select("match_id").distinct()
    found = details(raw.join(wanted, "match_id", "left_semi"))["matches"]
    columns = [c for c in found.columns if c in matches.columns]
    types = {f.name: f.dataType for f in matches.schema}
    new = found.select(*[F.col(c).cast(types[c]).alias(c) for c in columns])
    resolved = fill_gaps(matches, new, ["match_id"])
    left = wanted.join(resolved.where("radiant_win IS NOT NULL").select("match_id"), "match_id", "left_anti")
    return resolved, left


def map_score(is_live: Column, live: Column, roster: Column) -> Column:
    """{radiant, dire} kills of a map.

    live, roster: structs of these two fields, null where there is none. While a map runs the
    scoreboard is newer; of a finished one it is a snapshot of mid-game, and the rosters are right.
    """
    return F.coalesce(F.when(is_live, live), roster, live)


def roster_kills(match_players: DataFrame) -> DataFrame:
    """match_id, roster {radiant, dire}: summed kills of the players."""
    side = lambda r: F.coalesce(F.sum(F.when(F.col("is_radiant") == r, F.col("kills"))), F.lit(0)).cast("int")
    return match_players.groupBy("match_id").agg(F.struct(side(True).alias("radiant"), side(False).alias("dire")).alias("roster"))
