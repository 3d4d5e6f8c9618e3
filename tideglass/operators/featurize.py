"""Stored payloads to training rows: eligible maps, minute states, series context, pre-match block.

A payload whose match is not in ``matches`` yet is left out: it would have no parent row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import number_games, series_wins_before
from .prematch import with_block
from .snapshots import FEATURES, eligible, features, snapshots_b
from .upserts import replace_rows


def series_context(matches: DataFrame, series: DataFrame, leagues: DataFrame) -> DataFrame:
    """Facts of each map's series as they stood before it.

    The score comes from earlier maps and belongs to teams; the stored score of a series is final
    and would tell the result. What is not known stays null and is made neutral by the features.
    """
    m = matches if "game" in matches.columns else number_games(matches)
    wins = series_wins_before(m)
    s = series.select("series_id", "format")
    lan = leagues.select("league_id", "is_lan")
    out = m.select("match_id", "series_id", "league_id", "game", *[c for c in ("is_conditional_game",) if c in m.columns])
    out = out.join(s, "series_id", "left").join(lan, "league_id", "left").join(wins, "match_id", "left")
    conditional = F.col("is_conditional_game") if "is_conditional_game" in m.columns else F.lit(None).cast("boolean")
    return out.select(
        "match_id", "format", "is_lan", F.coalesce("game", F.lit(1)).alias("game_in_series"), conditional.alias("is_conditional_game"),
        F.coalesce("radiant_series_wins", F.lit(0)).alias("radiant_series_wins"), F.coalesce("dire_series_wins", F.lit(0)).alias("dire_series_wins"),
    )


def featurize(details: DataFrame, matches: DataFrame, series: DataFrame, leagues: DataFrame, prematch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(match_id, minute, radiant_win and the 28 features; payloads by skip reason).

    details: columns of schemas.DETAIL_B. prematch: match_id, the eight features, prematch_prior.
    """
    usable, skipped = eligible(details, matches.select(F.col("match_id").alias("id")))
    states = snapshots_b(usable).join(series_context(matches, series, leagues), "match_id", "left")
    rows = features(with_block(states, prematch), "match_id", "radiant_win")
    return rows.select("match_id", F.col("minute").cast("int").alias("minute"), "radiant_win", *[c for c in FEATURES if c != "minute"]), skipped


def store(old: DataFrame, new: DataFrame, rebuild: bool = False) -> DataFrame:
    """The table after a run: rows of (match_id, minute) are replaced, and a rebuild keeps no old row.

    Without a rebuild, rows of maps that are no longer eligible stay beside the new ones.
    """
    return new.select(*old.columns) if rebuild else replace_rows(old, new, ["match_id", "minute"])
