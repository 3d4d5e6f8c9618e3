"""Domain rules as Column functions: tiers, formats, outcomes, buckets, priors, time, clamps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier words and their order.
PRO_TIERS = ("professional", "premium")
EXCLUDED_TIERS = ("excluded", "amateur")
SEGMENTS = ("tier1", "pro", "excluded")
# Formats, the most maps each has, and the maps each always has.
MAX_GAMES = {"bo1": 1, "bo2": 2, "bo3": 3, "bo5": 5}
SURE_GAMES = {"bo1": 1, "bo2": 2, "bo3": 2, "bo5": 3}
# Game-time buckets by first minute.
BUCKETS = ((0, "0-4"), (5, "5-9"), (10, "10-14"), (15, "15-19"), (20, "20-24"), (25, "25-29"), (30, "30+"))
# Constants of the rating prior, the served range, decay and weights.
SKILL_TO_LOGIT, RADIANT_BIAS, ESTABLISHED_GAMES = 0.12, 0.055, 20
SERVED_LOW, SERVED_HIGH = 0.01, 0.99
FORM_HALF_LIFE_DAYS, WEIGHT_HALF_LIFE_DAYS = 30.0, 180.0
TIER_WEIGHTS = {"tier1": 1.0, "tier2": 0.6, "tier3": 0.3}
BASELINE_Z = (0.067223, 0.005293, -0.003425)


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed table as CASE."""
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def none_if_zero(c: Column) -> Column:
    """Ids of 0 mean no id."""
    return F.nullif(c, F.lit(0).cast("long"))


def utc(seconds: Column) -> Column:
    """Epoch seconds to a timestamp."""
    return F.timestamp_seconds(seconds)


def short_key(c: Column) -> Column:
    """Any key as text of at most 64 characters."""
    return F.substring(c.cast("string"), 1, 64)


def display_tier(valve: Column, wiki: Column) -> Column:
    """The tier that readers see."""
    known = F.coalesce(F.nullif(wiki, F.lit("")), F.lit("unknown"))
    return F.when((known == "unknown") & (valve == "premium"), "tier1").otherwise(known)


def is_pro(valve: Column) -> Column:
    return F.coalesce(valve.isin(*PRO_TIERS), F.lit(False))


def segment(valve: Column, wiki: Column) -> Column:
    """tier1, pro, excluded, or null where the valve tier is unknown."""
    top = is_pro(valve) & (display_tier(valve, wiki) == "tier1")
    return F.when(top, "tier1").when(is_pro(valve), "pro").when(valve.isin(*EXCLUDED_TIERS), "excluded")


def bucket_first(minute: Column) -> Column:
    """First minute of the bucket: sorts in clock order."""
    return F.least(F.floor(minute / 5) * 5, F.lit(30)).cast("int")


def bucket(minute: Column) -> Column:
    """Label of the game-minute bucket; negative minutes are an error."""
    return F.when(minute < 0, F.raise_error(F.lit("minute is negative")).cast("string")).otherwise(lookup(bucket_first(minute), dict(BUCKETS)))


def conditional_game(fmt: Column, game: Column) -> Column:
    """Was this map played only because of the score."""
    return game > lookup(fmt, SURE_GAMES)


def resolve_format(override: Column, stage: Column, valve_type: Column) -> Column:
    """Override, else stage, else the valve hint, else bo1."""
    return F.coalesce(override, stage, lookup(valve_type, {0: "bo1", 1: "bo3", 2: "bo5"}), F.lit("bo1"))


def series_outcome(fmt: Column, a: Column, b: Column) -> Column:
    """struct(winner_is_a, is_draw, is_decided); only bo2 draws."""
    two, need = fmt == "bo2", F.floor(lookup(fmt, MAX_GAMES) / 2) + 1
    over = F.when(two, a + b >= 2).otherwise((a >= need) | (b >= need))
    draw = two & over & (a == b)
    winner = F.when(over & ~draw, F.when(two, a > b).otherwise(a >= need))
    return F.struct(winner.alias("winner_is_a"), draw.alias("is_draw"), over.alias("is_decided"))


def bo2_probabilities(p: Column) -> Column:
    """struct(p20, p11, p02) for independent maps; out of range is an error."""
    sure = F.when((p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.lit("p must be in [0, 1]")).cast("double"))
    return F.struct((sure * sure).alias("p20"), (2 * sure * (1 - sure)).alias("p11"), ((1 - sure) * (1 - sure)).alias("p02"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def sigmoid(z: Column, limit: float = 35.0) -> Column:
    return 1 / (1 + F.exp(-clamp(z, -limit, limit)))


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def bounded(p: Column) -> Column:
    """The served range."""
    return clamp(p, SERVED_LOW, SERVED_HIGH)


def conservative(mu: Column, sigma: Column) -> Column:
    return mu - 3 * sigma


def prior_from_skill(mu_r: Column, sigma_r: Column, mu_d: Column, sigma_d: Column) -> Column:
    """Win probability from two team skills."""
    return sigmoid(F.lit(RADIANT_BIAS) + SKILL_TO_LOGIT * (conservative(mu_r, sigma_r) - conservative(mu_d, sigma_d)), 20.0)


def baseline_probability(gold_norm: Column, minute: Column) -> Column:
    """The fixed fallback predictor."""
    a, b, c = BASELINE_Z
    return sigmoid(F.lit(a) + b * gold_norm + c * minute, 20.0)


def decay(seconds: Column, half_life_days: float = FORM_HALF_LIFE_DAYS) -> Column:
    return F.pow(F.lit(0.5), seconds / (86400.0 * half_life_days))


def sample_weight(tier: Column, age_days: Column) -> Column:
    """Tier weight (unknown counts 1) times age decay."""
    return lookup(tier, TIER_WEIGHTS, 1.0) * F.exp(F.lit(-math.log(2) / WEIGHT_HALF_LIFE_DAYS) * age_days)


def row_log_loss(won: Column, p: Column) -> Column:
    """M01, clamped at 1e-15."""
    q = clamp(p, 1e-15, 1 - 1e-15)
    return -F.log(F.when(won, q).otherwise(1 - q))


def row_brier(won: Column, p: Column) -> Column:
    return F.pow(p - won.cast("double"), F.lit(2.0))


def row_hit(won: Column, p: Column) -> Column:
    return ((p >= 0.5) == won).cast("double")


def noise_floor(matches: Column) -> Column:
    """How far calibration error moves by chance."""
    return F.when(matches >= 1, 0.077 * F.sqrt(85.0 / matches)).otherwise(F.raise_error(F.lit("no matches")).cast("double"))


def tournament_status(last: Column, now: Column, live: Column) -> Column:
    """current or past (F18): live, or the last map at most 30 hours ago."""
    age = now.cast("timestamp").cast("double") - last.cast("timestamp").cast("double")
    return F.when(live, "current").when(age.between(0, 30 * 3600), "current").otherwise("past")


def settled(a: Column, b: Column, last: Column, now: Column) -> Column:
    """Unequal score and no map for 12 hours."""
    age = now.cast("timestamp").cast("double") - last.cast("timestamp").cast("double")
    return (a != b) & F.coalesce(age >= 12 * 3600, F.lit(False))


def notability(radiant: Column, dire: Column) -> Column:
    return F.least(F.coalesce(radiant, F.lit(0)), F.coalesce(dire, F.lit(0)))


def eta_hours(remaining: Column, per_hour: float) -> Column:
    return remaining / F.lit(float(per_hour))


def slice_timeout(maps: Column) -> Column:
    """Seconds a fetch slice may take: two each, half as much again."""
    return maps * 2.0 * 1.5


def at_minute(series: Column, minute: Column, shift: int = 0) -> Column:
    """Array value at a minute, clamped to the last one; an empty array gives 0."""
    return F.coalesce(F.get(series, F.least(minute + shift, F.size(series) - 1)), F.lit(0))


def count_until(times: Column, last_second: Column) -> Column:
    """How many event times are at or before a second."""
    return F.size(F.filter(F.coalesce(times, F.array().cast("array<int>")), lambda t: t <= last_second))


def game_minute(time: Column) -> Column:
    """Minute of an event; before the horn counts as 0."""
    return F.floor(F.greatest(time, F.lit(0)) / 60).cast("int")


def mask_bits(mask: Column, first: int, bits: int) -> Column:
    return F.bit_count(F.shiftright(mask, first).bitwiseAND(F.lit((1 << bits) - 1)))


def towers_of_mask(mask: Column) -> Column:
    """Towers standing: three lanes of three, then two at the base."""
    return mask_bits(mask, 0, 11)


def barracks_of_mask(mask: Column) -> Column:
    return mask_bits(mask, 0, 6)


# Fixed value: shape of a building's name; "good" is radiant.
BUILDING = r"^npc_dota_(goodguys|badguys)_(tower[1-4]|melee_rax|range_rax|fort)(?:_(top|mid|bot))?$"


def building(key: Column) -> Column:
    """struct(is_radiant, kind, lane) of a building name, null if it is none."""
    side, what, lane = (F.regexp_extract(key, BUILDING, i) for i in (1, 2, 3))
    kind = F.when(what.startswith("tower"), "tower").when(what == "fort", "ancient").otherwise("barracks")
    place = F.coalesce(F.nullif(lane, F.lit("")), F.lit("base"))
    return F.when(side != "", F.struct((side == "goodguys").alias("is_radiant"), kind.alias("kind"), place.alias("lane")))


def building_of_npc(npc: Column) -> Column:
    """The same struct for a building id; ids beside the ranges are no buildings.

    Nine lane towers from 16 (radiant) and 26 (dire), lane by lane within a tier, each followed
    by the base towers' id; six barracks from 38 and 44; the ancients are 50 and 51.
    """
    lane = lambda first: F.get(F.array(*map(F.lit, ("top", "mid", "bot"))), ((npc - first) % 3).cast("int"))
    made = lambda radiant, kind, where: F.struct(F.lit(radiant).alias("is_radiant"), F.lit(kind).alias("kind"), where.alias("lane"))
    base = F.lit("base")
    return (
        F.when(npc.between(16, 24), made(True, "tower", lane(16))).when(npc == 25, made(True, "tower", base))
        .when(npc.between(26, 34), made(False, "tower", lane(26))).when(npc == 35, made(False, "tower", base))
        .when(npc.between(38, 43), made(True, "barracks", lane(38))).when(npc.between(44, 49), made(False, "barracks", lane(44)))
        .when(npc == 50, made(True, "ancient", base)).when(npc == 51, made(False, "ancient", base))
    )


def npc_building_name(npc: Column) -> Column:
    """The building's name as the other source spells it."""
    b = building_of_npc(npc)
    side = F.when(b["is_radiant"], "goodguys").otherwise("badguys")
    tier = (F.floor((npc - F.when(b["is_radiant"], 16).otherwise(26)) / 3) + 1).cast("string")
    melee = npc - F.when(b["is_radiant"], 38).otherwise(44) < 3
    what = (
        F.when(b["kind"] == "ancient", "fort").when(b["lane"] == "base", "tower4")
        .when(b["kind"] == "tower", F.concat(F.lit("tower"), tier, F.lit("_"), b["lane"]))
        .otherwise(F.concat(F.when(melee, "melee").otherwise("range"), F.lit("_rax_"), b["lane"]))
    )
    return F.when(b.isNotNull(), F.concat(F.lit("npc_dota_"), side, F.lit("_"), what))


# Leaver words on the numeric scale, lanes, and message kinds shown on a card.
LEAVER = {"NONE": 0, "DISCONNECTED": 1, "DISCONNECTED_TOO_LONG": 2, "ABANDONED": 3, "AFK": 4, "NEVER_CONNECTED": 5, "NEVER_CONNECTED_TOO_LONG": 6}
LANES = {"SAFE_LANE": 1, "MID_LANE": 2, "OFF_LANE": 3, "JUNGLE": 4}
CHAT_KINDS = {
    "CHAT_MESSAGE_ROSHAN_KILL": "roshan", "CHAT_MESSAGE_AEGIS": "aegis", "CHAT_MESSAGE_AEGIS_STOLEN": "aegis",
    "CHAT_MESSAGE_DENIED_AEGIS": "aegis", "CHAT_MESSAGE_FIRSTBLOOD": "first_blood", "CHAT_MESSAGE_MINIBOSS_KILL": "tormentor",
}


def leaver_value(raw: Column) -> Column:
    """Number, word, or nothing: an unknown word counts 0."""
    return F.coalesce(raw.try_cast("int"), lookup(raw, LEAVER), F.lit(0))


def timeline_kind(type_: Column, key: Column) -> Column:
    """What a card shows for an objective; null drops it (F32)."""
    return F.when(type_ == "building_kill", building(key)["kind"]).otherwise(lookup(type_, CHAT_KINDS))


# The reasons as they are reported.
TOO_SHORT, INCOMPLETE, ABANDONED, NO_TEAM = "shorter than 12 minutes", "incomplete roster", "somebody abandoned", "a side has no team"


def ineligible_reason(duration: Column, players: Column, radiant_team: Column, dire_team: Column) -> Column:
    """Why a map is no training data; the first reason wins, null means it is."""
    return (
        F.when(F.coalesce(duration, F.lit(0)) < 720, TOO_SHORT)
        .when(F.coalesce(F.size(players), F.lit(0)) < 10, INCOMPLETE)
        .when(F.exists(players, lambda p: leaver_value(p["leaverStatus"]) >= 2), ABANDONED)
        .when((F.coalesce(radiant_team, F.lit(0)) == 0) | (F.coalesce(dire_team, F.lit(0)) == 0), NO_TEAM)
    )


#: Fixed value: credentials in URLs.
SECRET = r"([?&])(access_token|api_key|token|key)=[^&\s'\"]+"


def redact(text: Column) -> Column:
    """Credentials in URLs blanked."""
    return F.regexp_replace(text, SECRET, "$1$2=***")


def model_version(now: Column, prefix: str = "lgbm") -> Column:
    return F.concat(F.lit(prefix + "-"), F.date_format(now, "yyyyMMdd-HHmmss"))
