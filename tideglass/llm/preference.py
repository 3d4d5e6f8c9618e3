"""Preference pairs: one prompt from the turns that two conversations share, two completions.

The longest common turn prefix of the chosen and the rejected conversation (equal role and
equal text, turn by turn) is rendered once as the prompt. What follows in each is its
completion, with a mask of spans: characters of assistant turns are trained on, all others are
not.

Turns are rendered as ``<|role|>\\ntext\\n``; ``mask`` holds [start, end) character offsets in the
completion of the text and the closing line break of every assistant turn.

Defined results: turns are ordered by turn number (nulls first), then role, then text; a null
role or text is rendered as empty, and equals only another null; a pair without a common turn
has an empty prompt; if one conversation is a prefix of the other its completion is empty and
has no spans; a conversation without partner gives no row; repeated rows are repeated turns;
turns with equal number, role and text are told apart by nothing and stand side by side; long
turns are rendered whole; other columns are ignored. Turn texts are rendered as they are: one
that contains ``<|role|>`` looks like a header, and only the masks tell it from a real one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _ordered(turns: DataFrame, key: str) -> DataFrame:
    item = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_id")).agg(F.array_sort(F.collect_list(item)).alias("turns"))


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns are equal."""
    both = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), F.greatest(both - 1, F.lit(0))), lambda i: (i < both) & ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.coalesce(F.get(differ, F.lit(0)), both)


def _open(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"))


def _close(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_open(t), _close(t))), "")


def trained_spans(turns: Column) -> Column:
    """[start, end) of what is trained on in ``render(turns)``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        first = state["at"] + F.length(_open(t))
        last = first + F.length(_close(t))
        spans = F.when(t["role"].eqNullSafe(F.lit(TRAINED_ROLE)), F.concat(state["spans"], F.array(F.struct(first.alias("start"), last.alias("end"))))).otherwise(state["spans"])
        return F.struct(last.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row per pair: pair_id, prompt, chosen, rejected and the two masks.

    chosen, rejected: (key, turn, role, text), one row per turn.
    """
    a = _ordered(chosen, key).select("pair_id", _plain(F.col("turns")).alias("a"))
    b = _ordered(rejected, key).select(F.col("pair_id").alias("other"), _plain(F.col("turns")).alias("b"))
    both = a.join(b, F.col("pair_id") == F.col("other")).withColumn("n_shared_turns", common_prefix(F.col("a"), F.col("b")))
    after = F.col("n_shared_turns") + 1
    rest = both.select(
        "pair_id", "n_shared_turns", F.slice("a", F.lit(1), F.col("n_shared_turns")).alias("head"),
        F.slice("a", after, F.greatest(F.size("a"), F.lit(0))).alias("a"), F.slice("b", after, F.greatest(F.size("b"), F.lit(0))).alias("b"),
    )
    return rest.select(
        "pair_id", "n_shared_turns", render(F.col("head")).alias("prompt"),
        render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"),
        trained_spans(F.col("a")).alias("chosen_mask"), trained_spans(F.col("b")).alias("rejected_mask"),
    )


def adjacent_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's pairs: conversation 2k is the chosen one, 2k + 1 the rejected one, of pair k."""
    keyed = conversations.withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long"))
    side = F.col("conv_id") - 2 * F.col("pair_id")
    return keyed.where(side == 0), keyed.where(side == 1)
