"""Runs that fetch, store and remember how far they came, in one commit each.

The raw table holds whole payloads by (match_id, source). What a run has fetched becomes visible
together with the cursors that say so, so a run that is cut short anywhere repeats its last piece and
loses nothing. A source has two cursors, the least and the greatest id of one range without gaps:
``backfill`` moves the lower end down a page at a time, ``catch_up`` the upper end up in one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize, upserts
from ..session import checkpointed
from .tables import KeyedTable, Snapshot, query_id

RAW = "match_id long, source string, fetched_at timestamp, payload string"


def raw_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, RAW, ["match_id", "source"], buckets=buckets)


def _raw(rows: DataFrame, source: str) -> DataFrame:
    """Fetched rows (id, payload, status) as raw rows; an id that stands twice has one of its payloads."""
    found = rows.where("status = 'ok'").select(F.col("id").cast("long").alias("match_id"), F.lit(source).alias("source"), F.current_timestamp().alias("fetched_at"), "payload")
    return checkpointed(upserts.latest_per_key(found.where("match_id IS NOT NULL"), ["match_id", "source"], F.col("payload")))  # asked for once, however often it is read


def reach(table: KeyedTable, source: str) -> tuple[int | None, int | None]:
    """Least and greatest id of the range that is stored, None before the first commit."""
    at = table.snapshot().cursors
    return tuple(int(at[k]) if k in at else None for k in (f"{source}:least", f"{source}:most"))


def _store(table: KeyedTable, rows: DataFrame, source: str, batch: tuple[str, int] | None) -> Snapshot:
    raw = _raw(rows, source)
    least, most = raw.agg(F.min("match_id"), F.max("match_id")).first()

    def moved(old: dict[str, str]) -> dict[str, str]:
        if least is None:
            return {}
        a, b = f"{source}:least", f"{source}:most"
        return {a: str(min(least, int(old.get(a, least)))), b: str(max(most, int(old.get(b, most))))}

    return table.replace(raw, batch=batch, cursors=moved)


def backfill(table: KeyedTable, source: str, url: str, cursor: str, checkpoint: str, every: str | None = None, **options: str) -> StreamingQuery:
    """Pages backwards from the stored lower end (or the newest), one a micro-batch, until a page is empty.

    A restart on the same ``checkpoint`` asks for the pages that were not committed; a lost one starts
    at the stored cursor. Runs are told apart by the checkpoint's own id, so batch numbers of a
    new one never pass for old ones.
    """
    spark = table.spark
    least, most = reach(table, source)
    if least is not None:
        options |= {"start": str(least), "most": str(most)}
    pages = spark.readStream.format("json_api").options(url=url, cursor=cursor, **options).load()

    def store(batch: DataFrame, batch_id: int) -> None:
        _store(table, batch, source, (f"{source}:{query_id(batch, checkpoint)}", batch_id))

    writer = pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def catch_up(table: KeyedTable, source: str, url: str, cursor: str, **options: str) -> int:
    """Rows that are newer than the stored range, in one commit (K21); returns how many ids are new.

    The upper end moves only when every page down to it is there. Before any backfill there is no range to catch up with.
    """
    _, most = reach(table, source)
    if most is None:
        raise ValueError(f"nothing of {source} is stored yet: run backfill first")
    rows = table.spark.read.format("json_api").options(url=url, cursor=cursor, known=str(most), **options).load()
    raw_rows = checkpointed(rows)
    _store(table, raw_rows, source, None)
    return raw_rows.select("id").distinct().count()


def fetch_details(table: KeyedTable, source: str, ids: list[int], url: str, **options: str) -> dict[str, int]:
    """Fetch the payloads of ``ids`` (a run's worth, as ``outcomes.to_fetch`` chooses them) and store them.

    Returns how many ids came back with each status; those that were not asked for stay missing, and
    the next run chooses them again. Cursors are left alone, since these ids are no range.
    """
    if not ids:
        return {}
    rows = checkpointed(table.spark.read.format("json_api").options(url=url, ids=",".join(map(str, ids)), **options).load())
    table.replace(_raw(rows, source))
    return {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}


def refresh_heroes(table: KeyedTable, payload: DataFrame) -> Snapshot:
    """Heroes of a payload into their table; columns that it does not state stay."""
    return table.supply(normalize.heroes(payload))


def refresh_pro_players(table: KeyedTable, payload: DataFrame) -> Snapshot:
    """Names and countries of professional players."""
    return table.supply(normalize.pro_players(payload))


def refresh_leagues(table: KeyedTable, payload: DataFrame) -> Snapshot:
    """Names and tiers of leagues; a tier that is not known any more clears the old one."""
    return table.supply(normalize.leagues(payload))
