"""A Spark data source for paged JSON interfaces with throttle and retry.

    spark.dataSource.register(JsonApi)
    spark.read.format("json_api").option("url", ...).option("ids", "1,2,3").load()
    spark.readStream.format("json_api").option("url", ...).option("cursor", "less_than_match_id").load()
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.rules import SECRET

# Attempts, waits in seconds, statuses that may pass, failures in a row that end a run.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 4, 2.0, 120.0
TRANSIENT = (408, 429)
FAILURES_IN_A_ROW = 20


def is_transient(error: Exception) -> bool:
    """Transport errors, 408, 429 and 5xx may pass; other statuses do not."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code in TRANSIENT or error.code >= 500
    return isinstance(error, (urllib.error.URLError, TimeoutError, ConnectionError))


def redact(text: str) -> str:
    return re.sub(SECRET, r"\1\2=***", text)


def asked_to_wait(error: Exception) -> float:
    """Seconds that a refusal names in Retry-After, at most ``LONGEST_WAIT``; 0 where it names none."""
    named = (error.headers or {}).get("Retry-After", "") if isinstance(error, urllib.error.HTTPError) else ""
    return min(float(named), LONGEST_WAIT) if named.isdigit() else 0.0


def fetch(url: str, body: bytes | None = None, headers: dict | None = None, opener=urllib.request.urlopen, sleep=time.sleep) -> str:
    """The response's text; transient errors are tried again, errors name a redacted address."""
    wait = FIRST_WAIT
    for attempt in range(ATTEMPTS):
        try:
            with opener(urllib.request.Request(url, data=body, headers=headers or {}), timeout=60) as response:
                return response.read().decode()
        except Exception as e:
            if attempt == ATTEMPTS - 1 or not is_transient(e):
                raise RuntimeError(redact(f"{type(e).__name__} at {url}: {e}")) from None
            asked = asked_to_wait(e)
        sleep(max(wait, asked))
        wait = min(wait * 2, LONGEST_WAIT)
    raise AssertionError("unreachable")


def graphql(url: str, query: str, variables: dict, headers: dict | None = None, fetcher=fetch) -> str:
    """The ``data`` of a GraphQL answer as text; an answer with errors is an error."""
    body = json.dumps({"query": query, "variables": variables}).encode()
    answer = json.loads(fetcher(url, body, {"Content-Type": "application/json"} | (headers or {})))
    if answer.get("errors"):
        raise RuntimeError(redact(f"GraphQL at {url}: {json.dumps(answer['errors'])[:500]}"))
    return json.dumps(answer.get("data"))


class _Ids(DataSourceReader):
    """One request an id, one partition: the interface's limit is per client.

    Every id gives a row, so that a run that was cut short shows: status is ok, missing (404),
    failed, or, after a 429 or twenty failures in a row, not_asked for all that are left (K22).
    """

    def __init__(self, options: dict):
        self.url, self.ids, self.interval = options["url"], [x for x in options.get("ids", "").split(",") if x], float(options.get("interval", 1))
        self.query, self.variable = options.get("query"), options.get("variable", "id")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def _ask(self, wanted: str) -> str:
        if self.query:
            return graphql(self.url, self.query, {self.variable: int(wanted) if wanted.isdigit() else wanted})
        return fetch(self.url.format(id=wanted))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        failed, stopped = 0, False
        for wanted in self.ids or [""]:
            if stopped:
                yield (wanted, None, "not_asked")
                continue
            try:
                yield (wanted, self._ask(wanted), "ok")
                failed = 0
            except RuntimeError as e:
                missing, refused = "HTTP Error 404" in str(e), "HTTP Error 429" in str(e)
                failed = 0 if missing else failed + 1
                stopped = refused or failed >= FAILURES_IN_A_ROW
                yield (wanted, None, "not_asked" if refused else "missing" if missing else "failed")
            time.sleep(self.interval)


class _Keyset:
    """Pages of an array in descending order of an id."""

    def __init__(self, options: dict):
        self.url, self.cursor, self.id, self.interval = options["url"], options["cursor"], options.get("id", "match_id"), float(options.get("interval", 1))

    def page(self, before: int | None) -> list[dict]:
        at = "" if before is None else ("&" if "?" in self.url else "?") + f"{self.cursor}={before}"
        return json.loads(fetch(self.url + at))

    def between(self, before: int | None, least: int) -> Iterator[dict]:
        """Rows with an id under ``before`` and of ``least`` or more."""
        while rows := self.page(before):
            yield from (r for r in rows if r[self.id] >= least)
            lowest = min(r[self.id] for r in rows)
            if lowest <= least or (before is not None and lowest >= before):
                return
            before = lowest
            time.sleep(self.interval)

    def row(self, r: dict) -> tuple:
        return (str(r[self.id]), json.dumps(r), "ok")


class _Forward(_Keyset, DataSourceReader):
    """The newest rows down to a known id, which is not read again."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.known = int(options["known"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return (self.row(r) for r in self.between(None, self.known + 1))


class _Pages(_Keyset, SimpleDataSourceStreamReader):
    """Backwards over keyset pages, one a micro-batch; Spark's checkpoint keeps the cursor.

    An offset holds the least and the greatest id so far; ``start`` and ``most`` go on from a range
    that is stored already. A batch that is read again asks for the
    ids between its two offsets, so rows that appeared since then do not enter it.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.start, self.most = (int(options[k]) if options.get(k) else None for k in ("start", "most"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"least": self.start, "most": self.most}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self.page(start["least"])
        ids = [r[self.id] for r in rows]
        end = {"least": min(ids), "most": start["most"] if start["most"] is not None else max(ids)} if ids else start
        return iter([self.row(r) for r in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        if end == start:
            return iter(())
        first = start["least"] if start["least"] is not None else end["most"] + 1
        return iter([self.row(r) for r in self.between(first, end["least"])])


class JsonApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return "id string, payload string, status string"

    def reader(self, schema) -> DataSourceReader:
        return _Forward(self.options) if "known" in self.options else _Ids(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Pages(self.options)
