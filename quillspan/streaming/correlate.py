"""Network events of pages, put together as exchanges: with state over a stream, with joins over a table.

Events (page, seq, kind, request_id, ...) are of four kinds: ``request`` opens an exchange (and begins it anew, if its id is open), ``response`` adds
status, headers and type, the first ``finished`` after the request adds the body, and ``end`` closes the page: all its exchanges are given
out then, complete or not. Responses and ends of requests that are not open are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "page string, seq long, kind string, request_id string, at timestamp, method string, url string, status int, content_type string, body string"
EXCHANGES = "page string, request_id string, seq long, method string, url string, status int, content_type string, body string, complete boolean"
_NAMES = [c.split()[0] for c in EXCHANGES.split(", ")]


def _take(pending: dict[str, dict], event: dict) -> None:
    """One event into the open exchanges of a page."""
    at, kind = event["request_id"], event["kind"]
    if kind == "request":
        pending[at] = {"seq": event["seq"], "method": event["method"] or "GET", "url": event["url"], "status": 0, "content_type": "", "body": None, "complete": False}
    elif at in pending and kind == "response":
        pending[at] |= {"status": event["status"] or 0, "content_type": event["content_type"] or ""}
    elif at in pending and kind == "finished" and not pending[at]["complete"]:
        pending[at] |= {"complete": True, "body": event["body"]}


def correlate_stream(events: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Exchanges of a stream of :data:`EVENTS`. A page without an event for ``idle`` (of event time) is closed as if it had ended.

    State is what a page has open; it leaves with the page. A page's events of one batch are taken in the order of ``seq``.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending: dict[str, dict] = json.loads(state.get[0]) if state.exists else {}
        closed: list[tuple] = []

        def close() -> None:
            closed.extend((key[0], request, *(e[n] for n in _NAMES[2:])) for request, e in pending.items())
            pending.clear()

        if state.hasTimedOut:
            close()
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            latest = rows["at"].max()
            for event in rows.astype(object).where(rows.notna(), None).to_dict("records"):
                if event["kind"] == "end":
                    close()
                else:
                    event["seq"] = int(event["seq"])
                    event["status"] = None if event["status"] is None else int(event["status"])
                    _take(pending, event)
            if pending:
                state.update((json.dumps(pending),))
                state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000) + millis, state.getCurrentWatermarkMs() + 1))
        if not pending and state.exists:
            state.remove()
        yield pd.DataFrame(closed, columns=_NAMES).astype({"seq": "int64", "status": "int32", "complete": "bool"})

    marked = events.withWatermark("at", idle)
    return marked.groupBy("page").applyInPandasWithState(run, EXCHANGES, "pending string", "append", GroupStateTimeout.EventTimeTimeout)


def correlate_table(events: DataFrame) -> DataFrame:
    """The same of a whole table: every page is closed at its ends and at the last.

    A page's visits are told apart by the ends before them. Within a visit the last request of an id counts, with the last response and the first end of loading after it;
    all is aggregated by (page, visit, id), so that no page is gathered.
    """
    by_page = Window.partitionBy("page").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    visits = events.withColumn("visit", F.coalesce(F.sum((F.col("kind") == "end").cast("int")).over(by_page), F.lit(0)))
    keys = ["page", "visit", "request_id"]
    of = lambda kind: visits.filter(F.col("kind") == kind)
    opened = of("request").groupBy(*keys).agg(F.max("seq").alias("seq"), F.max_by(F.struct("method", "url"), "seq").alias("asked"))
    later = lambda kind: of(kind).withColumnRenamed("seq", "later").join(opened.select(*keys, "seq"), keys).filter("later > seq")
    told = later("response").groupBy(*keys).agg(F.max_by(F.struct("status", "content_type"), "later").alias("told"))
    ended = later("finished").groupBy(*keys).agg(F.min_by(F.struct("body"), "later").alias("ended"))
    joined = opened.join(told, keys, "left").join(ended, keys, "left")
    return joined.select("page", "request_id", "seq", F.coalesce("asked.method", F.lit("GET")).alias("method"), "asked.url", F.coalesce("told.status", F.lit(0)).alias("status"), F.coalesce("told.content_type", F.lit("")).alias("content_type"), "ended.body", F.col("ended").isNotNull().alias("complete"))
