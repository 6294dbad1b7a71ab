"""Network events of pages: the stream's exchanges equal the table's."""

import datetime
import random

from quillspan.streaming import correlate

START = datetime.datetime(2024, 1, 1)


def _event(page, seq, kind, request=None, minute=0, **more):
    given = {"method": None, "url": None, "status": None, "content_type": None, "body": None} | more
    return (page, seq, kind, request, START + datetime.timedelta(minutes=minute), *given.values())


def _run(spark, tmp_path, batches):
    """The stream over files, one a batch."""
    source, out = tmp_path / "in", tmp_path / "out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, correlate.EVENTS).coalesce(1).write.mode("append").json(str(source / f"b={i}"))
    files = spark.readStream.schema(correlate.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(source))
    query = correlate.correlate_stream(files).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return sorted(map(tuple, spark.read.schema(correlate.EXCHANGES).parquet(str(out)).collect()))


def test_stream_equals_table(spark, tmp_path):
    """Redirects, missing and repeated events, events of ids that nobody opened, pages that end twice."""
    rng, events = random.Random(2), []
    for n in range(300):
        page, request, kind = f"p{rng.randrange(4)}", f"r{rng.randrange(9)}", rng.choice(["request", "request", "response", "finished", "finished"])
        more = {"request": {"url": f"u{n}", "method": rng.choice(["POST", None])}, "response": {"status": n, "content_type": "t"}, "finished": {"body": f"b{n}"}}[kind]
        events.append(_event(page, n, kind, request, n / 100, **more))
        if n in (90, 200):
            events.append(_event(page, n * 1000, "end", minute=n / 100))
    events += [_event(f"p{i}", 10**6 + i, "end", minute=4) for i in range(4)]
    events.sort(key=lambda e: e[4])
    events = [(e[0], i, *e[2:]) for i, e in enumerate(events)]
    expected = sorted(map(tuple, correlate.correlate_table(spark.createDataFrame(events, correlate.EVENTS)).collect()))
    assert expected and _run(spark, tmp_path, [events[:130], events[130:131], events[131:]]) == expected


def test_idle_pages_are_closed(spark, tmp_path):
    first = [_event("p", 0, "request", "a", 0, url="u"), _event("p", 1, "response", "a", 0, status=200, content_type="x"), _event("q", 2, "request", "b", 0, url="v")]
    late = [_event("q", 3, "response", "b", 9, status=404, content_type=""), _event("z", 4, "request", "c", 60, url="w")]
    after = [_event("z", 5, "end", minute=61)]
    got = _run(spark, tmp_path, [first, late, after])
    assert got == [("p", "a", 0, "GET", "u", 200, "x", None, False), ("q", "b", 2, "GET", "v", 404, "", None, False), ("z", "c", 4, "GET", "w", 0, "", None, False)]
