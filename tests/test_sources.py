"""Readers over small files of each format."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from quillspan.sources import mitm, readers, views


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path / name)


def test_capture(spark, tmp_path):
    one = {"method": "GET", "url": "https://a.example/x?b=1", "headers": {"Accept": "x"}, "response": {"status_code": 200, "content_type": "text/plain", "body": base64.b64encode(b"hi").decode()}, "source": "browser"}
    rows = readers.read(spark, "capture", put(tmp_path, "c.json", json.dumps([one, one | {"url": "https://b.example/"}]))).orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1] and bytes(rows[0].response.body) == b"hi" and rows[0].headers == {"Accept": "x"}
    readers.write_capture(readers.read_capture(spark, str(tmp_path / "c.json")), str(tmp_path / "out"))
    back = readers.read_capture(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, readers.read_capture(spark, str(tmp_path / "c.json")).collect()))
    readers.write_capture(back.filter("1 = 0"), str(tmp_path / "none"))
    assert readers.read_capture(spark, str(tmp_path / "none")).count() == 0
    readers.write_capture(back, str(tmp_path / "lines"), lines=True)
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


def test_har(spark, tmp_path):
    entry = {"request": {"method": "POST", "url": "http://h.example/p?q=1&q=2", "headers": [{"name": "A", "value": "1"}, {"name": "A", "value": "2"}, {"name": "", "value": "3"}], "postData": {"text": "{}"}}, "response": {"status": 201, "headers": [], "content": {"mimeType": "application/json", "text": "[1]"}}}
    path = put(tmp_path, "h.har", json.dumps({"log": {"entries": [entry]}}))
    row = readers.read(spark, "har", path).first()
    assert row.headers == {"A": "2"} and row.query_params == {"q": ["1", "2"]} and row.response.status_code == 201 and bytes(row.body) == b"{}" and row.source == "import:har"
    assert readers.read(spark, "har", path, scope="*.example").count() == 1 and readers.read(spark, "har", path, scope="other").count() == 0
    with pytest.raises(ValueError):
        readers.read(spark, "har", path, max_entries=0)
    entry["request"]["method"] = "FETCH"
    with pytest.raises(Exception, match="not an HTTP method"):
        readers.read(spark, "har", put(tmp_path, "bad.har", json.dumps({"log": {"entries": [entry]}}))).collect()


def test_burp(spark, tmp_path):
    asked = base64.b64encode(b"POST /x HTTP/1.1\r\nHost: h\r\nContent-Type: application/json\r\n\r\n{\"a\": 1}\n").decode()
    text = f"""<?xml version="1.0"?><items><item><url>https://h.example/x</url><request base64="true">{asked}</request>
<response base64="false"><![CDATA[HTTP/1.1 200 OK\nContent-Type: text/plain\n\nbody\n]]></response><status>204</status></item></items>"""
    row = readers.read(spark, "burp", put(tmp_path, "b.xml", text)).first()
    assert row.method == "POST" and row.headers["Host"] == "h" and bytes(row.body) == b'{"a": 1}\n'
    assert row.response.status_code == 204 and row.response.content_type == "text/plain" and bytes(row.response.body) == b"body\n"


def tnet(v):
    if isinstance(v, dict):
        body, kind = b"".join(tnet(k) + tnet(x) for k, x in v.items()), b"}"
    elif isinstance(v, list):
        body, kind = b"".join(map(tnet, v)), b"]"
    elif v is None:
        body, kind = b"", b"~"
    elif isinstance(v, bool):
        body, kind = str(v).lower().encode(), b"!"
    elif isinstance(v, int):
        body, kind = str(v).encode(), b"#"
    else:
        body, kind = (v, b",") if isinstance(v, bytes) else (v.encode(), b";")
    return str(len(body)).encode() + b":" + body + kind


FLOW = {"type": "http", "request": {"method": b"GET", "scheme": b"https", "host": "m.example", "port": 443, "path": b"/a?x=1", "headers": [[b"Accept", b"*/*"]], "content": b""}, "response": {"status_code": 200, "headers": [[b"content-type", b"text/html"]], "content": b"<p>"}}


def test_mitmproxy(spark, tmp_path):
    data = tnet(FLOW) + tnet({"type": "tcp"}) + tnet(FLOW | {"response": None})
    rows = readers.read(spark, "mitmproxy", put(tmp_path, "m.mitm", data)).orderBy("seq").collect()
    assert [r.url for r in rows] == ["https://m.example/a?x=1"] * 2 and rows[0].response.content_type == "text/html" and rows[1].response.status_code is None
    plain = {"request": {"method": "get", "scheme": "http", "host": "j.example", "port": 8080, "path": "/", "headers": [["A", "b"]], "content": None}, "response": {"status_code": 404, "headers": [], "content": None}}
    for name, value in (("one.json", plain), ("many.json", [plain])):
        assert readers.read(spark, "mitmproxy", put(tmp_path, name, json.dumps(value))).first().url == "http://j.example:8080/"
    with pytest.raises(ValueError):
        mitm.decode(b"5:abc,")
    with pytest.raises(ValueError, match="neither JSON"):
        readers.read(spark, "mitmproxy", put(tmp_path, "x.mitm", "  <xml/>"))
    odd = {"request": plain["request"] | {"path": "/a%zz?x=%41", "port": 80}}
    assert readers.read(spark, "mitmproxy", put(tmp_path, "odd.json", json.dumps(odd))).first().url == "http://j.example/a%25zz?x=%41"


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="known are"):
        readers.read(spark, "pcap", "/nowhere")


def test_views_have_unique_seq(spark):
    rows = views.capture(spark, "/root/testdata/sf0.001")
    assert rows.count() == rows.agg(F.count_distinct("seq")).first()[0]
