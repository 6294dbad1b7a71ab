"""Envelopes as trees, inferred and recorded WSDL."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import wsdl

ENV = 'xmlns:e="http://schemas.xmlsoap.org/soap/envelope/" xmlns:i="http://www.w3.org/2001/XMLSchema-instance"'


def _nodes(inner: str, whole: bool = True) -> dict[str, str | None]:
    walk = wsdl.Envelope()
    walk.finish(f"<e:Envelope {ENV}><e:Body>{inner}{'</e:Body></e:Envelope>' if whole else ''}".encode())
    return {"/".join(path): kind for path, _, kind in walk.nodes()}


@pytest.mark.parametrize(
    ("inner", "nodes"),
    [
        ("<Do/>", {}),
        ("<Do><a>1</a><a>x</a><b/><b>true</b></Do>", {"a": "xsd:int", "b": "xsd:boolean"}),
        ("<Do><a/><a><b>1</b></a><a><c>1</c></a></Do>", {"a": "nested", "a/b": "xsd:int"}),
        ("<Do><a i:type='xs:long'><b>1</b></a><c i:type=' m:Own '>1</c><d i:type='int'/><f i:type=' '/></Do>", {"a": "xsd:long", "c": "xsd:string", "d": "xsd:int", "f": "xsd:string"}),
        ("<Do><a>007</a><b>-0</b><c>1.</c><d>2024-02-30</d><g>2024-02-29T24:00:00Z</g></Do>", {"a": "xsd:string", "b": "xsd:int", "c": "xsd:string", "d": "xsd:string", "g": "xsd:string"}),
        ("<Do><a>1<!-- x -->2</a><b> \n </b></Do><Other><z>1</z></Other>", {"a": "xsd:int", "b": None}),
        ("<Do><a>1&nope;2</a></Do>", {"a": "xsd:int"}),
    ],
)
def test_walks(inner, nodes):
    assert _nodes(inner) == nodes


def test_cut_bodies_keep_what_stands_before_the_cut():
    assert _nodes("<Do><a>1</a><b><c>2", whole=False) == {"a": "xsd:int", "b": "nested", "b/c": "xsd:int"}
    assert _nodes("<Do><a>1</a><b", whole=False) == {"a": "xsd:int"}


def test_depth_ends_and_entities_are_not_resolved():
    deep = _nodes("<Do>" + "<a>" * 60 + "1" + "</a>" * 60 + "</Do>")
    assert len(deep) == 31 and deep["/".join("a" * 31)] is None
    walk = wsdl.Envelope()
    walk.finish(b'<!DOCTYPE x [<!ENTITY a "b">]><e:Envelope ' + ENV.encode() + b"><e:Body><Do/></e:Body></e:Envelope>")
    assert walk.operation == ""


def _rows(spark, *calls):
    """Calls (action, request, response) as exchanges."""
    rows = [(i, "https://Host:8/ws/svc.asmx/?x", {"SoapAction": a} if a else {}, b.encode() if b else None, (r.encode() if r else None,)) for i, (a, b, r) in enumerate(calls)]
    return spark.createDataFrame(rows, "seq long, url string, headers map<string,string>, body binary, response struct<body:binary>")


def _envelope(inner):
    return f"<e:Envelope {ENV}><e:Body>{inner}</e:Body></e:Envelope>"


def test_trees_merge_over_calls(spark):
    """A leaf that was typed first keeps what is nested later out; an empty one gives way; order is that of first mention."""
    rows = _rows(spark, *[("", _envelope(f"<Do>{x}</Do>"), None) for x in ("<e/><u>1</u>", "<n><b>1</b></n><u><no>1</no></u>", "<n><a>x</a><b>x</b></n><e>1.5</e>")])
    found = wsdl.parameters(wsdl.soap_calls(rows)).orderBy("place").collect()
    assert [("/".join(r["path"]), r["kind"]) for r in found] == [("e", "xsd:decimal"), ("u", "xsd:int"), ("n", "nested"), ("n/b", "xsd:int"), ("n/a", "xsd:string")]


def test_operation_names(spark):
    calls = [('"urn:A"', None, None), ("http://x/B", None, None), ("", _envelope("<C/>"), None), ("", None, _envelope("<DResponse/>")), ("", "<x/>", None), ("", "<Envelope><Body><E/></Body></Envelope>", None)]
    assert [r["operation"] for r in wsdl.soap_calls(_rows(spark, *calls)).orderBy("seq").collect()] == ["A", "B", "C", "D"]


def test_inferred_documents(spark):
    doc = wsdl.infer_wsdl(_rows(spark, ("urn:A<", _envelope('<m:A xmlns:m="urn:one"><p><q/></p></m:A>'), None), ("", _envelope('<m:B xmlns:m="urn:two"/>'), None))).collect()[0]
    assert (doc["service"], doc["namespace"]) == ("svc", "https://Host:8/")  # the operations disagree
    assert '<element name="A&lt;">' in doc["wsdl"] and "<sequence></sequence>" in doc["wsdl"] and 'soapAction="urn:A&lt;"' in doc["wsdl"]
    assert '<operation name="B"></operation>' in doc["wsdl"] and doc["wsdl"].endswith("</definitions>")
    assert wsdl.infer_wsdl(_rows(spark, ("", "<x/>", None))).count() == 0
    assert "<types>" not in wsdl.infer_wsdl(_rows(spark, ("urn:A", None, None))).collect()[0]["wsdl"]


def test_recorded_documents_come_first(spark):
    good = '<?xml version="1.0" encoding="latin-1"?><definitions/>'
    rows = _rows(spark, ("urn:A", None, "<definitions>"), ("", None, good), ("", None, "<definitions/>"))
    assert [tuple(r) for r in wsdl.generate_wsdl(rows).collect()] == [(good, False)]
    assert wsdl.generate_wsdl(_rows(spark, ("urn:A", None, '<?xml version="1.0" encoding="utf-7"?><definitions/>'))).collect()[0]["inferred"]
    probed = rows.withColumn("wsdl_document", F.when(F.col("seq") == 0, F.lit(b"<definitions name='p'/>")))
    assert wsdl.generate_wsdl(probed).collect()[0]["wsdl"] == "<definitions name='p'/>"
