"""Classification, deduplication, templates, operations, forms and streams on small tables."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from quillspan.functions import headers as H
from quillspan.functions import url as U
from quillspan.operators import bundles, classify, dedup, enrich, forms, links, mining, openapi, pages, paths, schemas, soap, specs, wire
from quillspan.sources import views
from quillspan.sources.schema import EXCHANGE
from quillspan.streaming import live


def exchanges(spark, *rows):
    """Exchanges from dictionaries of what matters."""
    kinds = ", ".join(f"{k} {v}" for k, v in EXCHANGE.items())
    full = []
    for i, r in enumerate(rows):
        answer = {"status_code": r.get("status", 200), "headers": r.get("answer_headers", {}), "content_type": r.get("answer_type", ""), "body": r.get("answer", "").encode() or None}
        full.append((r.get("seq", i), r.get("method", "GET"), r["url"], r.get("headers", {}), None, r.get("body", "").encode() or None, answer, r.get("source", "browser"), "", "", ""))
    return spark.createDataFrame(full, kinds).withColumn("query_params", U.query_params(F.col("url")))


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


REST = [
    ({"url": "https://a/app.js", "answer_type": "application/json"}, 0.0, ""),
    ({"url": "https://a/static/x"}, 0.0, ""),
    ({"url": "https://a/x", "answer_type": "Application/JSON; charset=utf-8"}, 0.8, "content-type:application/json"),
    ({"url": "https://a/api/x", "answer_type": "application/json"}, 0.95, "content-type:application/json+path-heuristic"),
    ({"url": "https://a/api/x"}, 0.15, "path-heuristic"),
    ({"url": "https://a/v12/x", "source": "static:js"}, 0.5, "path-heuristic+static-js-candidate"),
    ({"url": "https://a/x", "method": "delete"}, 0.7, "method:DELETE"),
    ({"url": "https://a/api/x", "answer": " \n[1]"}, 0.85, "path-heuristic+response-structure:json"),
    ({"url": "https://a/api/x", "headers": {"accept": "application/json"}}, 0.6, "path-heuristic+request-signal:accept:application/json"),
    ({"url": "https://a/api/x", "headers": {"Accept": "text/html, application/json"}}, 0.15, "path-heuristic"),
    ({"url": "https://a/api/%zz", "answer_type": "application/json"}, 0.0, ""),
    ({"url": "https://a/api/{id}/x", "method": "PATCH"}, 0.7, "path-heuristic+method:PATCH"),
]


def test_rest_rules(spark):
    rows = classify.look(exchanges(spark, *[r for r, _, _ in REST])).select("seq", classify.rest().struct("rest").alias("v")).orderBy("seq").collect()
    assert [(round(r.v.confidence, 4), r.v.reason) for r in rows] == [(c, t) for _, c, t in REST]


OTHERS = [
    ("graphql", {"url": "https://a/graphql", "method": "POST", "body": '{"query": "query { x }"}'}, 0.95, "graphql-path+graphql-body"),
    ("graphql", {"url": "https://a/x", "method": "POST", "body": '{"query": {"a": 1}}'}, 0.0, ""),
    ("graphql", {"url": "https://a/graphql", "answer_type": "application/json", "answer": '{"errors": null}'}, 0.8, "graphql-path+graphql-response"),
    ("wsdl", {"url": "https://a/x", "headers": {"soapaction": "u"}}, 0.95, "soapaction-header"),
    ("wsdl", {"url": "https://a/x?WSDL", "answer_type": "text/xml"}, 0.9, "wsdl-url+soap-content-type"),
    ("wsdl", {"url": "https://a/f", "answer_type": "text/xml", "answer": "<rss/>"}, 0.3, "soap-content-type"),
    ("grpc", {"url": "https://a/p.S/Do", "method": "POST", "headers": {"Content-Type": "application/grpc+proto"}, "answer_headers": {"GRPC-Status": "0"}}, 0.99, "grpc-content-type+grpc-trailer-header+grpc-path-shape"),
    ("grpc", {"url": "https://a/p.S/do", "method": "POST"}, 0.0, ""),
]


def test_other_classifiers(spark):
    rows = classify.look(exchanges(spark, *[r for _, r, _, _ in OTHERS])).select("seq", *[classify.CLASSIFIERS[k]().struct(k).alias(k) for k in classify.CLASSIFIERS]).orderBy("seq").collect()
    assert [(round(r[k].confidence, 4), r[k].reason) for r, (k, _, _, _) in zip(rows, OTHERS, strict=True)] == [(c, t) for _, _, c, t in OTHERS]


def test_threshold_zero_keeps_all(spark):
    rows = exchanges(spark, {"url": "https://a/x.css"}, {"url": "https://a/x"})
    assert classify.classify(rows, ["rest"], 0.0).count() == 2 and classify.classify(rows, ["rest"]).count() == 0
    assert classify.classify(rows.filter("1 = 0"), ["rest", "grpc"]).count() == 0


def test_dedup_does_not_depend_on_order(spark):
    rows = exchanges(
        spark,
        {"url": "https://a/api/x?b=2&b=1", "answer_type": "application/json", "status": 500},
        {"url": "https://other/api/x?b=1&c=3", "answer_type": "application/json", "status": 200, "answer": "{}"},
        {"url": "https://a/api/x?b=9", "answer_type": "", "status": 0},
        {"url": "https://a/api/y", "method": "POST", "body": "--AAAA x", "headers": {"Content-Type": "multipart/form-data; boundary=AAAA"}},
        {"url": "https://a/api/y", "method": "POST", "body": "--BBBB x", "headers": {"Content-Type": "multipart/form-data; boundary=BBBB"}},
    )
    classified = classify.classify(rows, ["rest"], 0.1)
    for order in (classified, classified.orderBy(F.desc("seq")).repartition(3)):
        out = dedup.deduplicate(order).orderBy("seq").collect()
        assert [(r.seq, r.repeats) for r in out] == [(0, 3), (3, 2)]
        first = out[0]
        assert first.url == "https://a/api/x?b=2&b=1" and first.query_params == {"b": ["2", "1", "9"], "c": ["3"]}
        assert first.response.status_code == 200 and round(first.confidence, 4) == 0.95 and first.multi_value_query_keys == {"b": True}
    assert dedup.deduplicate(classified.filter("1 = 0")).count() == 0


TEMPLATES = {
    "/users/42": "/users/{userId}",
    "/categories/7/entries/8": "/categories/{categoryId}/entries/{entryId}",
    "/x/1/2": "/x/{xId}/{xId2}",
    "/1": "/{id}",
    "/addresses/5": "/addresses/{addressId}",
    "/line-items/550e8400-e29b-41d4-a716-446655440000": "/line-items/{lineItemId}",
    "/s/QWxhZGRpbjpvcGVuIHNlc2FtZQ==": "/s/{sToken}",
    "/users/me": "/users/me",
    "/commit/3fa4b2c": "/commit/{commitId}",
    "/commit/facade": "/commit/facade",
}


def test_templates(spark):
    rows = spark.createDataFrame([(p,) for p in TEMPLATES], "path string")
    assert {r.path: r.template for r in paths.normalize(rows).collect()} == TEMPLATES


def test_slugs_are_promoted_and_unified(spark):
    rows = spark.createDataFrame([(f"/blog/{s}/view",) for s in ("red", "green", "12")] + [("/api/users",), ("/api/posts",)], "path string")
    out = {r.path: r.template for r in paths.normalize(rows, merge_slugs=True, threshold=2).collect()}
    assert out == {"/blog/red/view": "/blog/{blogSlug}/view", "/blog/green/view": "/blog/{blogSlug}/view", "/blog/12/view": "/blog/{blogSlug}/view", "/api/users": "/api/users", "/api/posts": "/api/posts"}
    with pytest.raises(ValueError):
        paths.normalize(rows, merge_slugs=True, threshold=1)


@pytest.mark.parametrize(
    ("url", "origin", "canonical"),
    [("HTTPS://A.b:443/x", "https://a.b:443", "https://a.b"), ("http://a:8080", "http://a:8080", "http://a:8080"), ("/x", "", ""), ("ftp://a/", "ftp://a", ""), ("http://a:1:2/", "", ""), ("http://u:p@a/", "http://a", "http://a")],
)
def test_origins(spark, url, origin, canonical):
    row = spark.createDataFrame([(url,)], "u string").select(U.origin(F.col("u")).alias("o"), U.canonical_origin(F.col("u")).alias("c")).first()
    assert (row.o, row.c) == (origin, canonical)


def test_headers(spark):
    row = spark.createDataFrame([({"b": "1", "Content-type": "x", "CONTENT-TYPE": "y"},)], "h map<string,string>")
    assert row.select(H.header(F.col("h"), "content-type")).first()[0] == "y"


@pytest.mark.parametrize(("values", "kind"), [(["1", "-2"], "integer"), (["1", "2.5"], "number"), (["true", "false"], "boolean"), (["true", "1"], "string"), ([], "string")])
def test_value_types(spark, values, kind):
    assert spark.createDataFrame([(values,)], "v array<string>").select(openapi.value_type(F.col("v"))).first()[0] == kind


def test_document(spark):
    rows = exchanges(
        spark,
        {"url": "https://a/users/1?q=1&t=a&t=b", "answer": '{"id": 1, "tags": ["x"]}', "answer_type": "application/json"},
        {"url": "https://a/users/2?q=x", "answer": '{"id": 1.5, "name": null}', "answer_type": "application/json"},
        {"url": "https://b/users/3", "source": "static:js"},
        {"url": "https://a/users", "method": "POST", "body": '{"name": "n", "age": 3}', "status": 201},
        {"url": "https://a/users?z", "method": "POST", "body": '{"age": "old", "x": {"y": [1]}}', "status": 201},
    )
    places = openapi.templated(openapi.places(rows))
    kept = openapi.resolve_collisions(openapi.operations(places), openapi.servers(places))
    with_ops = openapi.with_operation(rows)
    doc = json.loads(openapi.document(openapi.render_openapi(kept, openapi.query_parameters(rows), schemas.request_bodies(with_ops), schemas.response_bodies(with_ops)), ["https://a"]))
    get = doc["paths"]["/users/{userId}"]["get"]
    assert get["x-source"] == "dynamic" and get["x-collision-origins"] == "https://b"
    assert [(p["name"], p["in"], p["schema"]["type"]) for p in get["parameters"]] == [("q", "query", "string"), ("t", "query", "array"), ("userId", "path", "string")]
    assert get["parameters"][1]["schema"]["items"] == {"type": "string"} and get["parameters"][1]["style"] == "form" and get["parameters"][1]["explode"]
    assert get["responses"]["200"] == {"content": {"application/json": {"schema": {"type": "object", "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}, "name": {"nullable": True}}}}}, "description": "OK"}
    sent = doc["paths"]["/users"]["post"]["requestBody"]["content"]["application/json"]["schema"]
    assert sent["properties"] == {"name": {"type": "string"}, "age": {"type": "string"}, "x": {"type": "object", "properties": {"y": {"type": "array", "items": {"type": "integer"}}}}}


BODIES = [
    (b'{"a": 1.0, "b": 9999999999999999999, "c": [], "d": null}', schemas.JSON, "", {"a": "integer", "b": "number", "c": "array", "d": ""}),
    (b"[1, \"x\"]", schemas.JSON, "", None),
    (b"{bad", schemas.JSON, "", False),
    (b"NaN", schemas.JSON, "", False),
    (b"a=1&b=2.5&c=true&d=x+y&a=zz&=", schemas.FORM, "", {"a": "integer", "b": "number", "c": "boolean", "d": "string", "": "string"}),
    (b"a=%zz", schemas.FORM, "", False),
    (b'--X9\r\nContent-Disposition: form-data; name="n"\r\n\r\n12\r\n--X9\r\nContent-Disposition: form-data; name="f"; filename="p.png"\r\n\r\n\x00\x01\r\n--X9--\r\n', schemas.MULTIPART, "multipart/form-data; boundary=X9", {"n": "integer", "f": "string"}),
    (b"", schemas.JSON, "", False),
]


@pytest.mark.parametrize(("body", "media", "given", "kinds"), BODIES)
def test_body_schemas(body, media, given, kinds):
    found = schemas.body_schema(body, media, given)
    if kinds is False:
        assert found is None
    elif kinds is None:
        assert found == {"type": "array", "items": {"type": "integer"}}
    else:
        assert {k: v.get("type", "") for k, v in found["properties"].items()} == kinds


def test_schemas_have_a_depth():
    deep = schemas.body_schema(b"[" * 30 + b"]" * 30, schemas.JSON, "")
    for _ in range(schemas.MAX_DEPTH):
        deep = deep["items"]
    assert deep == {"type": "object"} and schemas.body_schema(b"[" * 200_000, schemas.JSON, "") is None


def test_first_null_stays_and_types_promote(spark):
    rows = exchanges(spark, *[{"url": f"https://a/x?{i}", "method": "PUT", "body": b} for i, b in enumerate(['{"a": null, "b": 1}', '{"a": 1, "b": null}', '{"a": "s", "b": true}', "[1]"])], {"url": "https://a/y", "method": "PATCH", "body": "[1]"}, {"url": "https://a/y?2", "method": "PATCH", "body": '{"z": 1}'}, {"url": "https://a/z", "body": "{}"})
    out = {(r.template, r.name): r.type for r in schemas.request_bodies(openapi.with_operation(rows)).collect()}
    assert out == {("/x", "a"): "", ("/x", "b"): "string", ("/y", None): "array"}


def test_components_are_named_in_order(spark):
    rows = [("/users", "post", "application/json", "id", "integer"), ("/users/{userId}", "put", "application/json", "id", "integer"), ("/login.php", "post", "application/json", "u", "string"), ("/a/login", "post", "application/json", "v", "")]
    asked = spark.createDataFrame([(t, m, "o", k, n, y, "") for t, m, k, n, y in rows], "template string, method string, origin string, media string, name string, type string, schema string")
    told = spark.createDataFrame([("/users", "get", "o", "200", "id", "integer", ""), ("/users", "post", "o", "204", "x", "string", ""), ("/users", "post", "o", "418", "y", "string", "")], "template string, method string, origin string, status string, name string, type string, schema string")
    out = {(r.template, r.method, r.place, r.key): r.component for r in schemas.components(asked, told).collect()}
    assert out == {
        ("/users", "post", "request", "application/json"): "CreateUserRequest",
        ("/users/{userId}", "put", "request", "application/json"): "CreateUserRequest",
        ("/a/login", "post", "request", "application/json"): "CreateLoginRequest",
        ("/login.php", "post", "request", "application/json"): "CreateLoginRequest2",
        ("/users", "get", "response", "200"): "UserResponse",
        ("/users", "post", "response", "418"): "User418Response",
    }
    names = spark.createDataFrame([(p,) for p in ("/api/v2/tickets/{ticketId}", "/stored-xss", "/{id}", "/2fa", "/categories")], "p string").select(schemas.resource_name(F.col("p"))).collect()
    assert [r[0] for r in names] == ["Ticket", "StoredXss", "Resource", "Resource2fa", "Category"]


def test_parameter_types_look_at_every_value(spark):
    rows = exchanges(spark, *[{"url": f"https://a/x?p={i}&q={i}&r={i}"} for i in range(300)], {"url": "https://a/x?p=next&q=1.5&r=7"})
    assert {r.name: r.type for r in openapi.query_parameters(rows).collect()} == {"p": "string", "q": "number", "r": "integer"}


def test_links(spark):
    html = '<a href="/b?x=1&amp;y=2">b</a><a class="k" href=\'c#top\'>c</a><a href="mailto:x@y">m</a><a href="/i.png">i</a><a href="/b?x=1&amp;y=2">b</a>'
    pages = spark.createDataFrame([(1, "http://h.example/d/a", html)], "page_id long, url string, html string")
    assert sorted((r.pos, r.link) for r in links.page_links(pages).collect()) == [(0, "http://h.example/b?x=1&y=2"), (1, "http://h.example/d/c")]
    html = '<base href="/deep/"><a href="x">x</a><form action="/f"></form><iframe src="y.html"></iframe><map><area href="?q"></map><div data-href="z"></div><p class="k" data-url="/w"></p><a href=" ">e</a><a href="y.html">y</a>'
    deep = links.page_links(spark.createDataFrame([(1, "http://h.example/d/a", html)], "page_id long, url string, html string"))
    assert sorted((r.pos, r.link) for r in deep.collect()) == [(0, "http://h.example/deep/x"), (1, "http://h.example/deep/y.html"), (2, "http://h.example/f"), (4, "http://h.example/deep/?q"), (5, "http://h.example/deep/z"), (6, "http://h.example/w")]
    both = links.merge_links(deep, spark.createDataFrame([(1, 0, "http://h.example/w"), (1, 1, "http://h.example/new")], "page_id long, pos int, link string"))
    assert [(r.pos, r.link) for r in both.orderBy("pos").collect()][-2:] == [(5, "http://h.example/w"), (6, "http://h.example/new")]
    reached = spark.createDataFrame([("http://a/1", 1), ("http://a/0", 0), ("http://a/2", 1), ("http://b/", 2)], "url string, depth int")
    assert {r.url for r in links.within_budget(reached, 2).collect()} == {"http://a/0", "http://a/1", "http://b/"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    assert {r.url: r.depth for r in links.crawl_depths(edges, spark.createDataFrame([("a",)], "url string")).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_forms(spark):
    html = '<html><form action="/s" method="post"><input name="b" value="x y"><input type="password" name="p" value="z"><textarea name="t">hi</textarea><select name="c"><option value="1"><option value="2" selected></select></form><form action="https://evil/"><input name="a"></form><form><input name="q" placeholder="find">'
    out = forms.extract_forms(exchanges(spark, {"url": "https://h.example/d/p?k=1", "answer_type": "text/html", "answer": html})).orderBy("ord").collect()
    assert [(r.method, r.url, r.body) for r in out] == [("POST", "https://h.example/s", "b=x+y&c=2&p=&t=hi"), ("GET", "https://h.example/d/p?k=1&q=find", None)]


def test_mining_and_enrichment(spark):
    text = "fetch('/api/users');x=\"rest/a/b.js\";y=`/v2/items/${id}`;z='/about';g('/graphql')"
    rows = mining.mine_paths(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, script string"), "id", "script").orderBy("pos").collect()
    assert [(r.id, r.path) for r in rows] == [(1, "/api/users"), (1, "/graphql"), (1, "/v2/items/{param}")]
    assert one(spark, mining.allowed_methods(F.col("a")), a=" get, ,Post") == ["GET", "POST"]
    tails = {"urn:stock#GetStock": "stock#GetStock", "http://x/ws#Get": "Get", "http://x/y/": "http://x/y/", "http://x/y#": "y#", "http://x/a/Do": "Do", "Plain": "Plain"}
    assert {u: one(spark, soap.uri_tail(F.col("u")), u=u) for u in tails} == tails
    assert [one(spark, soap.xsd_type(F.col("v")), v=v) for v in ("true", "12", "1.5", "2024-02-30", "2024-02-28", "x")] == ["xsd:boolean", "xsd:int", "xsd:decimal", "xsd:string", "xsd:date", "xsd:string"]
    bodies = ["<s:Envelope xmlns:s='http://www.w3.org/2003/05/soap-envelope'><s:Body><m:Do xmlns:m='u'/></s:Body></s:Envelope>", "<Envelope><Body><Do/></Body></Envelope>", "<Envelope xmlns='http://schemas.xmlsoap.org/soap/envelope/'><Body><!-- x --> <Do/></Body></Envelope>"]
    assert [one(spark, soap.body_child(F.col("b")), b=b) for b in bodies] == ["Do", "", "Do"]


def test_scripts_are_scanned():
    found = mining.template_paths("x=`/api/u/${a.b(`n${1}`)}/p`;y=`no`;z=`${host}/v2/items`;w=`/api/ has space`;q=`https://h/api/${x}`;e=`/api/\\`q`;bad=`/api/z")
    assert found == ["/api/u/{param}/p", "/v2/items", "https://h/api/{param}", "/api/\\`q"]
    script = """a="/api/posts/".concat(id, "/comment", f(a,b)); b="/api/users/" + id + "/posts"; c="identity/" + "api/auth/login"; d="/x/".concat(y); e='/api/a//b/' + foo(1, {a:"+"})+`/t`+`${u}`, f = '/api/q' + "\u00e9" """
    assert mining.concat_paths(script) == ["/api/posts/0/comment0", "/api/users/0/posts", "/api/a/b/0/t0", "identity/api/auth/login"]
    assert [mining.clean_path(p) for p in ("https://h//api//x/", "/api/x?a=b#c", "/about", "/api/%0a", "/api/%41/")] == ["https://h/api/x", "/api/x?a=b#c", "", "", "/api/%41"]
    assert mining.concat_paths("'/api/x/'.concat(" + "(" * 2000) == [] and mining.template_paths("`" * 3001) == []


def test_prefixes_spread_paths(spark):
    script = "a='pay/'+'api/charge';b='/api/me';c='orders/';d='orders/';e='inventory/';f='/pay/api/x'"
    rows = mining.mine_paths(spark.createDataFrame([(1, script)], "id long, script string"), "id", "script").orderBy("pos").collect()
    assert [r.path for r in rows][:4] == ["/pay/api/charge", "/orders/api/charge", "/inventory/api/charge", "/pay/api/me"] and "/pay/api/x" in [r.path for r in rows]


BUNDLE = """
fetch("/api/users", {method:"POST", headers:{a:1}, body: JSON.stringify({name: n, "age": f(1,2), ok})});
axios.get('/api/items'); axios.post(`/api/items/${item.id}/x/${f(1)}/${g()}`, {title: t, tags:[1,2]});
axios({url:"/api/cfg", method:'put', data:{q:1}}); axios.request({url:'/api/d'});
fetch(`${base}`); fetch('/logo.png'); fetch("javascript:x"); fetch("/api/opt",{body:fd});
p = "/api/users/" + id + "/posts"; z="/api/items/"+q;
"""


def test_bundles(spark):
    assert bundles.calls(BUNDLE) == [
        ("GET", "/api/items", [], "call"),
        ("POST", "/api/items/{id}/x/{param}/{param1}", ["title", "tags"], "call"),
        ("PUT", "/api/cfg", ["q"], "call"),
        ("GET", "/api/d", [], "call"),
        ("POST", "/api/users", ["name", "age", "ok"], "call"),
        ("POST", "/api/opt", [], "call"),
        ("GET", "/api/users/0/posts", [], "concat"),
        ("GET", "/api/items/0", [], "concat"),
    ]
    data = base64.b64encode(json.dumps({"sourcesContent": ["fetch('/api/mapped')", None, ""]}).encode()).decode()
    assert bundles.inline_sources(f"x\n//# sourceMappingURL=data:application/json;base64,{data}") == ["fetch('/api/mapped')"]
    assert bundles.inline_sources("//# sourceMappingURL=data:application/json,%7B") == [] == bundles.inline_sources("//# sourceMappingURL=app.js.map")
    rows = exchanges(spark, {"url": "https://a/x.js", "answer": f"fetch('/api/own')\n//# sourceMappingURL=data:application/json;base64,{data}"}, {"url": "https://a/page", "answer": "fetch('/no')", "answer_type": "text/html"}, {"url": "https://a/y.js"})
    assert [(r.seq, r.method, r.url, r.source) for r in bundles.analyze(rows).orderBy("nth").collect()] == [(0, "GET", "https://a/api/own", "static:js"), (0, "GET", "https://a/api/mapped", "static:js-sourcemap")]
    assert bundles.statistics(rows).first().asDict() == {"analyzed": 1, "skipped": 0, "from_scripts": 1, "from_sourcemaps": 1, "from_concats": 0}


def test_sensitive_names_and_pages(spark):
    names = {"_token": True, "my_token": False, "csrfmiddlewaretoken": True, "nonce": False, "state": False, "JWT": True, "signature": False, "SAMLResponse": True, "card": False, "sessionid": True}
    assert {n: one(spark, forms.is_sensitive(F.col("n")), n=n) for n in names} == names
    pages_ = {"https://a/x.json": True, "https://a/x.MJS": False, "https://a/x.bmp?y": False, "https://a/feed.xml": True, "https://a/main.js/index": True, "https://a/socket.io": False, "https://a/%zz": True}
    assert {u: one(spark, links.is_likely_page(F.col("u")), u=u) for u in pages_} == pages_


def test_pages_and_reports(spark):
    rows = exchanges(spark, {"url": "https://a/api/x", "method": "get", "answer_type": "application/json"}, {"url": "https://a/x.css"}, {"url": "https://a/api/y\u0007", "status": 0})
    assert [(r.page, r.exchanges, r.answered) for r in pages.page_sizes(rows).orderBy("page").collect()] == [("https://a/api/x", 1, 1), ("https://a/api/y\u0007", 1, 0)]
    report = pages.explain(classify.classify(rows, ["rest"])).collect()
    assert [r.line for r in report] == ["  GET    /api/x [type=rest confidence=0.95 reason=content-type:application/json+path-heuristic]"]
    assert one(spark, pages.printable(F.col("t")), t="a\u0007b\u009f") == "a\\x07b\\x9f"
    html = '<base href="/deep/"><script>var a=1</script><script src="x.js">no</script><script> </script>'
    bases = {"https://h/p": "https://h/deep/", "ftp://h/p": "ftp://h/p"}
    assert {p: spark.range(1).select(links.base_url(F.lit(html), F.lit(p))).first()[0] for p in bases} == bases
    assert spark.range(1).select(links.base_url(F.lit('<base href="http://h/">'), F.lit("https://h/p"))).first()[0] == "https://h/p"
    page = spark.createDataFrame([(1, "https://h/d/p", html)], "page_id long, url string, html string")
    assert [r.script for r in pages.inline_scripts(page).collect()] == ["var a=1"] and [r.script for r in pages.script_urls(page).collect()] == ["https://h/d/x.js"]


def test_addresses(spark):
    private = {"": True, "10.1.2.3": True, "8.8.8.8": False, "172.32.0.1": False, "100.127.255.255": True, "::": True, "::1": True, "2001:4860::1": False, "::ffff:10.0.0.1": True, "fd00:ec2::254": True, "999.1.1.1": None, "h.example": None, "x:y": None}
    assert {a: one(spark, U.is_private_ip(F.col("a")), a=a) for a in private} == private


def test_wire_formats(spark):
    assert wire.split_frames(b"\x00\x00\x00\x00\x02ab\x01\x00\x00\x00\x00\x00\x00\x00\x00\x05x") == [(False, b"ab"), (True, b"")]
    assert wire.walk_fields(bytes.fromhex("089601")) == [(1, 0, 150, b"")] and wire.walk_fields(bytes.fromhex("0d01000000")) == [(1, 5, 1, b"")]
    assert wire.walk_fields(b"\x0a\x05ab") is None and wire.walk_fields(b"\x00") is None and wire.walk_fields(b"\x08" + b"\xff" * 11) is None
    rows = spark.createDataFrame([("a", bytes.fromhex("0000000003089601")), ("b", None), ("c", b"\x01\x00\x00\x00\x01x")], "id string, body binary")
    assert [(r.id, r.field, r.number) for r in wire.fields(rows, "id", "body").collect()] == [("a", 1, 150)]


def test_bindings_fill_rows(spark):
    rows = spark.createDataFrame([(5, "a.A", ["X"]), (6, "b.B", None)], "seq long, service string, methods array<string>")
    bound = spark.createDataFrame([("b.B", "Do"), ("b.B", "Be"), ("c.C", "Go")], "service string, method string")
    assert sorted(map(tuple, enrich.fill_from_bindings(rows, bound).collect())) == [(5, "a.A", ["X"]), (6, "b.B", ["Be", "Do"]), (7, "c.C", ["Go"])]
    kept, rejected = enrich.same_origin_only(spark.createDataFrame([("https://a:443/x",), ("https://b/",), ("https://b/2",)], "url string"), "https://a/")
    assert kept.count() == 1 and [(r.origin, r.rejected) for r in rejected.collect()] == [("https://b", 2)]


def test_enrichment_asks_for_every_url(spark):
    rows = spark.range(1200).select(F.col("id").alias("seq"), F.format_string("https://a/%04d", 1199 - F.col("id")).alias("url"))
    answers = rows.union(rows.withColumn("seq", F.col("seq") + 5000)).withColumn("x", F.col("seq"))
    assert mining.enrich_by_url(rows, answers, ["x"]).filter("x = seq").count() == 1200
    few = mining.enrich_by_url(rows, answers, ["x"], most=3).filter("x IS NOT NULL").collect()
    assert {r.seq for r in few} == {0, 1, 2}


def test_introspection(spark):
    schema = {"queryType": {"name": "User"}, "types": [{"kind": "OBJECT", "name": "User", "interfaces": [{"name": "Node"}], "fields": [{"name": "tags", "args": [{"name": "n", "type": {"kind": "NON_NULL", "ofType": {"kind": "SCALAR", "name": "Int"}}}], "type": {"kind": "LIST", "ofType": {"kind": "NON_NULL", "ofType": {"kind": "SCALAR", "name": "String"}}}}, {"name": "id", "type": {"kind": "NON_NULL", "ofType": {"kind": "SCALAR", "name": "ID"}}}]}, {"kind": "ENUM", "name": "E", "enumValues": [{"name": "B"}, {"name": "A"}]}, {"kind": "SCALAR", "name": "String"}, {"kind": "OBJECT", "name": "__Type"}]}
    rows = spark.createDataFrame([(json.dumps({"data": {"__schema": schema}}),)], "answer string")
    assert {r.name: r.sdl for r in specs.introspection_sdl(rows).collect()} == {"schema": "schema {\n  query: User\n}\n", "User": "type User implements Node {\n  id: ID!\n  tags(n: Int!): [String!]\n}\n", "E": "enum E {\n  A\n  B\n}\n"}


def test_stream_equals_batch(spark, tmp_path):
    batch = views.capture(spark, "/root/testdata/sf0.001").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") % 60))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    live.first_seen(stream, "at").select("dedup_key").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    expected = {r.dedup_key for r in live.first_seen(batch, "at").collect()}
    got = [r.dedup_key for r in spark.table("seen").collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def _drained(stream, name, tmp_path, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_windows_over_a_stream(spark, tmp_path):
    batch = views.capture(spark, "/root/testdata/sf0.001").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") % 600))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = _drained(live.detected_over_time(stream, "at"), "over_time", tmp_path, "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, live.detected_over_time(batch, "at").collect())) and len(got) > 10


def test_requests_meet_their_answers(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    spark.range(20).select(F.col("id").alias("request_id"), at(F.col("id") * 10).alias("asked_at"), F.lit("GET").alias("method"), F.lit("u").alias("url")).write.parquet(str(tmp_path / "asked"))
    spark.range(20).filter("id % 3 <> 0").select(F.col("id").alias("request_id"), at(F.col("id") * 10 + F.when(F.col("id") % 5 == 0, 90).otherwise(2)).alias("told_at"), F.lit(200).alias("status")).write.parquet(str(tmp_path / "told"))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    got = _drained(live.correlate(read("asked"), read("told")), "correlated", tmp_path)
    assert {r.request_id for r in got if r.status == 200} == {i for i in range(20) if i % 3 and i % 5}


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
