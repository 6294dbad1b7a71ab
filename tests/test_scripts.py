"""Addresses in scripts through variables, and budgets of endpoints."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import url as U
from quillspan.operators import bundles, mining, scripts
from quillspan.plans import operations, probes, web


@pytest.mark.parametrize(
    ("script", "found"),
    [
        ('var u="/api/y";fetch(u)', [("GET", "/api/y")]),
        ('function g(){if(a){var v="/v"}fetch(v)}fetch(v)', [("GET", "/v")]),
        ('let u="/a";{const u="/b";fetch(u)}fetch(u)', [("GET", "/b"), ("GET", "/a")]),
        ('var u="/a";u+="/b";fetch(u)', []),
        ('const {u}=o;fetch(u)', []),
        ('try{}catch(u){fetch(u)}', []),
        ('const f=function(u){return fetch(u)};const u="/x"', []),
        ('const u="/x";class A{m(u){fetch(u)}n(){fetch(u)}}', [("GET", "/x")]),
        ('const u="/x";a.map(u=>u+1);fetch(u)', [("GET", "/x")]),
        ('const u="/a"+v+"/c";const v="/b";fetch(u,{method:m});const m="patch"', [("PATCH", "/a/b/c")]),
        ('const a=b;const b=a;fetch(a)', []),
        ('x.open("GET","/a");y.open("/b");window.open("/c")', [("GET", "/a"), ("GET", "/c")]),
        ('jQuery.getJSON("/a",d);$.post("/b",{k:1});$.ajax("/c",{method:"put"});$.ajax(o);const o={url:"/d"}', [("GET", "/a"), ("POST", "/b"), ("PUT", "/c"), ("GET", "/d")]),
        ('location="/a";document.location.replace("/b");if(location==="/c"){}my.location="/d"', [("GET", "/a"), ("GET", "/b")]),
        ('obj.fetch("/no");window.fetch("/a");x=a/b/c;fetch("/b\\x2fc")', [("GET", "/a"), ("GET", "/b/c")]),
        ('/* fetch("/no") */ x=`${`fetch("/no")`}`; y="fetch(\'/no\')"', []),
        ("fetch(", []),
        ('fetch(("/a"))}}}]])', [("GET", "/a")]),
    ],
)
def test_calls_through_names(script, found):
    assert [(m, a) for m, a, _, _ in scripts.sinks(script)] == found


def test_calls_of_bundles():
    assert bundles.calls("const A='/api';fetch(`${A}/x/${id}`);fetch(`${b}/y`)") == [("GET", "/api/x/{id}", [], "call"), ("GET", "{b}/y", [], "call")]
    assert bundles.calls("axios.delete('/d',{data:{a:1},params:{b:2}})") == [("DELETE", "/d", ["a"], "call")]


def test_budget_keeps_places_for_joined_paths():
    some = lambda n, source: [{"source": source, "n": i} for i in range(n)]
    count = lambda kept: (sum(e["source"] != bundles.CONCAT for e in kept), sum(e["source"] == bundles.CONCAT for e in kept))
    assert count(bundles.within_budget(some(600, "a") + some(20, bundles.CONCAT))) == (484, 16)
    assert count(bundles.within_budget(some(10, "a") + some(600, bundles.CONCAT))) == (10, 490)
    assert count(bundles.within_budget(some(600, "a") + some(3, bundles.CONCAT))) == (497, 3)
    assert count(bundles.within_budget(some(9, "a") + some(9, bundles.CONCAT), 6)) == (3, 3)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_path_mining_scans_each_script_once_in_many_tasks(spark, tmp_path):
    """However few bytes the table has: 1,000 rows of one file."""
    spark.range(1000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'O' AS o_orderstatus").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = operations.api_path_mining(spark, str(tmp_path))
    plan = _plan(found)
    assert plan.count("ArrowEvalPython") == 1 and f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in plan
    assert found.count() == 1000 * 11 + 500 + 666


def test_rows_of_one_id_are_one_script_of_several_parts(spark):
    rows = spark.createDataFrame([(1, "x('/api/a');y('/api/b')"), (1, "y('/api/b');z(`/api/c/${d}`)"), (2, ""), (3, None)], "id long, script string")
    found = mining.mine_paths(rows, "id", "script").collect()
    assert sorted((r.id, r.path) for r in found) == [(1, "/api/a"), (1, "/api/b"), (1, "/api/c/{param}")] and sorted(r.pos for r in found) == [0, 1, 2]


def test_templates_and_holes_are_found_where_they_begin():
    assert mining.template_paths("a`/api/${x}/${f({a:`}`})}`;b`$/api/${`;c`/v1/\\`$`;d`/api/z") == ["/api/{param}/{param}", "/api/${", "/v1/\\`$"]
    assert mining.fill_holes("${a}${${}$${b}", str.upper) == "A${$B"


def test_bundles_are_dealt_out_before_they_are_made(spark, tmp_path):
    """However few bytes the tables have: 300 rows of one file each; the filter of a bundle's size makes no second copy of it below the shuffle."""
    spark.range(300).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = probes.bundle_endpoints(spark, str(tmp_path))
    above, _, below = _plan(found).partition(f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})")
    assert "fetch(" in above and below and "fetch(" not in below
    assert found.count() == 2 * 300 + 2 * 150 + 150 + 100
    spark.range(50).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = web.bundle_budget(spark, str(tmp_path))
    above, _, below = _plan(found).partition(f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})")
    assert "fetch(" in above and below and "fetch(" not in below
    assert {(r.seq % 5, r.calls, r.joined) for r in found.collect()} == {(0, 401, 1), (1, 451, 11), (2, 484, 16), (3, 484, 16), (4, 484, 16)}


def test_tokens_and_fields():
    text = "a=`b${`c`}`/d/e;return /[/`]/g;`xé'y\n'z'`"
    assert [t[1] for t in scripts.tokens(text)] == ["a", "=", "`b${`c`}`", "/", "d", "/", "e", ";", "return", "/[/`]/g", ";", "`xé'y\n'z'`"]
    assert bundles.fields('{a:1,"b":[c,{d:1}],e,...f,\'g\':","}') == ["a", "b", "e", "g"]


def test_plain_addresses_are_told_as_others_are(spark):
    urls = ["https://a.b/c?d=e", "HTTP://a:80/", "http://a", "http://u@a/", "http:///x", "ftp://a/", "http://a/%zz", "http://a/\\u0001", "http://[::1]/", "http://a:b/", "https://a/{id}/x", "/x", None, "http://a/b\\n"]
    urls = [u and u.encode().decode("unicode_escape") for u in urls]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(U.is_admissible(F.col("u")), U.root(F.col("u"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False, False, False, False, True, False, True, False, False, False]
    assert [r[1] for r in got][:3] == ["https://a.b", "http://a:80", "http://a"] and got[11][1] == "://" and got[12][1] is None
