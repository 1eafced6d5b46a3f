"""Shapes of plans: how often tables are read, and which joins there are."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from semlake.engine import Engine
from semlake.lake import engine as lake
from semlake.plans import stars
from semlake.plans.catalog import Catalog
from semlake.rml.model import LogicalSource, PredicateObject, TermMap, TriplesMap, iri_map, ref
from semlake.sources.registry import SourceSpec, load

SF = "/root/testdata/sf0.001"
P = "PREFIX ex: <http://ex.org/v#> "


@pytest.fixture(scope="module")
def e(spark):
    return lake(spark, SF)


def physical(result):
    return result.df._jdf.queryExecution().executedPlan().toString()


def test_variable_predicates_read_a_table_once(e):
    text = physical(e.query(P + "SELECT ?p ?o { ?s a ex:Order ; ?p ?o }"))
    assert text.count("FileScan") == 1 and "Join" not in text
    text = physical(e.query(P + "SELECT ?p ?o ?q ?r { ?s a ex:Order ; ?p ?o ; ?q ?r }"))
    assert text.count("FileScan") == 2
    # one for each table, and one for the arrays of embeddings
    assert physical(e.query("SELECT ?s ?p ?o { ?s ?p ?o }")).count("FileScan") == 15


def test_variables_that_may_be_unbound_are_joined_by_equality(e):
    for q in (
        "SELECT * { ?d ex:toxic ?q OPTIONAL { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } } }",
        "SELECT * { { ?d ex:toxic ?q OPTIONAL { ?d ex:lang ?l } OPTIONAL { ?d ex:source ?s } OPTIONAL { ?d ex:nchars ?n } } { ?d ex:quality ?z OPTIONAL { ?d ex:lang ?l } OPTIONAL { ?d ex:source ?s } OPTIONAL { ?d ex:nchars ?n } } }",
    ):
        text = physical(e.query(P + q))
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert text.count("FileScan") <= 12


def test_frames_are_kept_between_queries(spark, monkeypatch):
    engine, calls = lake(spark, SF), []
    monkeypatch.setattr(stars, "load", lambda *a: calls.append(a) or load(*a))
    for q in ("SELECT ?n { ?n ex:inRegion ?r }", "SELECT ?r { ?n ex:inRegion ?r ; ex:name ?x }"):
        engine.query(P + q)
    assert len(calls) == 1
    engine.refresh()
    engine.query(P + "SELECT ?n { ?n ex:inRegion ?r }")
    assert len(calls) == 2
    first = engine.query("SELECT DISTINCT ?c { ?s a ?c }")
    n = len(calls)
    again = engine.query("SELECT DISTINCT ?c { ?s a ?c }")
    assert len(calls) == n and again.df.count() == first.df.count() == 14 and again.planning["plan"] < 0.3
    assert "FileScan" not in physical(again)


def test_too_many_assignments_are_unions(spark, monkeypatch):
    frames = {f"t{i}": spark.createDataFrame([(k, k * 10 + i) for k in range(3)], "id int, v int") for i in range(3)}
    maps = [TriplesMap(f"t{i}", LogicalSource("m", table=f"t{i}"), TermMap("template", "http://b/{id}", "iri"), ("http://b/T",), [PredicateObject("http://b/v", ref("v")), PredicateObject(f"http://b/w{i}", ref("v"))]) for i in range(3)]
    e = Engine(spark, Catalog([SourceSpec("m", "memory", frames=frames)], maps))
    q = "SELECT ?s ?a ?b ?c { ?s <http://b/v> ?a ; <http://b/w0> ?b ; <http://b/w1> ?c }"
    want = sorted(map(tuple, e.query(q).df.collect()))
    monkeypatch.setattr(stars, "MOST", 1)
    assert sorted(map(tuple, e.query(q).df.collect())) == want and len(want) == 9


DATA = {f"http://s/{i}": {"http://v/n": str(i), "http://v/to": f"http://s/{i % 3}"} for i in range(25)}


@pytest.fixture(scope="module")
def web():
    """An endpoint that keeps what it was asked, and answers by a table of canned queries."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            q = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
            asked.append(q)
            uri = lambda x: {"type": "uri", "value": x}
            rows = [{"s": uri(s), "x": {"type": "typed-literal", "value": d["http://v/n"], "datatype": "http://www.w3.org/2001/XMLSchema#integer"}, "t": uri(d["http://v/to"])} for s, d in DATA.items()]
            if "VALUES" in q:
                keys = q.split("{ <")[1].split("> }")[0].split("> <")
                rows = [r for r in rows if r["s"]["value"] in keys]
            if "COUNT" in q:
                rows = [{"n": {"type": "literal", "value": str(len(rows))}}]
            elif "LIMIT" in q:
                words = q.split()
                n, at = int(words[words.index("LIMIT") + 1]), int(words[words.index("OFFSET") + 1])
                rows = rows[at : at + n]
            body = json.dumps({"results": {"bindings": rows}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/sparql", asked
    server.shutdown()


V = "PREFIX v: <http://v/> "


def test_an_endpoint_is_sent_stars_filters_and_projection(spark, web):
    url, asked = web
    e = Engine(spark, Catalog([SourceSpec("web", "sparql_endpoint", url, {"page": "10"})]))
    asked.clear()
    rows = e.query(V + "SELECT ?s ?x { ?s v:n ?x ; v:to ?t ; v:kind 'a b' ; v:size 7 . FILTER(?x >= 20 && contains(str(?x), '2') && ?x < ?y) FILTER(?x != 3) }").df
    assert rows.count() == 0  # ?y is unbound
    rows = e.query(V + "SELECT DISTINCT ?s ?x { ?s v:n ?x ; v:to ?t . ?t v:kind ?k FILTER(?x >= 20 && contains(str(?x), '2')) }").df
    asked.clear()
    assert sorted(r.x for r in rows.collect()) == ["20", "21", "22", "23", "24"]
    assert len(asked) == 4 and asked[0].startswith("SELECT (COUNT(*) AS ?n) WHERE { {") and "OFFSET 20" in asked[-1] + asked[-2] + asked[-3]
    sent = asked[1]
    assert sent.startswith("SELECT DISTINCT ?s ?x WHERE { ") and "?s <http://v/n> ?x ." in sent and "?s <http://v/to> ?t ." in sent and "?t <http://v/kind> ?k ." in sent
    assert '(<http://www.w3.org/2001/XMLSchema#double>(str(?x)) >= 20) && (contains(str(?x), "2"))' in sent and "ORDER BY ?s ?x LIMIT 10" in sent
    e.query(V + "SELECT ?s { ?s v:n ?x ; v:kind 'a b' ; v:size 7 }").df.collect()
    assert 'isLiteral(?o1_) && str(?o1_) = "a b"' in asked[-1] and "<http://www.w3.org/2001/XMLSchema#double>(str(?o2_)) = 7" in asked[-1]


def test_an_endpoint_is_asked_for_the_keys_of_a_small_side(spark, web, tmp_path):
    url, asked = web
    spark.createDataFrame([(3, "c"), (17, "q"), (99, "z")], "id int, name string").coalesce(1).write.parquet(str(tmp_path / "m.parquet"))
    tm = TriplesMap("m", LogicalSource("mem", table="m"), TermMap("template", "http://m/{id}", "iri"), ("http://m/M",), [PredicateObject("http://m/name", ref("name")), PredicateObject("http://m/is", iri_map("http://s/{id}"))])
    q = V + "SELECT ?name ?x { ?m <http://m/name> ?name ; <http://m/is> ?s . ?s v:n ?x ; v:to ?t }"
    for bind, bound in (("auto", True), ("never", False), ("always", True)):
        e = Engine(spark, Catalog([SourceSpec("mem", "parquet", str(tmp_path)), SourceSpec("web", "sparql_endpoint", url, {"page": "10", "bind": bind}, predicates=("http://v/n", "http://v/to"))], [tm]))
        df = e.query(q).df
        asked.clear()
        assert sorted(map(tuple, df.collect())) == [("c", "3"), ("q", "17")]
        values = [x for x in asked if "VALUES ?s {" in x]
        assert bool(values) == bound
        if bound:
            assert len(asked) == len(values) and all("<http://s/3>" in x or "<http://s/17>" in x or "<http://s/99>" in x for x in values)


def test_databases(spark):
    """Derby, which Spark brings along, as a database: columns, filters, queries, partitions; and a catalog of it."""
    url = "jdbc:derby:memory:lake;create=true"
    people = spark.createDataFrame([(1, "ann", 2), (2, "bob", 1), (3, "cat", None)], "ID int, NAME string, BOSS int")
    people.write.option("createTableColumnTypes", "NAME VARCHAR(64)").jdbc(url, "PEOPLE", "overwrite", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})

    def ask(logical, **params):
        tm = TriplesMap("p", logical, TermMap("template", "http://b/p/{ID}", "iri"), ("http://b/P",), [PredicateObject("http://b/name", ref("NAME")), PredicateObject("http://b/boss", iri_map("http://b/p/{BOSS}"))], owner="db")
        e = Engine(spark, Catalog([SourceSpec("db", "derby", url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", **params})], [tm]))
        return e.query("SELECT ?n ?m { ?p <http://b/name> ?n ; <http://b/boss> ?b . ?b <http://b/name> ?m FILTER(?n != 'zed') }").df

    want = [("ann", "bob"), ("bob", "ann")]
    table, query = LogicalSource("db", table="PEOPLE"), LogicalSource("db", query="SELECT * FROM PEOPLE WHERE ID < 3")
    assert sorted(map(tuple, ask(table).collect())) == want
    split = {"partitionColumn": "ID", "lowerBound": "1", "upperBound": "3", "numPartitions": "2"}
    assert sorted(map(tuple, ask(query, **split).collect())) == want
    text = ask(table)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(ID)" in text or "IsNotNull(BOSS)" in text
    listed = ask(LogicalSource("db", table="APP.PEOPLE"), catalog="true", username="APP")
    assert sorted(map(tuple, listed.collect())) == want and "PushedFilters" in listed._jdf.queryExecution().executedPlan().toString()
