"""Kinds, languages and datatypes of results; N-Triples in and out; open results of the service; metadata."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semlake.engine import Engine
from semlake.plans.catalog import Catalog, catalog_of_graph, graph_of_catalog, molecules_of_ontology
from semlake.plans.discovery import discover
from semlake.rml.model import LogicalSource, PredicateObject, TermMap, TriplesMap, iri_map, ref
from semlake.service import Closed, Service
from semlake.sources.registry import SourceSpec
from semlake.sources.triples import read_ntriples, triple_frame, write_ntriples

XSD = "http://www.w3.org/2001/XMLSchema#"


@pytest.fixture(scope="module")
def engine(spark):
    t = spark.createDataFrame([(1, "http://not/an/iri", "mailto:x@y.z", 2.5, True)], "id long, v string, m string, x double, b boolean")
    tm = TriplesMap("t", LogicalSource("m", table="t"), TermMap("template", "http://b/{id}", "iri"), ("http://b/T",), [PredicateObject("http://b/v", ref("v", lang="en")), PredicateObject("http://b/m", iri_map("{m}")), PredicateObject("http://b/x", ref("x")), PredicateObject("http://b/b", ref("b")), PredicateObject("http://b/plain", ref("v")), PredicateObject("http://b/id", ref("id"))])
    return Engine(spark, Catalog([SourceSpec("m", "memory", frames={"t": t})], [tm]))


def test_kinds_come_from_the_plan(engine):
    q = "SELECT ?v ?m ?x ?b ?p ?i { ?s <http://b/v> ?v ; <http://b/m> ?m ; <http://b/x> ?x ; <http://b/b> ?b ; <http://b/plain> ?p ; <http://b/id> ?i }"
    (row,) = engine.query(q).to_dict()["result"]
    assert row == {
        "v": {"type": "literal", "value": "http://not/an/iri", "xml:lang": "en"}, "m": {"type": "uri", "value": "mailto:x@y.z"}, "x": {"type": "typed-literal", "value": "2.5", "datatype": XSD + "double"},
        "b": {"type": "typed-literal", "value": "true", "datatype": XSD + "boolean"}, "p": {"type": "literal", "value": "http://not/an/iri"}, "i": {"type": "typed-literal", "value": "1", "datatype": XSD + "integer"},
    }
    rows = {r["p"]["value"][-1]: r["o"] for r in engine.query("SELECT ?p ?o { ?s ?p ?o }").to_dict()["result"]}
    assert rows["v"]["xml:lang"] == "en" and rows["m"] == {"type": "uri", "value": "mailto:x@y.z"} and rows["x"]["datatype"] == XSD + "double"
    made = engine.query("CONSTRUCT { ?s <http://b/m> ?m . ?s <http://b/n> 5 } WHERE { ?s <http://b/m> ?m }").to_dict()["result"]
    assert {(r["s"]["type"], r["o"]["type"]) for r in made} == {("uri", "uri"), ("uri", "typed-literal")}
    assert engine.query("SELECT ?z { ?s <http://b/m> ?m OPTIONAL { ?s <http://b/none> ?z } }").to_dict()["result"] == [{}]


def test_open_results_are_apart(engine, spark):
    spark.createDataFrame([(i,) for i in range(3)], "id int").createOrReplaceTempView("some")
    t = spark.table("some")
    tm = TriplesMap("t", LogicalSource("m", table="t"), TermMap("template", "http://b/{id}", "iri"), ("http://b/T",), [PredicateObject("http://b/id", ref("id"))])
    service = Service(Engine(spark, Catalog([SourceSpec("m", "memory", frames={"t": t})], [tm])), most_open=2)
    q = "SELECT ?i { ?s <http://b/id> ?i }"
    a, b = service.sparql(q, False), service.sparql(q, False)
    with pytest.raises(Closed):
        service.next_result(q)  # whose?
    for one in (a, b):
        rows = [one["result"][0]["i"]["value"]]
        while row := service.next_result(id=one["id"])["result"]:
            rows.append(row[0]["i"]["value"])
        assert sorted(rows) == ["0", "1", "2"] and service.next_result(id=one["id"])["result"] == []
    first = service.sparql(q, False)
    service.sparql(q, False)
    service.sparql(q, False)
    with pytest.raises(Closed):
        service.next_result(id=first["id"])
    with pytest.raises(Closed):
        service.next_result("SELECT ?never { ?s ?p ?o }")
    assert service.sparql("ASK { ?s <http://b/id> 1 }", False)["result"] is True


_text = st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=12)


@given(st.lists(st.tuples(_text, _text), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_ntriples_round_trip(spark, tmp_path_factory, pairs):
    rows = [(f"http://s/{i}{a}", "uri", "http://p/é", b, "literal" if i % 3 else "uri", None if i % 2 or i % 3 == 0 else XSD + "token", None) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string")
    path = str(tmp_path_factory.mktemp("nt") / "x")
    write_ntriples(df, path)
    assert sorted(map(tuple, read_ntriples(spark, path).collect()), key=str) == sorted(rows, key=str)


def test_ntriples_lines(spark, tmp_path):
    long = "x\\u00e9" * 5000
    (tmp_path / "a.nt").write_text(f'# c\n\n_:b1 <http://p/\\u00e9> "{long}"@en-GB .\n<http://s> <http://p> "\\U0001F600 \\uD83D\\uDE00 tab\\t\ty \\\\u0041"^^<http://d> . # c\n<http://s> <http://p> _:b1 .\n')
    rows = {r.o_kind + (r.o_lang or ""): r for r in read_ntriples(spark, str(tmp_path / "a.nt")).collect()}
    assert rows["literalen-gb"].o == "xé" * 5000 and rows["literalen-gb"].p == "http://p/é" and rows["literalen-gb"].s_kind == "bnode" and rows["bnode"].o == "b1"
    assert rows["literal"].o == "\U0001F600 \U0001F600 tab\t\ty \\u0041" and rows["literal"].o_datatype == "http://d"
    (tmp_path / "b.nt").write_text('<http://s> <http://p> "a" .\n<http://s> <http://p> nonsense .\n')
    assert read_ntriples(spark, str(tmp_path / "b.nt"), "drop").count() == 1
    with pytest.raises(Exception, match="no triple: <http://s> <http://p> nonsense"):
        read_ntriples(spark, str(tmp_path / "b.nt")).collect()


def test_blank_nodes_of_two_sources_differ(spark, tmp_path):
    (tmp_path / "a.nt").write_text("<http://s/1> <http://p/in> _:x .\n")
    (tmp_path / "b.nt").write_text('_:x <http://p/name> "other" .\n')
    both = Catalog([SourceSpec(n, "ntriples", str(tmp_path / f"{n}.nt")) for n in ("a", "b")])
    assert Engine(spark, both).query("SELECT ?n { ?s <http://p/in> ?b . ?b <http://p/name> ?n }").df.count() == 0
    (tmp_path / "c.nt").write_text('<http://s/1> <http://p/in> _:x .\n_:x <http://p/name> "mine" .\n')
    one = Engine(spark, Catalog([SourceSpec("c", "ntriples", str(tmp_path / "c.nt"))]))
    assert [r.n for r in one.query("SELECT ?n { ?s <http://p/in> ?b . ?b <http://p/name> ?n FILTER(isBlank(?b)) }").df.collect()] == ["mine"]
    assert one.query("SELECT ?b { <http://s/1> <http://p/in> ?b }").to_dict()["result"] == [{"b": {"type": "bnode", "value": "x"}}]


def test_metadata_graph_and_ontology(spark, tmp_path):
    tm = TriplesMap("t", LogicalSource("m", table="t"), TermMap("template", "http://b/{id}", "iri"), ("http://b/T",), [PredicateObject("http://b/to", iri_map("http://b/{to}")), PredicateObject("http://b/v", ref("v"))])
    known = Catalog([SourceSpec("m", "parquet", "/x")], [tm])
    again = catalog_of_graph(graph_of_catalog(spark, known, "http://own/v#"), "http://own/v#")
    m = again.molecules["http://b/T"]
    assert m.predicates == {"http://b/to": {"http://b/T"}, "http://b/v": set()} and m.links == {"http://b/T"} and m.sources == {"m": {"http://b/to", "http://b/v"}} and again.sources["m"].url == "/x"
    assert catalog_of_graph(graph_of_catalog(spark, known)).molecules.keys() == {"http://b/T"}
    uri, rdfs = lambda x: ("uri", x, None, None), "http://www.w3.org/2000/01/rdf-schema#"
    ontology = triple_frame(spark, [(uri("p"), rdfs + "domain", uri("A")), (uri("p"), rdfs + "range", uri("B")), (uri("q"), rdfs + "domain", uri("A")), (uri("q"), rdfs + "range", uri(XSD + "string")), (uri("C"), rdfs + "subClassOf", uri("D")), (uri("D"), rdfs + "subClassOf", uri("A"))])
    want = {(c, p, r) for c in "ACD" for p, r in (("p", "B"), ("q", None))}
    assert set(map(tuple, molecules_of_ontology(ontology).collect())) == want
    (tmp_path / "a.nt").write_text('<http://s/1> <http://p/x> "1" .\n')
    found = discover(spark, Catalog([SourceSpec("a", "ntriples", str(tmp_path / "a.nt"))]), ontologies={"a": ontology})
    assert found.molecules.keys() == {"A", "C", "D"} and found.molecules["A"].sources == {"a": {"p", "q"}}


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    from semlake import scratch

    class Context:
        master, applicationId = "spark://x:7077", "a"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://y/z/"}
    assert scratch.shared_dir(Session()) == "hdfs://y/z"
