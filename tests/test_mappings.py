import json

import pytest

from semlake.engine import Engine
from semlake.plans.catalog import Catalog, Molecule
from semlake.rml import load_rml, read_turtle
from semlake.rml.turtle import TurtleError

RML = """
@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix v: <http://v/> . @base <http://maps/> .
<#drug> rml:logicalSource [ rml:source "drug.tsv" ; rml:referenceFormulation ql:TSV ] ;
  rr:subjectMap [ rr:template "http://d/drug/{id}" ; rr:class v:Drug ] ;
  rr:predicateObjectMap [ rr:predicate v:label ; rr:objectMap [ rml:reference "label" ; rr:language "en" ] ] ;
  rr:predicateObjectMap [ rr:predicate v:mass ; rr:objectMap [ rml:reference "mass" ; rr:datatype xsd:double ] ] ;
  rr:predicateObjectMap [ rr:predicate v:same ; rr:objectMap [ rr:template "{same}" ] ] ;
  rr:predicateObjectMap [ rr:predicate v:kind , v:type ; rr:object v:Thing ] ;
  rr:predicateObjectMap [ rr:predicate v:target ; rr:objectMap [ rr:parentTriplesMap <#target> ; rr:joinCondition [ rr:child "t" ; rr:parent "id" ] ] ] .
<#target> rml:logicalSource [ rml:source "target.tsv" ] ; rr:subjectMap [ rr:template "http://d/target/{id}" ] ;
  rr:predicateObjectMap [ rr:predicate v:label ; rr:objectMap [ rml:reference "label" ] ] .
"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("lake")
    (at / "drug.tsv").write_text("id\tlabel\tmass\tsame\tt\nA 1\taspirin\t180.2\thttp://e/x\t7\nB\t\t\t\t8\nC_1\tcure\tbad\tplain\t\n")
    (at / "target.tsv").write_text("id\tlabel\n7\tseven\n8\teight\n9\tnine\n")
    (at / "maps.ttl").write_text(RML)
    (at / "rdf.nt").write_text('<http://e/x> <http://v/note> "caf\\u00e9 \\"q\\""@en .\n<http://e/x> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://v/Extern> .\n_:b <http://v/note> "5"^^<http://www.w3.org/2001/XMLSchema#integer> . # tail\n\n# comment\n')
    config = {
        "templates": [{"rootType": "http://v/Extern", "predicates": [{"predicate": "http://v/note", "range": []}], "linkedTo": [], "datasources": [{"datasource": "rdf", "predicates": ["http://v/note"]}]}],
        "datasources": [
            {"name": "files", "ID": "files", "url": str(at), "type": "LOCAL_TSV", "params": "username:u;password:p", "mappings": ["maps.ttl"]},
            {"name": "rdf", "ID": "rdf", "url": str(at / "rdf.nt"), "type": "SPARQL_Endpoint", "params": {}, "mappings": []},
        ],
    }
    (at / "config.json").write_text(json.dumps(config))
    return Engine(spark, Catalog.from_json(at / "config.json"))


def rows(engine, q):
    return sorted((tuple(r) for r in engine.query("PREFIX v: <http://v/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> " + q).df.collect()), key=str)


def test_turtle():
    assert read_turtle('@prefix a: <http://a/> . a:s a a:C ; a:p "x"@en , 1.5 , true , [ a:q ( 1 2 ) ] .')[0] == (("uri", "http://a/s", None, None), "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", ("uri", "http://a/C", None, None))
    with pytest.raises(TurtleError):
        read_turtle("a:s a:p a:o .")


def test_loaded():
    drug, target = load_rml(RML)
    assert drug.classes == ("http://v/Drug",) and target.classes == ("http://maps/#target",)
    assert drug.predicates() == ["http://v/" + p for p in ("label", "mass", "same", "kind", "type", "target")]


def test_terms(engine):
    assert rows(engine, "SELECT ?d ?m { ?d v:mass ?m }") == [("http://d/drug/A_1", 180.2)]
    assert rows(engine, "SELECT ?d ?s { ?d v:same ?s }") == [("http://d/drug/A_1", "http://e/x"), ("http://d/drug/C_1", "plain")]
    assert rows(engine, "SELECT ?t { <http://d/drug/A_1> v:target ?t }") == [("http://d/target/7",)]
    assert rows(engine, "SELECT ?d { ?d v:label 'aspirin'@en }") == [("http://d/drug/A_1",)] and rows(engine, "SELECT ?d { ?d v:label 'aspirin'@de }") == []
    assert rows(engine, "SELECT ?k { <http://d/drug/B> v:kind ?k }") == [("http://v/Thing",)]
    assert rows(engine, "SELECT ?x { ?d v:label ?x ; v:same ?y FILTER(langMatches(lang(?x), 'EN')) }") == [("aspirin",), ("cure",)]


def test_joins_across_sources(engine):
    assert rows(engine, "SELECT ?d ?n { ?d v:same ?s . ?s v:note ?n }") == [("http://d/drug/A_1", 'café "q"')]
    assert rows(engine, "SELECT ?d ?l { ?d v:target ?t . ?t v:label ?l }") == [("http://d/drug/A_1", "seven"), ("http://d/drug/B", "eight")]
    assert rows(engine, "SELECT ?n { ?s v:note ?n FILTER(?n > 4) }") == [("5",)]
    assert rows(engine, "SELECT ?n { ?s v:note ?n FILTER(datatype(?n) = xsd:integer || lang(?n) = 'en') }") == [("5",), ('café "q"',)]
    assert rows(engine, "SELECT DISTINCT ?c { ?s a ?c }") == [("http://maps/#target",), ("http://v/Drug",), ("http://v/Extern",)]


def test_unanswerable_branches(engine):
    assert rows(engine, "SELECT ?d ?z { ?d v:mass ?m OPTIONAL { ?d v:nothing ?z } }") == [("http://d/drug/A_1", None)]
    assert rows(engine, "SELECT ?d { { ?d v:mass ?m } UNION { ?d v:nothing ?m } }") == [("http://d/drug/A_1",)]
    assert rows(engine, "SELECT ?d { ?d v:mass ?m ; v:nothing ?z }") == []


def test_molecules_and_config(engine):
    catalog = engine.catalog
    assert catalog.molecules["http://v/Drug"].predicates["http://v/target"] == {"http://maps/#target"} and "http://maps/#target" in catalog.molecules["http://v/Drug"].links
    again = catalog.to_json()
    assert {t["rootType"] for t in again["templates"]} == {"http://v/Drug", "http://v/Extern", "http://maps/#target"}
    assert all("password" not in d["params"] for d in again["datasources"])
    m = Molecule("c", {"p": {"a"}})
    m.merge(Molecule("c", {"p": {"b"}, "q": set()}, {"l"}, {"s": {"p"}}))
    assert m.predicates == {"p": {"a", "b"}, "q": set()} and m.links == {"l"}


def test_endpoint_over_http(spark):
    """A partitioned read of an endpoint that answers pages."""
    import threading
    import urllib.parse
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from semlake.sources.registry import SourceSpec

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            q = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
            if "COUNT" in q:
                bindings = [{"n": {"type": "literal", "value": "25"}}]
            else:
                at = int(q.rsplit(None, 1)[1])
                bindings = [{"s": {"type": "uri", "value": f"http://s/{i}"}, "p": {"type": "uri", "value": "http://v/n"}, "o": {"type": "typed-literal", "value": str(i), "datatype": "http://www.w3.org/2001/XMLSchema#integer"}} for i in range(at, min(at + 10, 25))]
            body = json.dumps({"results": {"bindings": bindings}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = Engine(spark, Catalog([SourceSpec("web", "sparql_endpoint", f"http://127.0.0.1:{server.server_port}/sparql", {"page": "10"})]))
    assert rows(e, "SELECT ?s { ?s v:n ?x FILTER(?x >= 23) }") == [("http://s/23",), ("http://s/24",)]
    server.shutdown()
