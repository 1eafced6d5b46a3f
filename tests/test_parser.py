from decimal import Decimal

import pytest

from semlake.sparql import SparqlSyntaxError, parse
from semlake.sparql.ast import Call, Filter_, Group, Iri, Literal, Optional_, Triple, Union_, Var
from semlake.sparql.parser import pattern_vars

X = "PREFIX x: <http://x/> "


def one(pattern):
    return parse(X + f"SELECT * WHERE {{ {pattern} }}").where.parts


def test_prefixes_base_and_keyword_names():
    q = parse("BASE <http://b/> PREFIX : <http://d/#> SELECT ?s WHERE { ?s :order <rel> ; :limit ?lang }")
    assert q.where.parts == [Triple(Var("s"), Iri("http://d/#order"), Iri("http://b/rel")), Triple(Var("s"), Iri("http://d/#limit"), Var("lang"))]


@pytest.mark.parametrize("text,value", [
    ("1", Literal(1)), ("-1.5", Literal(Decimal("-1.5"))), ("1e3", Literal(1000.0)), ("true", Literal(True)), ("'it'", Literal("it")),
    ('"a"@en-GB', Literal("a", lang="en-gb")), ('"5"^^xsd:integer', Literal(5, "http://www.w3.org/2001/XMLSchema#integer")), (r'"q\"\nA"', Literal('q"\nA')), ('"""x "y" z"""', Literal('x "y" z')),
])
def test_literals(text, value):
    assert one(f"?s x:p {text}")[0].o == value


def test_lists_and_blank_nodes():
    parts = one("?s x:p ?a , ?b ; x:q [ x:r ?c ] . _:n x:p ?d # comment\n")
    assert [str(p.o) for p in parts][:2] == ["?a", "?b"] and len(parts) == 5
    assert pattern_vars(Group(parts)) == ["s", "a", "b", "c", "d"]


def test_precedence():
    (f,) = one("FILTER(?a || ?b && !?c = 1 + 2 * -?d)")
    assert str(f.expr) == "||(?a, &&(?b, =(!(?c), +(1, *(2, u-(?d))))))"


def test_functions_and_casts():
    (f,) = one("FILTER regex(xsd:string(?x), 'colon cancer', 'i')")
    assert f.expr == Call("REGEX", (Call("http://www.w3.org/2001/XMLSchema#string", (Var("x"),)), Literal("colon cancer"), Literal("i")))


def test_groups():
    parts = one("{ ?a x:p ?b } UNION { ?a x:q ?b } UNION { } OPTIONAL { ?a x:r ?c OPTIONAL { ?c x:s ?d } FILTER(?c > 1) } { ?e x:p ?f }")
    assert isinstance(parts[0], Union_) and len(parts[0].branches) == 3
    assert isinstance(parts[1], Optional_) and isinstance(parts[1].group.parts[1], Optional_) and isinstance(parts[1].group.parts[2], Filter_)
    assert isinstance(parts[2], Group)


def test_modifiers():
    q = parse(X + "SELECT DISTINCT ?a WHERE { ?a x:p ?b } ORDER BY DESC(?b) ASC(LCASE(?a)) ?a OFFSET 3 LIMIT 2")
    assert q.distinct and [k.descending for k in q.order] == [True, False, False] and (q.offset, q.limit) == (3, 2)
    q = parse(X + "SELECT ?a { ?a x:p ?b } LIMIT 2 OFFSET 3")
    assert (q.offset, q.limit) == (3, 2)


def test_forms():
    assert parse("ASK { ?s ?p ?o }").form == "ASK"
    assert len(parse(X + "CONSTRUCT WHERE { ?s x:p ?o . ?o x:q ?z }").template) == 2
    with pytest.raises(SparqlSyntaxError):
        parse(X + "CONSTRUCT { ?s x:p ?nowhere } WHERE { ?s x:p ?o }")


@pytest.mark.parametrize("bad", ["SELECT", "SELECT ?x { ?x }", "SELECT ?x { ?x y:p ?z }", "SELECT ?x { ?x ?p ?o ", "SELECT ?x { FILTER(bound(?x, ?y)) }", "SELECT ?x { ?s ?p ?o } LIMIT x", "ASK { ?s ?p ~ }"])
def test_errors(bad):
    with pytest.raises(SparqlSyntaxError):
        parse(bad)
