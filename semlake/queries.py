"""One query for each operator and pattern, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .lake import BASE, EX, engine, maps
from .plans.catalog import Catalog
from .rml.model import Join, LogicalSource, ObjectMap, PredicateObject, TermMap, TriplesMap, iri_map, ref
from .scratch import shared_path
from .sources.graph import hop
from .sources.registry import SourceSpec
from .sources.triples import write_ntriples

PREFIXES = f"PREFIX ex: <{EX}>\nPREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"


def iri(table: str, *keys: str) -> str:
    """SQL of an IRI."""
    return f"'{BASE}/{table}/' || " + " || '-' || ".join(keys)


ORDER, CUSTOMER, NATION, REGION, SUPPLIER, PART, DOC, EVENT = (iri("order", "o_orderkey"), iri("customer", "c_custkey"), iri("nation", "n_nationkey"), iri("region", "r_regionkey"), iri("supplier", "s_suppkey"), iri("part", "p_partkey"), iri("doc", "doc_id"), iri("event", "event_id"))

#: name -> (query without prefixes, SQL)
SPARQL: dict[str, tuple[str, str]] = {
    # scans, projection, constants
    "scan_star_orders": ("SELECT ?o ?status ?total WHERE { ?o a ex:Order ; ex:status ?status ; ex:total ?total }", f"select {ORDER} o, o_orderstatus status, o_totalprice total from orders"),
    "scan_composite_template": ("SELECT ?t ?role WHERE { ?t a ex:Turn ; ex:role ?role }", f"select {iri('turn', 'conv_id', 'turn')} t, role from conversations"),
    "scan_bare_template": ("SELECT ?p ?url WHERE { ?p ex:url ?url }", f"select {iri('page', 'page_id')} p, replace(url, ' ', '_') url from pages where url <> ''"),
    "select_star": ("SELECT * WHERE { ?n ex:inRegion ?r . ?r ex:name ?name }", f"select {NATION} n, {REGION} r, r_name name from nation join region on n_regionkey = r_regionkey"),
    "never_bound": ("SELECT ?name ?nowhere WHERE { ?r a ex:Region ; ex:name ?name }", "select r_name as name, cast(null as varchar) nowhere from region"),
    "const_literal_object": ('SELECT ?c WHERE { ?c ex:segment "BUILDING" }', f"select {CUSTOMER} c from customer where c_mktsegment = 'BUILDING'"),
    "const_number_object": ("SELECT ?p WHERE { ?p ex:size 7 }", f"select {PART} p from part where p_size = 7"),
    "const_iri_object": (f"SELECT ?n WHERE {{ ?n ex:inRegion <{BASE}/region/1> }}", f"select {NATION} n from nation where n_regionkey = 1"),
    "const_subject": (f"SELECT ?n WHERE {{ <{BASE}/customer/5> ex:name ?n }}", "select c_name n from customer where c_custkey = 5"),
    "const_composite_subject": (f"SELECT ?role ?text WHERE {{ <{BASE}/turn/3-1> ex:role ?role ; ex:text ?text }}", "select role, text from conversations where conv_id = 3 and turn = 1"),
    "const_iri_foreign_prefix": (f"SELECT ?x WHERE {{ {{ ?x ex:inRegion <http://elsewhere.org/region/1> }} UNION {{ ?x ex:inRegion <{BASE}/region/2> }} }}", f"select {NATION} x from nation where n_regionkey = 2"),
    "const_iri_bare_template": ("SELECT ?p WHERE { ?p ex:url ?u FILTER(regex(?u, '^https')) }", f"select {iri('page', 'page_id')} p from pages where regexp_matches(url, '^https')"),
    # joins
    "join_so_2star": ("SELECT ?o ?name WHERE { ?o ex:by ?c . ?c ex:name ?name }", f"select {ORDER} o, c_name as name from orders join customer on o_custkey = c_custkey"),
    "join_so_4star": (
        "SELECT ?o ?total ?name ?region WHERE { ?o ex:by ?c ; ex:total ?total . ?c ex:name ?name ; ex:ofNation ?n . ?n ex:inRegion ?r . ?r ex:name ?region }",
        f"select {ORDER} o, o_totalprice total, c_name as name, r_name region from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    ),
    "join_oo_literal": ("SELECT ?a ?b WHERE { ?a ex:brand ?x ; ex:size ?s . ?b ex:brand ?x ; ex:size ?s ; ex:price ?p FILTER(?p > 995) }", f"select {iri('part', 'a.p_partkey')} a, {iri('part', 'b.p_partkey')} b from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size where b.p_retailprice > 995"),
    "join_oo_iri": ("SELECT ?c ?s WHERE { ?c ex:segment ?g ; ex:ofNation ?n . ?s a ex:Supplier ; ex:ofNation ?n }", f"select {CUSTOMER} c, {SUPPLIER} s from customer join supplier on c_nationkey = s_nationkey"),
    "join_cross": ("SELECT ?a ?b WHERE { ?x a ex:Region ; ex:name ?a . ?y a ex:Region ; ex:name ?b }", "select a.r_name a, b.r_name b from region a cross join region b"),
    "join_non_unique_subject": ("SELECT ?l ?q ?f WHERE { ?l ex:qty ?q ; ex:flag ?f ; ex:ofOrder ?o . ?o ex:priority '1-URGENT' }", f"select {iri('lineitem', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} l, l_quantity q, l_returnflag f from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT'"),
    "star_cross_source": ("SELECT ?d ?lang ?q WHERE { ?d ex:lang ?lang ; ex:quality ?q }", f"select {DOC} d, lang, quality q from documents join labels using (doc_id)"),
    "star_same_object": ("SELECT ?d WHERE { ?d ex:quality ?x ; ex:toxic ?x }", f"select {DOC} d from labels where quality = toxic"),
    "join_disjoint_templates": ("SELECT ?x ?n WHERE { { ?o ex:by ?x . ?x ex:inRegion ?n } UNION { ?x ex:inRegion ?n } }", f"select {NATION} x, {iri('region', 'n_regionkey')} n from nation"),
    "join_revenue_by_supplier": (
        "SELECT ?s ?name ?price ?qty WHERE { ?l ex:ofSupplier ?s ; ex:extprice ?price ; ex:qty ?qty ; ex:ofPart ?p . ?s ex:name ?name . ?p ex:size ?z FILTER(?z < 5 && ?qty >= 45) }",
        f"select {SUPPLIER} s, s_name as name, l_extendedprice price, l_quantity qty from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey where p_size < 5 and l_quantity >= 45",
    ),
    # OPTIONAL
    "optional_basic": ("SELECT ?d ?q WHERE { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } }", f"select {DOC} d, quality q from documents left join labels using (doc_id)"),
    "optional_filter": ("SELECT ?c ?o WHERE { ?c ex:segment 'BUILDING' OPTIONAL { ?o ex:by ?c ; ex:total ?t FILTER(?t > 300000) } }", f"select {CUSTOMER} c, {ORDER} o from customer left join orders on o_custkey = c_custkey and o_totalprice > 300000 where c_mktsegment = 'BUILDING'"),
    "optional_filter_outer_variable": ("SELECT ?c ?o WHERE { ?c ex:acctbal ?b ; ex:segment ?g OPTIONAL { ?o ex:by ?c ; ex:total ?t FILTER(?t > ?b * 40) } }", f"select {CUSTOMER} c, {ORDER} o from customer left join orders on o_custkey = c_custkey and o_totalprice > c_acctbal * 40"),
    "optional_two_stars": ("SELECT ?e ?seg ?n WHERE { ?e ex:etype 'click' OPTIONAL { ?e ex:user ?u . ?u ex:segment ?seg ; ex:ofNation ?na . ?na ex:name ?n } }", f"select {EVENT} e, c_mktsegment seg, n_name n from events left join (customer join nation on c_nationkey = n_nationkey) on user_id = c_custkey where event_type = 'click'"),
    "optional_nested": (
        "SELECT ?c ?o ?l WHERE { ?c ex:segment 'MACHINERY' OPTIONAL { ?o ex:by ?c ; ex:status 'P' OPTIONAL { ?l ex:ofOrder ?o ; ex:qty ?q FILTER(?q > 48) } } }",
        f"select {CUSTOMER} c, {ORDER} o, {iri('lineitem', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} l from customer left join (select * from orders where o_orderstatus = 'P') o on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey and l_quantity > 48 where c_mktsegment = 'MACHINERY'",
    ),
    "optional_then_join_compat": (
        "SELECT ?n ?s ?b WHERE { ?n ex:inRegion ?r ; ex:name ?nn OPTIONAL { ?s a ex:Supplier ; ex:ofNation ?n ; ex:acctbal ?b FILTER(?b > 9000) } OPTIONAL { ?s a ex:Supplier ; ex:acctbal ?b FILTER(?b > 9900) } }",
        f"""with f as (select n_nationkey, {NATION} n, s1.s_suppkey k1, s1.s_acctbal b1 from nation left join supplier s1 on s1.s_nationkey = n_nationkey and s1.s_acctbal > 9000)
        select n, 'http://ex.org/supplier/' || coalesce(k1, s_suppkey) s, coalesce(b1, s_acctbal) b from f left join supplier on s_acctbal > 9900 and (k1 is null or k1 = s_suppkey) and (b1 is null or b1 = s_acctbal)""",
    ),
    # FILTER
    "filter_cmp_num": ("SELECT ?p ?x WHERE { ?p ex:price ?x FILTER(?x >= 950 && ?x < 960.5) }", f"select {PART} p, p_retailprice x from part where p_retailprice >= 950 and p_retailprice < 960.5"),
    "filter_cmp_date": ('SELECT ?o WHERE { ?o ex:date ?d FILTER(?d < "1995-03-01T00:00:00"^^xsd:dateTime) }', f"select {ORDER} o from orders where o_orderdate < timestamp '1995-03-01'"),
    "filter_cmp_string": ("SELECT ?n WHERE { ?x a ex:Nation ; ex:name ?n FILTER(?n > 'M') }", "select n_name n from nation where n_name > 'M'"),
    "filter_cmp_columns": ("SELECT ?d WHERE { ?d ex:quality ?q ; ex:toxic ?t FILTER(?q != ?t) }", f"select {DOC} d from labels where quality <> toxic"),
    "filter_bool_ops": ("SELECT ?c WHERE { ?c ex:segment ?s ; ex:acctbal ?b FILTER(?s = 'BUILDING' && ?b > 0 || ?s = 'MACHINERY' && ?b < 0) }", f"select {CUSTOMER} c from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0 or c_mktsegment = 'MACHINERY' and c_acctbal < 0"),
    "filter_not": ("SELECT ?c WHERE { ?c ex:segment ?s FILTER(!(?s = 'BUILDING')) }", f"select {CUSTOMER} c from customer where not c_mktsegment = 'BUILDING'"),
    "filter_arith": ("SELECT ?l WHERE { ?l ex:extprice ?p ; ex:discount ?d ; ex:qty ?q FILTER(?p * (1 - ?d) / ?q > 2050) }", f"select {iri('lineitem', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} l from lineitem where l_extendedprice * (1 - l_discount) / l_quantity > 2050"),
    "filter_unary_minus": ("SELECT ?c WHERE { ?c a ex:Customer ; ex:acctbal ?b FILTER(-?b > 500) }", f"select {CUSTOMER} c from customer where -c_acctbal > 500"),
    "filter_division_by_zero": ("SELECT ?d WHERE { ?d ex:quality ?q ; ex:toxic ?t FILTER(?q / ?t >= 1) }", f"select {DOC} d from labels where toxic <> 0 and quality / toxic >= 1"),
    "filter_ebv": ("SELECT ?d WHERE { ?d ex:toxic ?t ; ex:lang ?l FILTER(?t && ?l) }", f"select {DOC} d from labels join documents using (doc_id) where toxic <> 0 and lang <> ''"),
    "filter_regex_i": ("SELECT ?n WHERE { ?p ex:name ?n ; ex:brand ?b FILTER(regex(?n, 'AL.*n', 'i')) }", "select p_name n from part where regexp_matches(p_name, 'AL.*n', 'i')"),
    "filter_regex_plain": ("SELECT ?n WHERE { ?x a ex:Nation ; ex:name ?n FILTER regex(?n, '^N.*_[0-4]$') }", "select n_name n from nation where regexp_matches(n_name, '^N.*_[0-4]$')"),
    "filter_contains": ("SELECT ?d WHERE { ?d ex:text ?t ; ex:lang 'en' FILTER contains(?t, 'license') }", f"select {DOC} d from documents where lang = 'en' and contains(text, 'license')"),
    "filter_ucase_lcase": ("SELECT ?s WHERE { ?x ex:ptype ?s ; ex:size 3 FILTER(LCASE(?s) != ?s && UCASE(?s) = UPPERCASE(?s)) }", "select p_type s from part where p_size = 3 and lower(p_type) <> p_type"),
    "filter_bound": ("SELECT ?d ?q WHERE { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } FILTER(bound(?q)) }", f"select {DOC} d, quality q from documents join labels using (doc_id)"),
    "filter_not_bound": ("SELECT ?d WHERE { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } FILTER(!BOUND(?q)) }", f"select {DOC} d from documents left join labels using (doc_id) where quality is null"),
    "filter_iri_equality": (f"SELECT ?o WHERE {{ ?o ex:by ?c FILTER(?c = <{BASE}/customer/7> || ?c = <{BASE}/customer/8>) }}", f"select {ORDER} o from orders where o_custkey in (7, 8)"),
    "filter_str_iri": (f"SELECT ?o WHERE {{ ?o ex:by ?c FILTER(str(?c) = '{BASE}/customer/7') }}", f"select {ORDER} o from orders where o_custkey = 7"),
    "filter_sameterm": ("SELECT ?a ?b WHERE { ?x ex:inRegion ?r ; ex:name ?a . ?y ex:inRegion ?s ; ex:name ?b FILTER(sameTerm(?r, ?s) && ?a < ?b) }", "select a.n_name a, b.n_name b from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_name < b.n_name"),
    "filter_isiri_isliteral": ("SELECT ?n ?r WHERE { ?n ex:inRegion ?r ; ex:name ?m FILTER(isIRI(?r) && isLiteral(?m) && !isBlank(?r) && isURI(?n)) }", f"select {NATION} n, {iri('region', 'n_regionkey')} r from nation"),
    "filter_datatype": ("SELECT ?p WHERE { ?p ex:size ?s ; ex:price ?x FILTER(datatype(?s) = xsd:int && datatype(?x) = xsd:double && ?s > 45) }", f"select {PART} p from part where p_size > 45"),
    "datatype_arith": ("SELECT ?p WHERE { ?p ex:size ?s ; ex:price ?x FILTER(datatype(?s + 1) = xsd:integer && datatype(?x * ?s) = xsd:double && datatype(?s / 2) = xsd:decimal && datatype(-?s) = xsd:integer && ?s > 40) }", f"select {PART} p from part where p_size > 40"),
    "regex_invalid": ("SELECT ?n WHERE { ?x a ex:Nation ; ex:name ?n ; ex:inRegion ?r FILTER(regex(?n, '(') || regex(?n, '_[0-9]$', 'q') || ?n = 'NATION_3' || regex(?n, ?n) && ?r = <" + BASE + "/region/1>) }", "select n_name n from nation where n_name = 'NATION_3' or n_regionkey = 1"),
    "var_predicate_join": ("SELECT ?n ?p ?name WHERE { ?n a ex:Nation ; ?p ?x . ?x a ex:Region ; ex:name ?name }", f"select {NATION} n, '{EX}inRegion' p, r_name as name from nation join region on n_regionkey = r_regionkey"),
    "var_predicate_twice": (f"SELECT ?p ?o ?q ?r WHERE {{ <{BASE}/nation/3> ?p ?o ; ?q ?r }}", f"with x as (select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' p, '{EX}Nation' o from nation where n_nationkey = 3 union all select '{EX}name', n_name from nation where n_nationkey = 3 union all select '{EX}inRegion', {iri('region', 'n_regionkey')} from nation where n_nationkey = 3) select a.p, a.o, b.p q, b.o r from x a, x b"),
    "optional_right_may_lack": (
        "SELECT ?d ?q ?l WHERE { ?d ex:toxic ?q OPTIONAL { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } } }",
        f"select 'http://ex.org/doc/' || t.doc_id d, t.toxic q, r.lang l from (select doc_id, toxic from labels where toxic is not null) t left join (select d.doc_id, d.lang, l.quality q from documents d left join labels l using (doc_id) where d.lang is not null) r on r.doc_id = t.doc_id and (r.q is null or r.q = t.toxic)",
    ),
    "filter_lang_langmatches": ("SELECT ?n WHERE { ?x a ex:Region ; ex:name ?n FILTER(lang(?n) = '' && !langMatches(lang(?n), '*')) }", "select r_name n from region"),
    "cast_values": (
        "SELECT ?e ?v WHERE { ?e ex:k ?v ; ex:props ?p FILTER(xsd:integer(?v) >= 50 && xsd:double(?v) < 60 && xsd:string(?v) != '55' && xsd:boolean('true')) }",
        f"select {EVENT} e, json_extract_string(props, '$.k') v from events where try_cast(json_extract_string(props, '$.k') as bigint) between 50 and 59 and json_extract_string(props, '$.k') <> '55'",
    ),
    "cast_invalid": ("SELECT ?c WHERE { ?c ex:segment ?s ; ex:name ?n FILTER(!bound(?x) && (xsd:integer(?s) > 0 || ?n = 'Customer#000000009')) }", f"select {CUSTOMER} c from customer where c_name = 'Customer#000000009'"),
    "cast_datetime": ("SELECT ?o WHERE { ?o ex:date ?d FILTER(xsd:dateTime('1995-06-17T00:00:00') = ?d) }", f"select {ORDER} o from orders where o_orderdate = timestamp '1995-06-17'"),
    # UNION
    "union_same_vars": ("SELECT ?x ?n WHERE { { ?x a ex:Region ; ex:name ?n } UNION { ?x a ex:Nation ; ex:name ?n } }", f"select {REGION} x, r_name n from region union all select {NATION}, n_name from nation"),
    "union_diff_vars": ("SELECT ?x ?q ?s WHERE { { ?x ex:quality ?q } UNION { ?x ex:source ?s } }", f"select {DOC} x, quality q, null s from labels union all select {DOC}, null, source from documents"),
    "union_three": ("SELECT ?n WHERE { { ?x a ex:Region ; ex:name ?n } UNION { ?x a ex:Nation ; ex:name ?n } UNION { ?x a ex:Supplier ; ex:name ?n } }", "select r_name n from region union all select n_name from nation union all select s_name from supplier"),
    "union_then_join": ("SELECT ?c ?n WHERE { ?c ex:ofNation ?na . ?na ex:name ?n . { ?c a ex:Supplier } UNION { ?c ex:segment 'HOUSEHOLD' } }", f"select {SUPPLIER} c, n_name n from supplier join nation on s_nationkey = n_nationkey union all select {CUSTOMER}, n_name from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'HOUSEHOLD'"),
    "union_multi_source_star": ("SELECT ?p ?n WHERE { ?p a ex:Party ; ex:name ?n ; ex:acctbal ?b FILTER(?b > 9000) }", f"select {CUSTOMER} p, c_name n from customer where c_acctbal > 9000 union all select {SUPPLIER}, s_name from supplier where s_acctbal > 9000"),
    "union_kinds": ("SELECT ?n ?x WHERE { { ?n ex:inRegion ?x } UNION { ?n a ex:Nation ; ex:name ?x } }", f"select {NATION} n, {iri('region', 'n_regionkey')} x from nation union all select {NATION}, n_name from nation"),
    "union_kinds_filter": ("SELECT ?n ?x WHERE { { ?n ex:inRegion ?x } UNION { ?n a ex:Nation ; ex:name ?x } FILTER(isLiteral(?x) && ?x < 'NATION_2') }", f"select {NATION} n, n_name x from nation where n_name < 'NATION_2'"),
    "nested_group": ("SELECT ?c ?o WHERE { ?c ex:segment 'FURNITURE' . { ?o ex:by ?c . { ?o ex:status 'F' ; ex:total ?t FILTER(?t > 250000) } } }", f"select {CUSTOMER} c, {ORDER} o from customer join orders on o_custkey = c_custkey where c_mktsegment = 'FURNITURE' and o_orderstatus = 'F' and o_totalprice > 250000"),
    # modifiers
    "distinct": ("SELECT DISTINCT ?s ?p WHERE { ?o ex:status ?s ; ex:priority ?p }", "select distinct o_orderstatus s, o_orderpriority p from orders"),
    "distinct_iri": ("SELECT DISTINCT ?c WHERE { ?o ex:by ?c ; ex:status 'P' }", f"select distinct {iri('customer', 'o_custkey')} c from orders where o_orderstatus = 'P'"),
    "distinct_limit": ("SELECT DISTINCT ?b WHERE { ?p ex:brand ?b } ORDER BY ?b LIMIT 7", "select distinct p_brand b from part order by b limit 7"),
    "orderby_asc_desc": ("SELECT ?c ?b WHERE { ?c a ex:Customer ; ex:acctbal ?b ; ex:name ?n } ORDER BY DESC(?b) ASC(?n) LIMIT 20", f"select {CUSTOMER} c, c_acctbal b from customer order by c_acctbal desc, c_name limit 20"),
    "orderby_unbound_first": ("SELECT ?d ?q WHERE { ?d ex:nchars ?n OPTIONAL { ?d ex:quality ?q } } ORDER BY ?q DESC(?n) ?d LIMIT 30", f"select {DOC} d, quality q from documents left join labels using (doc_id) order by quality nulls first, n_chars desc, 1 limit 30"),
    "orderby_func": ("SELECT ?n WHERE { ?x a ex:Nation ; ex:name ?n } ORDER BY LCASE(?n) LIMIT 5", "select n_name n from nation order by lower(n_name) limit 5"),
    "orderby_iri": ("SELECT ?n WHERE { ?n ex:inRegion ?r } ORDER BY DESC(?n) LIMIT 4", f"select {NATION} n from nation order by n desc limit 4"),
    "limit_offset": ("SELECT ?n WHERE { ?x a ex:Nation ; ex:name ?n } ORDER BY ?n LIMIT 10 OFFSET 5", "select n_name n from nation order by n_name limit 10 offset 5"),
    "offset_limit": ("SELECT ?n WHERE { ?x a ex:Nation ; ex:name ?n } ORDER BY ?n OFFSET 20 LIMIT 10", "select n_name n from nation order by n_name limit 10 offset 20"),
    "topk": ("SELECT ?o ?t WHERE { ?o ex:total ?t } ORDER BY DESC(?t) ?o LIMIT 25", f"select {ORDER} o, o_totalprice t from orders order by o_totalprice desc, o limit 25"),
    # forms
    "ask_true": ("ASK { ?c ex:segment 'BUILDING' }", "select exists(select 1 from customer where c_mktsegment = 'BUILDING') result"),
    "ask_false": ("ASK { ?c ex:segment 'NOBODY' }", "select exists(select 1 from customer where c_mktsegment = 'NOBODY') result"),
    "construct_template": ("CONSTRUCT { ?c ex:lives ?r . ?r ex:has ?n } WHERE { ?c ex:segment 'BUILDING' ; ex:name ?n ; ex:ofNation ?na . ?na ex:inRegion ?r }", f"with x as (select {CUSTOMER} c, c_name n, {iri('region', 'n_regionkey')} r from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING') select c s, '{EX}lives' p, r o from x union all select r, '{EX}has', n from x"),
    "construct_where": ("CONSTRUCT WHERE { ?n ex:inRegion ?r . ?r ex:name ?m }", f"select {NATION} s, '{EX}inRegion' p, {iri('region', 'n_regionkey')} o from nation union all select {REGION}, '{EX}name', r_name from nation join region on n_regionkey = r_regionkey"),
    "construct_unbound_skipped": ("CONSTRUCT { ?d ex:in ?l . ?d ex:rated ?q } WHERE { ?d ex:lang ?l OPTIONAL { ?d ex:quality ?q } }", f"select {DOC} s, '{EX}in' p, lang o from documents union all select {DOC}, '{EX}rated', cast(quality as varchar) from labels"),
    # variable classes and predicates
    "type_const": ("SELECT ?d WHERE { ?d a ex:Document }", f"select {DOC} d from documents union select {DOC} from labels"),
    "type_var": ("SELECT ?s ?c WHERE { ?s a ?c ; ex:acctbal ?b FILTER(?b > 9500) }", f"select {CUSTOMER} s, unnest(['{EX}Customer', '{EX}Party']) c from customer where c_acctbal > 9500 union all select {SUPPLIER}, unnest(['{EX}Supplier', '{EX}Party']) from supplier where s_acctbal > 9500"),
    "type_distinct": ("SELECT DISTINCT ?c WHERE { ?s a ?c }", f"select unnest([{', '.join(repr(EX + c) for c in 'Region Nation Customer Supplier Party Part Order LineItem Event Document Page Turn Item Vector'.split())}]) c"),
    "var_predicate": (f"SELECT ?p ?o WHERE {{ <{BASE}/nation/3> ?p ?o }}", f"select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' p, '{EX}Nation' o from nation where n_nationkey = 3 union all select '{EX}name', n_name from nation where n_nationkey = 3 union all select '{EX}inRegion', {iri('region', 'n_regionkey')} from nation where n_nationkey = 3"),
    "spo_class": ("SELECT ?s ?p ?o WHERE { ?s a ex:Region . ?s ?p ?o }", f"select {REGION} s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' p, '{EX}Region' o from region union all select {REGION}, '{EX}name', r_name from region"),
    "var_predicate_to_iri": (f"SELECT ?s ?p WHERE {{ ?s ?p <{BASE}/nation/4> }}", f"select {CUSTOMER} s, '{EX}ofNation' p from customer where c_nationkey = 4 union all select {SUPPLIER}, '{EX}ofNation' from supplier where s_nationkey = 4"),
    # nested and repeated values
    "nested_json_path": ("SELECT ?e ?k WHERE { ?e ex:etype 'purchase' ; ex:k ?k }", f"select {EVENT} e, json_extract_string(props, '$.k') k from events where event_type = 'purchase' and json_extract_string(props, '$.k') is not null"),
    "array_multivalue": ("SELECT ?v ?x WHERE { ?v ex:label 3 ; ex:component ?x FILTER(?x > 0.2) }", f"select {iri('vec', 'vec_id')} v, x from (select vec_id, label, unnest(embedding) x from embeddings) where label = 3 and x > 0.2"),
    "all_of_values": ("SELECT DISTINCT ?c WHERE { ?o ex:by ?c ; ex:status 'P' . ?q ex:by ?c ; ex:status 'F' . ?z ex:by ?c ; ex:status 'O' }", f"select {iri('customer', 'o_custkey')} c from orders where o_orderstatus in ('P', 'F', 'O') group by o_custkey having count(distinct o_orderstatus) = 3"),
    "repeated_predicate": ("SELECT ?v ?a ?b WHERE { ?v ex:label 1 ; ex:component ?a ; ex:component ?b FILTER(?a > 0.3 && ?b < -0.3) }", f"with x as (select vec_id, unnest(embedding) x from embeddings where label = 1) select {iri('vec', 'a.vec_id')} v, a.x a, b.x b from x a join x b on a.vec_id = b.vec_id where a.x > 0.3 and b.x < -0.3"),
}


def _sparql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).query(PREFIXES + text).df


# sources: small tables are written in another format and asked through it


def _copy(spark: SparkSession, name: str) -> str:
    return shared_path(spark, f"source-{name}")


def _nation_map(owner: str, table: str = "nation", iterator: str | None = None) -> TriplesMap:
    from .lake import mapping

    tm = mapping(table, "/nation/{n_nationkey}", "Nation", owner=owner, name_="n_name", inRegion="/region/{n_regionkey}")
    tm.source = LogicalSource(owner, table=table, iterator=iterator)
    return tm


_NATION_QUERY = PREFIXES + f"SELECT ?n ?name WHERE {{ ?n a ex:Nation ; ex:name ?name ; ex:inRegion <{BASE}/region/3> }}"
_NATION_SQL = f"select {NATION} n, n_name as name from nation where n_regionkey = 3"


def _through(fmt: str, **params) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
        path = _copy(spark, fmt)
        if fmt == "csv":
            nation.write.option("header", True).csv(path)
        elif fmt == "tsv":
            nation.write.option("header", True).option("sep", "\t").csv(path)
        elif fmt == "json":
            nation.write.json(path)
        elif fmt == "orc":
            nation.write.orc(path)
        else:
            nation.write.option("rowTag", "nation").option("rootTag", "nations").xml(path)
        source = SourceSpec("files", fmt, path, params)
        tm = _nation_map("files", table=path, iterator="/nations/nation" if fmt == "xml" else None)
        return Engine(spark, Catalog([source], [tm])).query(_NATION_QUERY).df

    return run


def source_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = engine(spark, sf_dir).query(PREFIXES + "CONSTRUCT { ?n a ex:Nation . ?n ex:name ?m . ?n ex:inRegion ?r } WHERE { ?n ex:name ?m ; ex:inRegion ?r }").df
    path = _copy(spark, "nt")
    write_ntriples(made.withColumn("o_kind", F.when(F.col("p") == EX + "name", "literal").otherwise("uri")), path)
    return Engine(spark, Catalog([SourceSpec("rdf", "ntriples", path)])).query(_NATION_QUERY).df


def _nations_of_blank_regions(spark: SparkSession, sf_dir: str) -> Engine:
    """Nations as IRIs whose regions are blank nodes, as N-Triples."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))

    def rows(df, s, s_kind, p, o, o_kind):
        return df.select(s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(EX + p).alias("p"), o.alias("o"), F.lit(o_kind).alias("o_kind"))

    n, label = F.concat(F.lit(f"{BASE}/nation/"), F.col("n_nationkey").cast("string")), lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    made = rows(nation, n, "uri", "in", label("n_regionkey"), "bnode").unionByName(rows(region, label("r_regionkey"), "bnode", "name", F.col("r_name"), "literal")).unionByName(rows(nation, n, "uri", "name", F.col("n_name"), "literal"))
    path = _copy(spark, "nt")
    write_ntriples(made, path)
    return Engine(spark, Catalog([SourceSpec("rdf", "ntriples", path)]))


def bnode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join through blank nodes."""
    return _nations_of_blank_regions(spark, sf_dir).query(PREFIXES + "SELECT ?n ?name WHERE { ?n ex:in ?b . ?b ex:name ?name }").df


def filter_isblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank nodes are neither IRIs nor literals, as subjects and as objects."""
    return _nations_of_blank_regions(spark, sf_dir).query(PREFIXES + "SELECT ?n ?name WHERE { ?n ex:in ?b . ?x ex:name ?name FILTER(isBlank(?b) && !isIRI(?b) && isBlank(?x) && !isLiteral(?x) && isIRI(?n) && sameTerm(?b, ?x)) }").df


def source_ntriples_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as literals, with quotes, tabs, line ends of both kinds, and characters beyond the basic plane, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat("text", F.lit('\r\n\t"\\ \U0001F600'), F.repeat(F.lit("x"), F.lit(5000)))
    rows = docs.select(F.concat(F.lit(f"{BASE}/doc/"), F.col("doc_id").cast("string")).alias("s"), F.lit(EX + "text").alias("p"), text.alias("o"), F.lit("literal").alias("o_kind"))
    path = _copy(spark, "nt")
    write_ntriples(rows.where("o is not null"), path)
    out = Engine(spark, Catalog([SourceSpec("rdf", "ntriples", path)])).query(PREFIXES + "SELECT ?d ?t WHERE { ?d ex:text ?t }").df
    return out.select("d", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("h"))


def source_clashing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose columns are named as generated ones may be."""
    from .plans.stars import PREFIX

    names = [f"{p}{i}" for p in ("c", PREFIX, PREFIX.upper()) for i in range(0, 400, 37)]
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    table = nation.select("n_nationkey", *[(F.col("n_nationkey") * 1000 + i).alias(n) for i, n in enumerate(names) if n.lower() not in {x.lower() for x in names[:i]}])
    used = [c for c in table.columns if c != "n_nationkey"]
    tm = TriplesMap("t", LogicalSource("lake", table="t"), TermMap("template", BASE + "/nation/{n_nationkey}", "iri"), (EX + "T",), [PredicateObject(f"{EX}p{i}", ref(c)) for i, c in enumerate(used)], owner="lake")
    e = Engine(spark, Catalog([SourceSpec("lake", "memory", frames={"t": table})], [tm]))
    wanted = (0, 1, len(used) // 2, len(used) - 1)
    out = e.query(PREFIXES + "SELECT * WHERE { " + " ".join(f"?n ex:p{i} ?v{i} ." for i in range(len(used))) + " }").df
    return out.select("n", *[F.col(f"v{i}").alias(f"v{k}") for k, i in enumerate(wanted)])


def source_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions from N-Triples, nations from CSV, suppliers from Parquet, in one query."""
    lake = engine(spark, sf_dir)
    made = lake.query(PREFIXES + "CONSTRUCT { ?r ex:called ?m } WHERE { ?r a ex:Region ; ex:name ?m }").df
    rdf, csv = _copy(spark, "nt"), _copy(spark, "csv")
    write_ntriples(made.withColumn("o_kind", F.lit("literal")), rdf)
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.option("header", True).csv(csv)
    mine = [m for m in maps() if m.name == "supplier"]
    tm = _nation_map("files", table=csv)
    catalog = Catalog([SourceSpec("lake", "parquet", sf_dir), SourceSpec("files", "csv", csv, {"schema": "n_nationkey int, n_name string, n_regionkey int"}), SourceSpec("rdf", "ntriples", rdf, predicates=(EX + "called",))], [*mine, tm])
    return Engine(spark, catalog).query(PREFIXES + "SELECT ?s ?n ?m WHERE { ?s ex:ofNation ?x ; ex:acctbal ?b . ?x ex:name ?n ; ex:inRegion ?r . ?r ex:called ?m FILTER(?b > 0) }").df


def source_xml_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as XML elements with their nations inside, one row for each nation."""
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    path = _copy(spark, "xml")
    inner = nation.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("label"))).alias("nation"))
    nested = region.join(inner, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("_key"), F.struct("nation").alias("nations"))
    nested.write.option("rowTag", "region").option("rootTag", "regions").xml(path)
    tm = TriplesMap("nested", LogicalSource("x", table=path, iterator="/regions/region"), TermMap("template", BASE + "/region/{@key}", "iri"), (EX + "Region",), [PredicateObject(EX + "holds", ref("nations/nation[*]/label"))], owner="x")
    return Engine(spark, Catalog([SourceSpec("x", "xml", path)], [tm])).query(PREFIXES + "SELECT ?r ?n WHERE { ?r ex:holds ?n }").df


def source_parent_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign key whose parent's subject is made of another column: the parent's rows are joined."""
    region = TriplesMap("region", LogicalSource("lake", table="region"), TermMap("template", BASE + "/place/{r_name}", "iri"), (EX + "Region",), [PredicateObject(EX + "key", ref("r_regionkey"))], owner="lake")
    nation = TriplesMap("nation", LogicalSource("lake", table="nation"), TermMap("template", BASE + "/nation/{n_nationkey}", "iri"), (EX + "Nation",), [PredicateObject(EX + "in", ObjectMap(parent="region", joins=(Join("n_regionkey", "r_regionkey"),)))], owner="lake")
    e = Engine(spark, Catalog([SourceSpec("lake", "parquet", sf_dir)], [region, nation]))
    return e.query(PREFIXES + "SELECT ?n ?r ?k WHERE { ?n ex:in ?r . ?r ex:key ?k }").df


def source_constant_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant objects bind variables, and decide constants at planning."""
    tm = TriplesMap("region", LogicalSource("lake", table="region"), TermMap("template", BASE + "/region/{r_regionkey}", "iri"), (EX + "Region",), [PredicateObject(EX + "planet", ObjectMap(TermMap("constant", "http://ex.org/earth", "iri"))), PredicateObject(EX + "kind", ObjectMap(TermMap("constant", "continent", "literal")))], owner="lake")
    e = Engine(spark, Catalog([SourceSpec("lake", "parquet", sf_dir)], [tm]))
    return e.query(PREFIXES + "SELECT ?r ?k ?p WHERE { ?r ex:kind ?k ; ex:planet ?p FILTER(?p = <http://ex.org/earth>) }").df


def group_collect_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with repeated values, as a document store has them, asked through their array."""
    from .sources.graph import grouped

    docs = grouped(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderpriority", "priorities")
    tm = TriplesMap("doc", LogicalSource("mongo", table="doc"), TermMap("template", BASE + "/customer/{o_custkey}", "iri"), (EX + "Customer",), [PredicateObject(EX + "priority", ref("priorities[*]"))], owner="mongo")
    e = Engine(spark, Catalog([SourceSpec("mongo", "document", frames={"doc": docs})], [tm]))
    return e.query(PREFIXES + "SELECT ?c WHERE { ?c ex:priority '1-URGENT' ; ex:priority '5-LOW' }").df


def property_graph_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations as nodes of a property graph, and one relation between them."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    key = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    nodes = customer.select(key("c", "c_custkey").alias("id"), F.lit("Customer").alias("label"), F.col("c_name").alias("name")).unionByName(nation.select(key("n", "n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name")))
    edges = customer.select(key("c", "c_custkey").alias("src"), F.lit("LIVES_IN").alias("type"), key("n", "c_nationkey").alias("dst"))
    hops = hop(nodes, edges, "Customer", "LIVES_IN", "Nation")
    tm = TriplesMap("lives", LogicalSource("neo", table="lives"), TermMap("template", BASE + "/node/{n.id}", "iri"), (EX + "Customer",), [PredicateObject(EX + "name", ref("n.name")), PredicateObject(EX + "livesIn", iri_map(BASE + "/node/{o.id}")), PredicateObject(EX + "nation", ref("o.name"))], owner="neo")
    e = Engine(spark, Catalog([SourceSpec("neo", "document", frames={"lives": hops})], [tm]))
    return e.query(PREFIXES + "SELECT ?c ?n WHERE { ?c ex:livesIn ?x ; ex:nation ?n ; ex:name 'Customer#000000011' }").df


def document_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of JSON documents, grouped by what the source says; the mapping reads the array."""
    path = _copy(spark, "json")
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderpriority").write.json(path)
    tm = TriplesMap("doc", LogicalSource("mongo", table=path), TermMap("template", BASE + "/customer/{o_custkey}", "iri"), (EX + "Customer",), [PredicateObject(EX + "priority", ref("o_orderpriority[*]"))], owner="mongo")
    source = SourceSpec("mongo", "mongodb", path, {"schema": "o_custkey long, o_orderpriority string", "groupBy": "o_custkey", "collect": "o_orderpriority"})
    return Engine(spark, Catalog([source], [tm])).query(PREFIXES + "SELECT ?c ?p WHERE { ?c ex:priority '1-URGENT' ; ex:priority ?p }").df


def property_graph_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges as tables of a property graph; the mappings' iterators say which hop and which nodes are rows."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    key = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    path = _copy(spark, "graph")
    customer.select(key("c", "c_custkey").alias("id"), F.lit("Customer").alias("label"), F.col("c_name").alias("name")).unionByName(nation.select(key("n", "n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name"))).write.parquet(f"{path}/nodes.parquet")
    customer.select(key("c", "c_custkey").alias("src"), F.lit("LIVES_IN").alias("type"), key("n", "c_nationkey").alias("dst")).write.parquet(f"{path}/edges.parquet")
    lives = TriplesMap("lives", LogicalSource("neo", iterator="Customer/LIVES_IN/Nation"), TermMap("template", BASE + "/node/{n.id}", "iri"), (EX + "Customer",), [PredicateObject(EX + "livesIn", iri_map(BASE + "/node/{o.id}"))], owner="neo")
    places = TriplesMap("places", LogicalSource("neo", iterator="Nation"), TermMap("template", BASE + "/node/{id}", "iri"), (EX + "Nation",), [PredicateObject(EX + "name", ref("name"))], owner="neo")
    e = Engine(spark, Catalog([SourceSpec("neo", "neo4j", path)], [lives, places]))
    return e.query(PREFIXES + "SELECT ?c ?n WHERE { ?c ex:livesIn ?x . ?x a ex:Nation ; ex:name ?n FILTER(?n < 'NATION_2') }").df


def catalog_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).catalog.classes(spark).groupBy("class").agg(F.countDistinct("predicate").alias("predicates"))


def catalog_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links found in the data between the classes of the star schema's small tables."""
    some = [m for m in maps() if m.name in ("region", "nation", "supplier", "customer", "orders")]
    return Catalog([SourceSpec("lake", "parquet", sf_dir)], some).links(spark)


def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = [m for m in maps() if m.name in ("region", "nation", "labels")]
    return Catalog([SourceSpec("lake", "parquet", sf_dir)], some).statistics(spark)


def triples_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, predicates and ranges found in a triple table."""
    from .plans.catalog import molecules_of

    return molecules_of(_triples(spark, sf_dir))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = engine(spark, sf_dir).query(PREFIXES + "CONSTRUCT { ?n a ex:Nation . ?n ex:name ?m . ?n ex:inRegion ?r . ?r a ex:Region } WHERE { ?n ex:name ?m ; ex:inRegion ?r }").df
    return made.withColumn("s_kind", F.lit("uri")).withColumn("o_kind", F.when(F.col("p") == EX + "name", "literal").otherwise("uri")).withColumn("o_datatype", F.lit(None).cast("string")).withColumn("o_lang", F.lit(None).cast("string"))


def stream_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the same user's purchases up to an hour apart: a stream-stream join of the events as files, run until all are read."""
    from .streaming import stream_join

    kept = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    into, out, state = (_copy(spark, x) for x in ("events", "pairs", "state"))
    kept.write.parquet(into)

    def of(kind: str, name: str, at: str) -> DataFrame:
        events = spark.readStream.schema(kept.schema).parquet(into)
        return events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(at))

    pairs = stream_join(of("click", "click", "at"), of("purchase", "purchase", "then"), ["user_id"], "at", "then").select("user_id", "click", "purchase")
    run = pairs.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.schema(pairs.schema).parquet(out)


def catalog_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, predicates and ranges of a catalog that was written as a metadata graph and read from it again."""
    from .plans.catalog import catalog_of_graph, graph_of_catalog

    some = [m for m in maps() if m.name in ("region", "nation", "supplier")]
    known = graph_of_catalog(spark, Catalog([SourceSpec("lake", "parquet", sf_dir)], some))
    again = catalog_of_graph(known)
    rows = [(m.root, p, r) for m in again.molecules.values() for p, ranges in m.predicates.items() for r in (ranges or {None})]
    return spark.createDataFrame(rows, "class string, predicate string, range string")


def _exists(table: str, condition: str) -> str:
    return f"exists(select 1 from {table} where {condition})"


# (class, predicate, a table and a condition that some row has it): what the data itself says of the classes
_TOLD = [
    (classes, predicate, table, f"{column} is not null")
    for classes, table, columns in (
        ("Region", "region", {"name": "r_name"}), ("Nation", "nation", {"name": "n_name", "inRegion": "n_regionkey"}),
        ("Customer Party", "customer", {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment", "ofNation": "c_nationkey"}), ("Supplier Party", "supplier", {"name": "s_name", "acctbal": "s_acctbal", "ofNation": "s_nationkey"}),
        ("Part", "part", {"name": "p_name", "brand": "p_brand", "ptype": "p_type", "size": "p_size", "price": "p_retailprice"}), ("Order", "orders", {"status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "priority": "o_orderpriority", "by": "o_custkey"}),
        ("LineItem", "lineitem", {"ofOrder": "l_orderkey", "ofPart": "l_partkey", "ofSupplier": "l_suppkey", "qty": "l_quantity", "extprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "flag": "l_returnflag", "linestatus": "l_linestatus", "shipped": "l_shipdate"}),
        ("Event", "events", {"etype": "event_type", "value": "value", "ts": "ts", "user": "user_id", "props": "props", "k": "json_extract_string(props, '$.k')"}),
        ("Document", "documents", {"text": "text", "lang": "lang", "source": "source", "nchars": "n_chars"}), ("Document", "labels", {"quality": "quality", "toxic": "toxic"}),
        ("Page", "pages", {"url": "url", "html": "html"}), ("Turn", "conversations", {"role": "role", "text": "text"}), ("Item", "benchmark", {"text": "text"}), ("Vector", "embeddings", {"label": "label", "component": "embedding[1]"}),
    )
    for predicate, column in columns.items()
]
_CLASSES_SQL = "select class, count(distinct predicate) predicates from (" + " union all ".join(f"select '{EX}{c}' class, '{p}' predicate where {_exists(t, w)}" for cs, p, t, w in _TOLD for c in cs.split()) + ") group by class"
_LINKS_SQL = " union all ".join(
    f"""select '{EX}{a}' class, '{EX}{p}' predicate, '{EX}{b}' "to" where {_exists(t, w)}"""
    for a, p, b, t, w in (
        ("Nation", "inRegion", "Region", "nation join region on n_regionkey = r_regionkey", "true"), ("Supplier", "ofNation", "Nation", "supplier join nation on s_nationkey = n_nationkey", "true"),
        ("Party", "ofNation", "Nation", "supplier join nation on s_nationkey = n_nationkey", "true"), ("Customer", "ofNation", "Nation", "customer join nation on c_nationkey = n_nationkey", "true"),
        ("Order", "by", "Customer", "orders join customer on o_custkey = c_custkey", "true"), ("Order", "by", "Party", "orders join customer on o_custkey = c_custkey", "true"),
    )
)
_MOLECULES_SQL = (
    f"select distinct '{EX}Nation' class, '{EX}name' predicate, null range from nation join region on n_regionkey = r_regionkey where n_name is not null"
    f" union all select distinct '{EX}Nation', '{EX}inRegion', '{EX}Region' from nation join region on n_regionkey = r_regionkey"
)
_RANGES = {"inRegion": "Region", "ofNation": "Nation"}
_GRAPH_SQL = " union all ".join(
    f"select '{EX}{c}' class, '{EX}{p}' predicate, {r} range where {_exists(t, w)}"
    for cs, p, t, w in _TOLD if t in ("region", "nation", "supplier") for c in cs.split() for r in [f"'{EX}{_RANGES[p]}'" if p in _RANGES else "null"]
)

OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "source_csv": (_through("csv"), _NATION_SQL),
    "source_tsv": (_through("tsv"), _NATION_SQL),
    "source_json": (_through("json"), _NATION_SQL),
    "source_orc": (_through("orc"), _NATION_SQL),
    "source_xml": (_through("xml"), _NATION_SQL),
    "source_xml_nested": (source_xml_nested, f"select {iri('region', 'n_regionkey')} r, n_name n from nation"),
    "source_ntriples": (source_ntriples, _NATION_SQL),
    "source_ntriples_long": (source_ntriples_long, f"with t as (select doc_id, text || chr(13) || chr(10) || chr(9) || '\"\\ ' || chr(128512) || repeat('x', 5000) t from documents where text is not null) select {DOC} d, length(t) n, md5(t) h from t"),
    "source_clashing_columns": (source_clashing_columns, f"select {NATION} n, n_nationkey * 1000 v0, n_nationkey * 1000 + 1 v1, n_nationkey * 1000 + 11 v2, n_nationkey * 1000 + 21 v3 from nation"),
    "bnode_join": (bnode_join, f"select {NATION} n, r_name as name from nation join region on n_regionkey = r_regionkey"),
    "filter_isblank": (filter_isblank, f"select {NATION} n, r_name as name from nation join region on n_regionkey = r_regionkey"),
    "source_federated": (source_federated, f"select {SUPPLIER} s, n_name n, r_name m from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_acctbal > 0"),
    "source_parent_map": (source_parent_map, f"select {NATION} n, 'http://ex.org/place/' || replace(r_name, ' ', '_') r, r_regionkey k from nation join region on n_regionkey = r_regionkey"),
    "source_constant_object": (source_constant_object, f"select {REGION} r, 'continent' k, 'http://ex.org/earth' p from region"),
    "group_collect_set": (group_collect_set, f"select {iri('customer', 'o_custkey')} c from orders where o_orderpriority in ('1-URGENT', '5-LOW') group by o_custkey having count(distinct o_orderpriority) = 2"),
    "property_graph_hop": (property_graph_hop, "select 'http://ex.org/node/c' || c_custkey c, n_name n from customer join nation on c_nationkey = n_nationkey where c_name = 'Customer#000000011'"),
    "document_grouped": (document_grouped, f"select distinct {iri('customer', 'o_custkey')} c, b.o_orderpriority p from orders a join orders b using (o_custkey) where a.o_orderpriority = '1-URGENT'"),
    "property_graph_source": (property_graph_source, "select 'http://ex.org/node/c' || c_custkey c, n_name n from customer join nation on c_nationkey = n_nationkey where n_name < 'NATION_2'"),
    "catalog_classes": (catalog_classes, _CLASSES_SQL),
    "catalog_links": (catalog_links, _LINKS_SQL),
    "catalog_graph": (catalog_graph, _GRAPH_SQL),
    "catalog_statistics": (catalog_statistics, f"select '{EX}Region' class, '{EX}name' predicate, count(*) triples from region union all select '{EX}Nation', '{EX}name', count(*) from nation union all select '{EX}Nation', '{EX}inRegion', count(*) from nation union all select '{EX}Document', '{EX}quality', count(quality) from labels union all select '{EX}Document', '{EX}toxic', count(toxic) from labels"),
    "triples_molecules": (triples_molecules, _MOLECULES_SQL),
    "stream_join_events": (stream_join_events, "select c.user_id, c.event_id click, p.event_id purchase from events c join events p using (user_id) where c.event_type = 'click' and p.event_type = 'purchase' and p.ts between c.ts - interval 1 hour and c.ts + interval 1 hour"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**{k: _sparql(q) for k, (q, _) in SPARQL.items()}, **{k: f for k, (f, _) in OTHERS.items()}}
SQL: dict[str, str] = {**{k: s for k, (_, s) in SPARQL.items()}, **{k: s for k, (_, s) in OTHERS.items()}}
