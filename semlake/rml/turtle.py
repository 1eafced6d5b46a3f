"""A small Turtle reader: enough for mappings and N-Triples."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..sparql.ast import RDF_TYPE, XSD
from ..sparql.lexer import unquote


class TurtleError(ValueError):
    pass


#: (kind, value, datatype, lang); kind is uri, bnode or literal.
Term = tuple[str, str, str | None, str | None]

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
      |(?P<iri><[^<>"\s]*>)
      |(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      |(?P<bnode>_:[\w\-.]*[\w\-])
      |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      |(?P<name>(?:[A-Za-z_][\w\-]*)?:(?:[\w\-:%/.]*[\w\-:%/])?|[A-Za-z]+)
      |(?P<op>\^\^|[.;,()\[\]])""",
    re.X | re.S,
)


class _Reader:
    def __init__(self, text: str, base: str):
        self.found: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup != "skip":
                self.found.append((m.lastgroup, m.group()))
            at = m.end()
        self.found.append(("end", ""))
        self.i, self.base, self.prefixes, self.count = 0, base, {}, 0
        self.triples: list[tuple[Term, str, Term]] = []

    def take(self, kind: str | None = None, text: str | None = None) -> str:
        k, t = self.found[self.i]
        if kind and k != kind or text and t != text:
            raise TurtleError(f"expected {text or kind}, found {t or 'the end'!r}")
        self.i += 1
        return t

    def is_(self, text: str) -> bool:
        return self.found[self.i] == ("op", text)

    def run(self):
        while self.found[self.i][0] != "end":
            kind, text = self.found[self.i]
            word = text.lower().lstrip("@")
            if kind in ("at", "name") and word in ("prefix", "base"):
                self.i += 1
                if word == "prefix":
                    name = self.take("name")
                    self.prefixes[name[:-1]] = self.iri()
                else:
                    self.base = self.iri()
                if self.is_("."):
                    self.i += 1
                continue
            s = self.blank() if self.is_("[") else self.term()
            if not self.is_("."):
                self.predicates(s)
            self.take("op", ".")
        return self.triples

    def iri(self) -> str:
        text = self.take("iri")[1:-1]
        return text if re.match(r"[A-Za-z][\w+.\-]*:", text) else self.base + text

    def blank(self) -> Term:
        self.take("op", "[")
        self.count += 1
        s = ("bnode", f"b{self.count}", None, None)
        if not self.is_("]"):
            self.predicates(s)
        self.take("op", "]")
        return s

    def predicates(self, s: Term) -> None:
        while True:
            if self.found[self.i] == ("name", "a"):
                self.i += 1
                p = RDF_TYPE
            else:
                p = self.term()[1]
            while True:
                self.triples.append((s, p, self.blank() if self.is_("[") else self.collection() if self.is_("(") else self.term()))
                if not self.is_(","):
                    break
                self.i += 1
            while self.is_(";"):
                self.i += 1
                if not self.is_(";"):
                    break
            if self.found[self.i][0] == "end" or self.is_(".") or self.is_("]"):
                return

    def collection(self) -> Term:
        self.take("op", "(")
        rdf, items = RDF_TYPE.removesuffix("type"), []
        while not self.is_(")"):
            items.append(self.blank() if self.is_("[") else self.term())
        self.take("op", ")")
        rest: Term = ("uri", rdf + "nil", None, None)
        for item in reversed(items):
            self.count += 1
            node: Term = ("bnode", f"b{self.count}", None, None)
            self.triples += [(node, rdf + "first", item), (node, rdf + "rest", rest)]
            rest = node
        return rest

    def term(self) -> Term:
        kind, text = self.found[self.i]
        if kind == "iri":
            return ("uri", self.iri(), None, None)
        self.i += 1
        if kind == "bnode":
            return ("bnode", text[2:], None, None)
        if kind == "number":
            return ("literal", text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None)
        if kind == "string":
            value, (k, t) = unquote(text), self.found[self.i]
            if k == "at":
                self.i += 1
                return ("literal", value, None, t[1:].lower())
            if (k, t) == ("op", "^^"):
                self.i += 1
                return ("literal", value, self.term()[1], None)
            return ("literal", value, None, None)
        if kind == "name":
            if text in ("true", "false"):
                return ("literal", text, XSD + "boolean", None)
            prefix, colon, local = text.partition(":")
            if colon and prefix in self.prefixes:
                return ("uri", self.prefixes[prefix] + local, None, None)
        raise TurtleError(f"expected a term, found {text or 'the end'!r}")


def read_turtle(text: str, base: str = "") -> list[tuple[Term, str, Term]]:
    """The triples of a Turtle document, in order."""
    return _Reader(text, base).run()


def by_subject(triples) -> dict[str, dict[str, list[Term]]]:
    out: dict[str, dict[str, list[Term]]] = {}
    for s, p, o in triples:
        out.setdefault(s[1], {}).setdefault(p, []).append(o)
    return out


def lines(text: str) -> Iterator[tuple[Term, str, Term]]:
    """Triples of N-Triples text, one line at a time."""
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            yield from read_turtle(line)
