"""Solutions are a DataFrame and the terms that its columns stand for."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import terms as T
from ..plans.stars import fresh


@dataclass
class Solutions:
    df: DataFrame
    terms: dict[str, T.Term]

    @property
    def vars(self) -> list[str]:
        return list(self.terms)


def nothing(spark: SparkSession, names) -> Solutions:
    """No solution, for these variables; Catalyst drops what is joined with it."""
    terms = {v: T.Term("literal", (fresh(),), ("string",)) for v in names}
    schema = ", ".join(f"`{t.cols[0]}` string" for t in terms.values()) or f"`{fresh()}` int"
    return Solutions(spark.createDataFrame([], schema), terms)


def unit(spark: SparkSession) -> Solutions:
    """One solution that binds nothing."""
    return Solutions(spark.range(1).select(F.lit(1).alias(fresh())), {})


def _all(conditions: list[Column]) -> Column | None:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def compatible(left: Solutions, right: Solutions) -> tuple[Column | None, bool]:
    """The condition that two solutions agree on shared variables, all certain, and whether it can hold at all."""
    conditions = []
    for v in left.terms:
        if v in right.terms:
            same = T.equal(left.terms[v], right.terms[v])
            if same is None:
                return None, False
            conditions.append(same)
    return _all(conditions), True


def _merged(df: DataFrame, left: Solutions, right: Solutions, outer: bool, also: tuple[str, ...] = ()) -> Solutions:
    """The terms after a join: the left's where it is bound, else the right's. Columns ``also`` stay."""
    terms, made = {}, []
    for v, a in left.terms.items():
        b = right.terms.get(v)
        if b is None or a.certain:
            terms[v] = a
            continue
        form = T.unified([replace(a, certain=True), replace(b, certain=True)])
        names = tuple(fresh() for _ in form.types)
        for x, y, n in zip(T.fitted(a, form), T.fitted(b, form), names):
            made.append(F.when(T.bound(a), x).otherwise(y).alias(n))
        terms[v] = replace(form, cols=names, certain=b.certain and not outer)
    for v, b in right.terms.items():
        if v not in left.terms:
            terms[v] = replace(b, certain=b.certain and not outer)
    there = set(df.columns)
    keep = list(dict.fromkeys([*(c for t in terms.values() for c in t.cols if c in there), *also]))
    return Solutions(df.select(*map(T.column, keep), *made) if keep or made else df.select(F.lit(1).alias(fresh())), terms)


def _uncertain(left: Solutions, right: Solutions) -> list[str]:
    """The shared variables that a side may lack."""
    return [v for v in left.terms if v in right.terms and not (left.terms[v].certain and right.terms[v].certain)]


def _mask(s: Solutions, names: list[str]) -> Column:
    """Bit i says that the solution binds the i-th variable."""
    out = F.lit((1 << len(names)) - 1)
    for i, v in enumerate(names):
        if not s.terms[v].certain:
            out = out - F.when(T.bound(s.terms[v]), 0).otherwise(1 << i)
    return out


def _masks(s: Solutions, names: list[str]) -> list[int]:
    """The masks that solutions may have."""
    free = [1 << i for i, v in enumerate(names) if not s.terms[v].certain]
    every = (1 << len(names)) - 1
    return [every - sum(free[i] for i in range(len(free)) if m >> i & 1) for m in range(1 << len(free))]


def _masked(left: Solutions, right: Solutions, names: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides, and the condition that they agree where both bind a variable: equalities only.

    A solution is repeated for each mask that the other side may have, so that the
    masks of both are known on either side of the join; a variable that one of
    them lacks has no key there. The number of reads does not grow with the variables.
    """
    sides = []
    for s, other in ((left, right), (right, left)):
        masks = _masks(other, names)
        many = F.explode(F.array(*map(F.lit, masks))) if len(masks) > 1 else F.lit(masks[0])
        own, far = fresh(), fresh()
        sides.append((s.df.select("*", _mask(s, names).alias(own)).select("*", many.alias(far)), own, far))
    (a, a_own, a_far), (b, b_own, b_far) = sides
    on = (T.column(a_own) == T.column(b_far)) & (T.column(a_far) == T.column(b_own))
    for v in left.terms:
        if v not in right.terms:
            continue
        pairs = T.equal_keys(left.terms[v], right.terms[v])
        if v not in names:
            if pairs is None:
                return a.where(F.lit(False)), b, on
            for x, y in pairs:
                on = on & (x == y)
            continue
        bit = F.lit(1 << names.index(v))
        both = T.column(a_own).bitwiseAND(T.column(a_far)).bitwiseAND(bit) != 0
        if pairs is None:
            a = a.where(~both)
            continue
        also = T.column(b_own).bitwiseAND(T.column(b_far)).bitwiseAND(bit) != 0
        for x, y in pairs:
            on = on & F.when(both, x).eqNullSafe(F.when(also, y))
    return a, b, on


def join(left: Solutions, right: Solutions) -> Solutions:
    """Natural join on shared variables; without any, all pairs.

    Where a side may lack a shared variable an unbound one agrees with anything; see ``_masked``.
    """
    names = _uncertain(left, right)
    if names:
        a, b, on = _masked(left, right, names)
        return _merged(a.join(b, on), left, right, False)
    condition, possible = compatible(left, right)
    if not possible:
        return nothing(left.df.sparkSession, dict.fromkeys([*left.terms, *right.terms]))
    df = left.df.crossJoin(right.df) if condition is None else left.df.join(right.df, condition)
    return _merged(df, left, right, False)


def left_join(left: Solutions, right: Solutions, condition_of, used=()) -> Solutions:
    """OPTIONAL: ``condition_of(terms)`` makes further conditions on the pair, or None; they use the variables ``used``.

    Where a side may lack a shared variable, the pairs that agree are one join, and the
    solutions of the left without a pair are found by what decides that: their shared
    variables and those that the conditions use.
    """
    names = _uncertain(left, right)
    if not names:
        condition, possible = compatible(left, right)
        if not possible:
            return left
        more = condition_of({**right.terms, **left.terms})
        condition = _all([c for c in (condition, more) if c is not None])
        if condition is None:
            condition = F.lit(True)
        return _merged(left.df.join(right.df, condition, "left"), left, right, True)
    a, b, on = _masked(left, right, names)
    decisive = list(dict.fromkeys(c for v, t in left.terms.items() if v in right.terms or v in used for c in t.cols))
    kept = {c: fresh() for c in decisive}
    pairs = a.select("*", *[T.column(c).alias(n) for c, n in kept.items()]).join(b, on)
    both = _merged(pairs, left, right, False, tuple(kept.values()))
    more = condition_of(both.terms)  # sees the left's value, or the right's where the left has none
    if more is not None:
        both = Solutions(both.df.where(more), both.terms)
    having = both.df.select(*map(T.column, kept.values())).distinct()
    same = _all([T.column(c).eqNullSafe(T.column(n)) for c, n in kept.items()])
    alone = Solutions(left.df.join(having, same, "left_anti"), left.terms)
    return union([both, alone])


def union(parts: list[Solutions]) -> Solutions:
    """All solutions of all branches; a variable that a branch lacks is unbound there."""
    if len(parts) == 1:
        return parts[0]
    names = list(dict.fromkeys(v for p in parts for v in p.terms))
    forms = {v: T.unified([p.terms.get(v) for p in parts]) for v in names}
    named = {v: replace(f, cols=tuple(fresh() for _ in f.types)) for v, f in forms.items()}
    empty = fresh()
    df = None
    for p in parts:
        cols = [c.alias(n) for v in names for c, n in zip(T.fitted(p.terms.get(v), forms[v]), named[v].cols)]
        one = p.df.select(*cols) if cols else p.df.select(F.lit(1).alias(empty))
        df = one if df is None else df.unionByName(one)
    return Solutions(df, named)


def shown(s: Solutions, names: list[str]) -> DataFrame:
    """One column for each variable as results show it; unbound ones are null text."""
    return s.df.select(*[(T.value(s.terms[v]) if v in s.terms else F.lit(None).cast("string")).alias(v) for v in names])


def distinct(s: Solutions, names: list[str]) -> Solutions:
    """Different solutions of these variables, compared by keys where keys are as good as terms."""
    have = [v for v in names if v in s.terms]
    terms, cols = {}, []
    for v in have:
        t = s.terms[v]
        if t.injective or t.kind == "mixed":
            cols += T.columns(t)
            terms[v] = t
        else:
            name = fresh()
            cols.append(T.value(t).alias(name))
            terms[v] = T.Term(t.kind, (name,), (t.types[0] if t.kind == "literal" else "string",), ("", "") if t.kind != "literal" else (), t.datatype, t.lang, t.certain)
    if not cols:
        return Solutions(s.df.select(F.lit(1).alias(fresh())).limit(1), {})
    return Solutions(s.df.select(*cols).distinct(), terms)


def construct(s: Solutions, template, term_of) -> DataFrame:
    """(s, p, o): the template's triples for each solution, those with unbound parts left out. ``term_of`` makes text, or structs of terms."""
    rows = []
    for t in template:
        parts = [term_of(x, s.terms) for x in (t.s, t.p, t.o)]
        rows.append(F.struct(*[p.alias(n) for p, n in zip(parts, ("s", "p", "o"))]))
    out = s.df.select(F.explode(F.array(*rows)).alias("t")).select("t.s", "t.p", "t.o")
    return out.where("s is not null and p is not null and o is not null")
