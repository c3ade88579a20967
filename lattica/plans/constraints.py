"""Constraints on values: how they combine, and the column expressions that check them.

A constraint is a small immutable value on the driver. meet(a, b) is the constraint of what both admit; validate(df, c) adds an array
column of violations {path, code, message}, evaluated by Spark with the scan of the data. A typed column's null means that the
field is absent."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encodings import yaml_unmarshal
from ..functions.regexps import compiled, to_end

VIOLATION = "array<struct<path: string, code: string, message: string>>"
#: Kinds that hold others, from wide to narrow.
WIDER = {"int": "number", "float": "number", "uint": "int"}
RANGES = {f"{u}int{n}": ((0, 2**n - 1) if u else (-(2 ** (n - 1)), 2 ** (n - 1) - 1)) for u in ("", "u") for n in (8, 16, 32, 64)}
TYPES: dict[str, tuple] = {
    "bool": (T.BooleanType,), "string": (T.StringType,), "bytes": (T.BinaryType,), "float": (T.DoubleType, T.FloatType, T.DecimalType),
    "int": (T.LongType, T.IntegerType, T.ShortType, T.ByteType), "time": (T.TimestampType, T.TimestampNTZType, T.DateType),
}
TYPES["number"] = TYPES["int"] + TYPES["float"]


class Constraint:
    def __and__(self, other: Constraint) -> Constraint:
        return meet(self, other)

    def __or__(self, other: Constraint) -> OneOf:
        return OneOf((*(self.branches if isinstance(self, OneOf) else (self,)), *(other.branches if isinstance(other, OneOf) else (other,))))


@dataclass(frozen=True)
class Anything(Constraint):
    pass


@dataclass(frozen=True)
class Nothing(Constraint):
    message: str = "conflict"


@dataclass(frozen=True)
class Fail(Nothing):
    """As a branch: what is said where no other branch fits."""


def error(message: str) -> Fail:
    return Fail(message)


@dataclass(frozen=True)
class OrNull(Constraint):
    """A value that fits, or null: as a required field it may be null, as an element too."""

    inner: Constraint


@dataclass(frozen=True)
class MatchN(Constraint):
    """The number of the parts that a value fits is within the bound."""

    number: Bound
    parts: tuple[Constraint, ...]


@dataclass(frozen=True)
class MatchIf(Constraint):
    """A value that fits `condition` fits `then`, any other `otherwise`."""

    condition: Constraint
    then: Constraint
    otherwise: Constraint


@dataclass(frozen=True)
class Kind(Constraint):
    """bool, string, bytes, time, number, int, float, uint, or int and uint with a width."""

    name: str


@dataclass(frozen=True)
class Bound(Constraint):
    """operator is one of < <= > >= !=."""

    operator: str
    value: Any


@dataclass(frozen=True)
class Pattern(Constraint):
    """The regular expression occurs, or doesn't."""

    text: str
    negated: bool = False


@dataclass(frozen=True)
class Value(Constraint):
    value: Any


@dataclass(frozen=True)
class Passes(Constraint):
    """A named test of a column, such as a validator of the functions' modules."""

    name: str
    test: Callable[[Column], Column] = field(compare=False)


@dataclass(frozen=True)
class All(Constraint):
    parts: tuple[Constraint, ...]


@dataclass(frozen=True)
class OneOf(Constraint):
    """At least one branch holds. default is the number of the branch that an absent value takes."""

    branches: tuple[Constraint, ...]
    default: int | None = None


@dataclass(frozen=True)
class Items(Constraint):
    """An array: prefix by place, then element for the others; no others if element is None."""

    element: Constraint | None = Anything()
    prefix: tuple[Constraint, ...] = ()
    least: int = 0
    most: int | None = None
    unique: bool = False


@dataclass(frozen=True)
class Field:
    constraint: Constraint
    optional: bool = False


@dataclass(frozen=True)
class Record(Constraint):
    """A struct, a row or a map. patterns hold for all fields whose name matches, rest for those that are neither among fields nor match;
    a closed record has no such."""

    fields: tuple[tuple[str, Field], ...] = ()
    closed: bool = False
    patterns: tuple[tuple[str, Constraint], ...] = ()
    least: int = 0
    most: int | None = None
    rest: Constraint = Anything()


def record(fields: dict[str, Constraint | Field], closed: bool = True, patterns: dict[str, Constraint] | None = None) -> Record:
    """A record, closed unless said otherwise. A name that ends in ? is an optional field."""
    made = {n.removesuffix("?"): c if isinstance(c, Field) else Field(c, n.endswith("?")) for n, c in fields.items()}
    return Record(tuple(made.items()), closed, tuple((patterns or {}).items()))


def every(*parts: Constraint) -> Constraint:
    return reduce(meet, parts, Anything())


def enum(*values: Any, default: int | None = None) -> OneOf:
    return OneOf(tuple(map(Value, values)), default)


def between(low: Any, high: Any) -> Constraint:
    return meet(Bound(">=", low), Bound("<=", high))


# -- meeting ------------------------------------------------------------------------------------------------------------------------


def meet(a: Constraint, b: Constraint) -> Constraint:
    """The constraint of the values that both admit; Nothing where they surely admit none."""
    for x, y in ((a, b), (b, a)):
        if isinstance(x, Nothing):
            return x
        if isinstance(x, Anything):
            return y
    if a == b:
        return a
    if isinstance(a, OrNull) or isinstance(b, OrNull):
        inner = meet(*(x.inner if isinstance(x, OrNull) else x for x in (a, b)))
        return OrNull(inner) if isinstance(a, OrNull) and isinstance(b, OrNull) else inner
    for x, y in ((a, b), (b, a)):
        if isinstance(x, OneOf) and not isinstance(y, OneOf):
            return _of_branches([meet(branch, y) for branch in x.branches], [x.default])
    if isinstance(a, OneOf) and isinstance(b, OneOf):
        pairs = [(i, j) for i in range(len(a.branches)) for j in range(len(b.branches))]
        marked = [k for k, (i, j) in enumerate(pairs) if a.default in (None, i) and b.default in (None, j)] if (a.default, b.default) != (None, None) else []
        return _of_branches([meet(a.branches[i], b.branches[j]) for i, j in pairs], marked)
    if isinstance(a, Record) and isinstance(b, Record):
        return _records(a, b)
    if isinstance(a, Items) and isinstance(b, Items):
        return _items(a, b)
    parts = [*(a.parts if isinstance(a, All) else (a,)), *(b.parts if isinstance(b, All) else (b,))]
    return _simple(parts)


def _of_branches(branches: list[Constraint], marked: list[int | None]) -> Constraint:
    """The branches that can hold, each once; the marked one that is left, if it is the only such, is the default."""
    kept: list[Constraint] = []
    place = {}
    for i, c in enumerate(branches):
        if not isinstance(c, Nothing):
            if c not in kept:
                kept.append(c)
            place[i] = kept.index(c)
    fails = [c for c in branches if isinstance(c, Fail)]
    if not kept:
        return fails[0] if fails else Nothing("no branch is left")
    kept += fails[:1]
    defaults = {place[m] for m in marked if m in place}
    return kept[0] if len(kept) == 1 else OneOf(tuple(kept), defaults.pop() if len(defaults) == 1 else None)


def _records(a: Record, b: Record) -> Constraint:
    fields: dict[str, Field] = dict(a.fields)
    for name, f in b.fields:
        if name not in fields:
            fields[name] = f
        else:
            both = meet(fields[name].constraint, f.constraint)
            fields[name] = Field(both, fields[name].optional and f.optional)
    for side in (a, b):  # a side's rest holds for the fields that only the other one names
        for name, f in fields.items():
            if name not in dict(side.fields) and not any(_occurs(p, name) for p, _ in side.patterns):
                fields[name] = Field(meet(f.constraint, side.rest), f.optional)
    for side in (a, b):
        own = dict(side.fields)
        for name, f in fields.items():
            if side.closed and name not in own and not any(_occurs(p, name) for p, _ in side.patterns) and not f.optional:
                return Nothing(f"field {name} is not allowed")
    for name, f in fields.items():
        if isinstance(f.constraint, Nothing) and not f.optional:
            return Nothing(f"{name}: {f.constraint.message}")
    closed = a.closed or b.closed
    most = min((m for m in (a.most, b.most) if m is not None), default=None)
    if closed:  # an optional field that a closed side does not know can't be set
        fields = {n: Field(Nothing("field is not allowed"), True) if any(s.closed and n not in dict(s.fields) and not any(_occurs(p, n) for p, _ in s.patterns) for s in (a, b)) else f for n, f in fields.items()}
    return Record(tuple(fields.items()), closed, (*a.patterns, *(p for p in b.patterns if p not in a.patterns)), max(a.least, b.least), most, meet(a.rest, b.rest))


def _occurs(pattern: str, name: str) -> bool:
    """As match() on a column: $ is the end of the text."""
    import re

    return re.search(to_end(pattern).replace("\\z", "\\Z"), name) is not None


def _items(a: Items, b: Items) -> Constraint:
    n = max(len(a.prefix), len(b.prefix))
    sides = [[*x.prefix, *([x.element] * (n - len(x.prefix)))] for x in (a, b)]
    if any(c is None for side in sides for c in side):
        return Nothing("lists of different lengths")
    prefix = tuple(meet(x, y) for x, y in zip(*sides, strict=True))
    element = None if a.element is None or b.element is None else meet(a.element, b.element)
    most = min((m for m in (a.most, b.most) if m is not None), default=None)
    least = max(a.least, b.least)
    if most is not None and least > most:
        return Nothing(f"no list has {least} or more and {most} or fewer elements")
    return Items(element, prefix, least, most, a.unique or b.unique)


def _kinds(a: str, b: str) -> str | None:
    def up(x: str) -> list[str]:
        out = [x]
        while out[-1] in WIDER or out[-1] in RANGES:
            out.append(WIDER.get(out[-1], "uint" if out[-1][0] == "u" else "int"))
        return out

    return a if b in up(a) else b if a in up(b) else None


def _simple(parts: list[Constraint]) -> Constraint:
    """Kinds, values, bounds, patterns and tests together: the narrowest kind, the tightest bounds, and no empty range."""
    wholes = [p for p in parts if isinstance(p, Record | Items)]
    if wholes and (any(isinstance(p, Kind | Value | Bound | Pattern) for p in parts) or len({type(p) for p in wholes}) > 1):
        return Nothing("a record or list meets another kind of value")
    kind, low, high, rest, values = None, None, None, [], []
    limits: list[tuple[Any, Any]] = []
    for p in parts:
        if isinstance(p, Kind):
            if kind is not None and p.name in RANGES and kind in RANGES:
                limits.append(RANGES[p.name])
                continue
            met = p.name if kind is None else _kinds(kind, p.name)
            if met is None:
                return Nothing(f"{kind} and {p.name} conflict")
            kind = met
        elif isinstance(p, Value):
            values.append(p.value)
        elif isinstance(p, Bound) and p.operator in (">", ">="):
            if low is None or (p.value, p.operator == ">") > (low.value, low.operator == ">"):
                low = p
        elif isinstance(p, Bound) and p.operator in ("<", "<="):
            if high is None or (p.value, p.operator == "<=") < (high.value, high.operator == "<="):
                high = p
        elif p not in rest:
            rest.append(p)
    if kind in RANGES or limits:
        ends = [*limits, *([RANGES[kind]] if kind in RANGES else [])]
        limits = [(max(a for a, _ in ends), min(b for _, b in ends))]
    if len(set(map(repr, values))) > 1:
        return Nothing("values differ")
    if values and not all(_admits(p, values[0]) for p in [*([Kind(kind)] if kind else []), *filter(None, (low, high)), *rest]):
        return Nothing(f"{values[0]!r} is not admitted")
    if values:  # what the literal is known to pass says nothing more
        left = [p for p in rest if isinstance(p, Passes)]
        return All((Value(values[0]), *left)) if left else Value(values[0])
    if low and high:
        a, b = low.value, high.value
        if kind is not None and _kinds(kind, "int") == kind and isinstance(a, int | float) and isinstance(b, int | float):
            a, b = (math.floor(a) + 1 if low.operator == ">" else math.ceil(a)), (math.ceil(b) - 1 if high.operator == "<" else math.floor(b))
            empty = a > b
        else:
            empty = a > b or (a == b and (low.operator, high.operator) != (">=", "<="))
        if empty:
            return Nothing("the range is empty")
    if limits:
        rest = [p for p in rest if p not in (Bound(">=", limits[0][0]), Bound("<=", limits[0][1]))]
        if len({p.name for p in parts if isinstance(p, Kind) and p.name in RANGES}) > 1:
            low = low if low and low.value >= limits[0][0] else Bound(">=", limits[0][0])
            high = high if high and high.value <= limits[0][1] else Bound("<=", limits[0][1])
    out = [*([Kind(kind)] if kind else []), *filter(None, (low, high)), *rest]
    return out[0] if len(out) == 1 else All(tuple(out))


def _admits(c: Constraint, value: Any) -> bool:
    """Whether a constraint surely refuses a literal; tests of columns are left to the data."""
    if isinstance(c, Kind):
        if c.name in RANGES:
            return type(value) is int and RANGES[c.name][0] <= value <= RANGES[c.name][1]
        return {"bool": lambda: type(value) is bool, "string": lambda: isinstance(value, str), "bytes": lambda: isinstance(value, bytes | bytearray), "int": lambda: type(value) is int, "uint": lambda: type(value) is int and value >= 0, "float": lambda: isinstance(value, float), "number": lambda: type(value) in (int, float)}.get(c.name, lambda: True)()
    if isinstance(c, Bound):
        try:
            return {"<": value < c.value, "<=": value <= c.value, ">": value > c.value, ">=": value >= c.value, "!=": value != c.value}[c.operator]
        except TypeError:
            return False
    if isinstance(c, Pattern):
        return isinstance(value, str) and _occurs(c.text, value) != c.negated
    return True


# -- checking -----------------------------------------------------------------------------------------------------------------------


@dataclass
class Found:
    """What may be wrong: tests, each with what it means if true (a null is an undecided test), and arrays of violations of elements."""

    tests: list[tuple[Column, Column, str, str]] = field(default_factory=list)
    arrays: list[Column] = field(default_factory=list)

    def add(self, bad: Column, path: Column, message: str, code: str = "eval") -> Found:
        self.tests.append((bad, path, code, message))
        return self

    def extend(self, other: Found, where: Column | None = None) -> Found:
        """Also what the other has, only where that is true."""
        self.tests += [(bad if where is None else where & bad, path, code, message) for bad, path, code, message in other.tests]
        self.arrays += [a if where is None else F.when(where, a).otherwise(_none()) for a in other.arrays]
        return self

    def any(self) -> Column:
        tests = [F.coalesce(bad, F.lit(True)) for bad, *_ in self.tests] + [F.size(a) > 0 for a in self.arrays]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def violations(self) -> Column:
        """The array of violations; rows without any evaluate the tests and nothing else."""
        one = lambda path, code, message: F.struct(path.alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message"))
        told = [F.when(bad, one(path, code, message)).when(bad.isNull(), one(path, "incomplete", message)) for bad, path, code, message in self.tests]
        parts = [*([F.array_compact(F.array(*told)).cast(VIOLATION)] if told else []), *self.arrays]
        if not parts:
            return _none()
        return F.when(self.any(), F.concat(*parts) if len(parts) > 1 else parts[0]).otherwise(_none())

    def counts(self, df: DataFrame) -> DataFrame:
        """path, code, message and n over all rows: one aggregate of conditional counts; only violations of elements are exploded."""
        sums = [F.count_if(t).alias(f"{kind}{i}") for i, (bad, *_) in enumerate(self.tests) for kind, t in (("bad", F.coalesce(bad, F.lit(False))), ("open", bad.isNull()))]
        lines = lambda n, path, code, message: F.struct(path.alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message"), F.col(n).alias("n"))
        told = [x for i, (_, path, code, message) in enumerate(self.tests) for x in (lines(f"bad{i}", path, code, message), lines(f"open{i}", path, "incomplete", message))]
        parts = [df.agg(*sums).select(F.inline(F.array(*told)))] if told else []
        parts += [df.select(F.inline(a)).groupBy("path", "code", "message").agg(F.count("*").alias("n")) for a in self.arrays]
        if not parts:
            return df.sparkSession.createDataFrame([], "path string, code string, message string, n long")
        return reduce(lambda a, b: a.unionByName(b), parts).groupBy("path", "code", "message").agg(F.sum("n").alias("n")).where("n > 0")


def _none() -> Column:
    return F.array().cast(VIOLATION)


def check(c: Constraint, column: Column, kind: T.DataType, path: Column) -> Found:
    """What of the constraint a column of that type, where it is not null, may violate."""
    out = Found()
    if isinstance(c, Anything):
        return out
    if isinstance(c, Nothing):
        return out.add(F.lit(True), path, c.message)
    if isinstance(c, OrNull):
        return check(c.inner, column, kind, path)
    if isinstance(c, MatchN):
        n = reduce(lambda a, b: a + b, [(~check(p, column, kind, path).any()).cast("int") for p in c.parts], F.lit(0))
        return out.extend(check(c.number, n, T.IntegerType(), path))
    if isinstance(c, MatchIf):
        fits = ~check(c.condition, column, kind, path).any()
        return out.extend(check(c.then, column, kind, path), fits).extend(check(c.otherwise, column, kind, path), ~fits)
    if isinstance(c, Kind):
        base = c.name if c.name in TYPES else "int"
        if not isinstance(kind, TYPES[base]):
            return out.add(F.lit(True), path, f"{kind.simpleString()} is no {c.name}")
        if c.name == "uint":
            return out.add(column < 0, path, "not a uint")
        if c.name in RANGES:
            low, high = RANGES[c.name]
            wide = column if low >= -(2**63) and high < 2**63 else column.cast("decimal(20,0)")
            return out.add(~wide.between(low, high), path, f"not a {c.name}")
        return out
    if isinstance(c, Value):
        return out.add(column != F.lit(c.value), path, f"not {c.value!r}")
    if isinstance(c, Bound):
        v = F.lit(c.value)
        good = {"<": column < v, "<=": column <= v, ">": column > v, ">=": column >= v, "!=": column != v}[c.operator]
        return out.add(~good, path, f"not {c.operator} {c.value!r}")
    if isinstance(c, Pattern):
        found = column.rlike(compiled(c.text))
        return out.add(found if c.negated else ~found, path, f"{'matches' if c.negated else 'does not match'} {c.text}")
    if isinstance(c, Passes):
        return out.add(~c.test(column), path, f"fails {c.name}")
    if isinstance(c, All):
        for p in c.parts:
            out.extend(check(p, column, kind, path))
        return out
    if isinstance(c, OneOf):
        live, said = _branches(c)
        values = [b.value for b in live if isinstance(b, Value)]
        if len(values) == len(live):
            return out.add(~column.isin(values), path, said or f"not one of {values}")
        bad = reduce(lambda a, b: a & b, [check(b, column, kind, path).any() for b in live])
        return out.add(bad, path, said or f"fits none of {len(live)} branches")
    if isinstance(c, Items):
        return _check_items(c, column, kind, path)
    if isinstance(c, Record):
        return _check_map(c, column, kind, path) if isinstance(kind, T.MapType) else _check_struct(c, column, kind, path)
    raise TypeError(f"no constraint: {c!r}")


def _branches(c: OneOf) -> tuple[list[Constraint], str | None]:
    """The branches that may fit, and what is said if none does."""
    return [b for b in c.branches if not isinstance(b, Fail)], next((b.message for b in c.branches if isinstance(b, Fail)), None)


def branch_of(c: OneOf, column: Column, kind: T.DataType) -> Column:
    """The number of the first branch that fits, null if none does."""
    return F.coalesce(*(F.when(~check(b, column, kind, F.lit("")).any(), F.lit(i)) for i, b in enumerate(c.branches)))


def _check_items(c: Items, column: Column, kind: T.DataType, path: Column) -> Found:
    out = Found()
    if not isinstance(kind, T.ArrayType):
        return out.add(F.lit(True), path, f"{kind.simpleString()} is no list")
    n = len(c.prefix)
    least = max(c.least, n)
    if least:
        out.add(F.size(column) < least, path, f"fewer than {least} elements")
    most = n if c.element is None else c.most
    if most is not None:
        out.add(F.size(column) > most, path, f"more than {most} elements")
    if c.unique:
        out.add(F.size(F.array_distinct(column)) < F.size(column), path, "elements are not unique")
    at = lambda i: F.concat(path, F.lit("."), F.lit(i).cast("string") if isinstance(i, int) else i.cast("string"))
    for i, p in enumerate(c.prefix):
        out.extend(_field(Field(p), F.get(column, F.lit(i)), kind.elementType, at(i), True), F.size(column) > i)
    if c.element is not None and not isinstance(c.element, Anything):
        each = lambda x, i: _field(Field(c.element), x, kind.elementType, at(i), True)
        bad = F.flatten(F.transform(column, lambda x, i: F.when(i < n, _none()).otherwise(each(x, i).violations())))
        out.arrays.append(bad)
    return out


def _field(f: Field, column: Column, kind: T.DataType, path: Column, concrete: bool) -> Found:
    out = Found()
    if concrete and not f.optional and not isinstance(f.constraint, OrNull):
        out.add(column.isNull(), path, "missing", "incomplete")
    return out.extend(check(f.constraint, column, kind, path), column.isNotNull())


def _check_struct(c: Record, column: Column, kind: T.DataType, path: Column) -> Found:
    if not isinstance(kind, T.StructType):
        return Found().add(F.lit(True), path, f"{kind.simpleString()} is no record")
    return _fields(c, {f.name: (column[f.name], f.dataType) for f in kind.fields}, lambda n: F.concat(path, F.lit("." + n)), path, True)


def _count(c: Record, n: Column, path: Column, out: Found) -> Found:
    if c.least or c.most is not None:
        out.add((n < c.least) | (n > (c.most if c.most is not None else 1 << 30)), path, "number of fields")
    return out


def _fields(c: Record, columns: dict[str, tuple[Column, T.DataType]], at: Callable[[str], Column], path: Column, concrete: bool) -> Found:
    out, known = Found(), dict(c.fields)
    for name, f in known.items():
        if name in columns:
            out.extend(_field(f, *columns[name], at(name), concrete))
        elif not f.optional and concrete:
            out.add(F.lit(True), at(name), "missing", "incomplete")
    for name, (column, kind) in columns.items():
        fits = [p for pattern, p in c.patterns if _occurs(pattern, name)]
        for p in fits:
            out.extend(check(p, column, kind, at(name)), column.isNotNull())
        if name not in known and not fits:
            if c.closed:
                out.add(column.isNotNull(), at(name), "field is not allowed")
            else:
                out.extend(check(c.rest, column, kind, at(name)), column.isNotNull())
    return _count(c, reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x, _ in columns.values()], F.lit(0)), path, out)


def _check_map(c: Record, column: Column, kind: T.MapType, path: Column) -> Found:
    out, known = Found(), dict(c.fields)
    at = lambda n: F.concat(path, F.lit("."), n)
    for name, f in known.items():
        out.extend(_field(f, F.try_element_at(column, F.lit(name)), kind.valueType, at(F.lit(name)), True))
    entries = F.map_entries(column)
    of = lambda pattern, p: lambda e: F.when(e["key"].rlike(compiled(pattern)), _field(Field(p), e["value"], kind.valueType, at(e["key"]), True).violations()).otherwise(_none())
    out.arrays += [F.flatten(F.transform(entries, of(pattern, p))) for pattern, p in c.patterns]
    fits = lambda k: reduce(lambda a, b: a | b, [k.rlike(compiled(p)) for p, _ in c.patterns], k.isin([*known]) if known else F.lit(False))
    if not c.closed and not isinstance(c.rest, Anything):
        others = lambda e: F.when(fits(e["key"]), _none()).otherwise(_field(Field(c.rest), e["value"], kind.valueType, at(e["key"]), True).violations())
        out.arrays.append(F.flatten(F.transform(entries, others)))
    if c.closed:
        bad = F.filter(F.map_keys(column), lambda k: ~fits(k))
        out.arrays.append(F.transform(bad, lambda k: F.struct(at(k).alias("path"), F.lit("eval").alias("code"), F.lit("field is not allowed").alias("message"))).cast(VIOLATION))
    return _count(c, F.size(column), path, out)


def validate(df: DataFrame, schema: Constraint, concrete: bool = True, violations: str = "violations") -> DataFrame:
    """df with an array of what each row violates; empty for a valid row. With concrete, missing fields that are not optional count too.

    Works on batches and streams alike, without a shuffle. schema is a record, or a union of records (the row must fit a branch)."""
    return df.withColumn(violations, _found(df, schema, concrete).violations())


def counted(df: DataFrame, schema: Constraint, concrete: bool = True) -> DataFrame:
    """path, code, message and n: how often rows of df violate what, without an array for each row. What does not occur is left out."""
    return _found(df, schema, concrete).counts(df)


def _found(df: DataFrame, schema: Constraint, concrete: bool) -> Found:
    columns = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    of = lambda s: _fields(s, columns, F.lit, F.lit(""), concrete)
    if isinstance(schema, Nothing):
        return Found().add(F.lit(True), F.lit(""), schema.message)
    if isinstance(schema, OneOf):
        live, said = _branches(schema)
        bad = reduce(lambda a, b: a & b, [of(b).any() for b in live])
        return Found().add(bad, F.lit(""), said or f"fits none of {len(live)} branches")
    if isinstance(schema, Record):
        return of(schema)
    raise TypeError("a row is a record")


def valid_json(text: Column, schema: Constraint, kind: T.DataType) -> Column:
    """Whether a text is JSON of that type that fits the schema; null for null. Numbers for texts, say, are no such JSON; members that
    the type lacks are seen at the top level only, where a closed schema refuses them."""
    if isinstance(kind, T.StructType):
        kind = T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])
    value = F.from_json(text, kind, {"columnNameOfCorruptRecord": "_corrupt"})
    own = T.StructType([f for f in kind.fields if f.name != "_corrupt"]) if isinstance(kind, T.StructType) else kind
    bad = check(schema, value, own, F.lit("")).any()
    good = F.try_parse_json(text).isNotNull() & value.isNotNull() & ~bad
    if isinstance(kind, T.StructType):
        good = good & value["_corrupt"].isNull()
        if isinstance(schema, Record) and schema.closed:
            names = F.filter(F.json_object_keys(text), lambda k: reduce(lambda a, b: a | b, [k.rlike(compiled(p)) for p, _ in schema.patterns], k.isin([n for n, _ in schema.fields])))
            good = good & (F.size(names) == F.size(F.json_object_keys(text)))
    return F.when(text.isNotNull(), F.coalesce(good, F.lit(False)))


def valid_yaml(text: Column, schema: Constraint, kind: T.DataType) -> Column:
    """As valid_json(), of YAML; text that is none is not valid."""
    told = F.array(F.to_json(yaml_unmarshal(text)))  # an element of an array, so that it is made once and not at each place that reads it
    return F.when(text.isNotNull(), F.coalesce(F.get(F.transform(told, lambda t: valid_json(t, schema, kind)), F.lit(0)), F.lit(False)))


def opened(schema: Record) -> Record:
    return replace(schema, closed=False)


def closed(schema: Record) -> Record:
    return replace(schema, closed=True)


def default_of(c: Constraint) -> Any:
    """The literal that an absent value takes: a union's marked branch, or a constraint's only value. None if there is no such."""
    if isinstance(c, OneOf):
        return default_of(c.branches[c.default]) if c.default is not None else None
    if isinstance(c, All):
        return next((v for p in c.parts if (v := default_of(p)) is not None), None)
    if isinstance(c, OrNull):
        return default_of(c.inner)
    return c.value if isinstance(c, Value) else None


def with_schema_defaults(df: DataFrame, schema: Record) -> DataFrame:
    """df with the schema's defaults in absent fields; columns it lacks are added if the schema has a default for them."""
    found = {n: d for n, f in schema.fields if (d := default_of(f.constraint)) is not None}
    return df.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(d)) if n in df.columns else F.lit(d) for n, d in found.items()})
