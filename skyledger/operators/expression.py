"""A small typed expression language over header cells, as Column expressions.

Cells are numbers or texts row by row, so every node carries both ways and says which holds. Types and
results are those of Python: whole numbers stay whole, `/` makes a float, texts may be added and
repeated. Nothing raises on data: a row gets the reason of the first node that fails, left to right.

A node's result is one struct, bound to a name before the node above refers to it: as the one element
of an array that a lambda goes over, which no rule of the optimizer writes out in place of the name, not
even where a filter on the result is pushed below it. So a plan grows by the same for each node.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import text

#: The functions that may be called.
FUNCTIONS = ("round", "abs", "min", "max", "int", "float", "str", "len")
MISSING, ZERO, TYPE, VALUE = "missing operand: ", "division by zero", "type error", "value error"
_WHOLE = r"^\s*[+-]?\d+\s*$"


class Refused(ValueError):
    """An expression or rule with something in it that isn't allowed."""


#: The types that a value may have.
SORTS = frozenset(("int", "float", "bool", "str"))


@dataclass(frozen=True)
class Value:
    """`num` or `text` by `kind` (int, float, bool, str); `error` says why there is none.

    `sorts` are the types that it can have at all; of a node inside a tree what can't be is None: the
    text of what is always a number, the error of what can't fail, the kind where there is one only.
    """

    num: Column | None
    text: Column | None
    kind: Column | None
    error: Column | None
    sorts: frozenset[str] = SORTS

    def is_text(self) -> Column:
        return F.lit("str" in self.sorts) if len(self.sorts) == 1 or "str" not in self.sorts else self.kind == "str"

    def is_float(self) -> Column:
        return F.lit("float" in self.sorts) if len(self.sorts) == 1 or "float" not in self.sorts else self.kind == "float"


#: How each field of a value is kept in a struct.
FIELDS = {"num": "double", "text": "string", "kind": "string", "error": "string"}


def packed(v: Value) -> Column:
    """A value as one struct of the fields that it has."""
    return F.struct(*(getattr(v, name).cast(kind).alias(name) for name, kind in FIELDS.items() if getattr(v, name) is not None))


def unpacked(c: Column, like: Value) -> Value:
    return Value(*(None if getattr(like, name) is None else c[name] for name in FIELDS), like.sorts)


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a column, which is worked out once and stands once in the plan however often body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


@dataclass(frozen=True)
class Tree:
    """The struct of a whole tree's value, and a value with the fields and types that it has."""

    struct: Column
    like: Value


def _bound(operands: list[Value | Tree], body: Callable[[list[Value]], Value]) -> Tree:
    """What `body` makes of operands; those that are trees are bound first."""
    made: list[Value] = []

    def bind(rest: list[Value | Tree], known: list[Value]) -> Column:
        if not rest:
            made.append(body(known))
            return packed(made[-1])
        if isinstance(rest[0], Value):
            return bind(rest[1:], [*known, rest[0]])
        return let(rest[0].struct, lambda c: bind(rest[1:], [*known, unpacked(c, rest[0].like)]))

    struct = bind(operands, [])
    return Tree(struct, made[-1])


def none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _filled(v: Value) -> Value:
    """A value with all its fields; where there is an error the others are null."""
    kind = F.lit(next(iter(v.sorts))) if v.kind is None else v.kind
    fine = lambda c: c if v.error is None else F.when(v.error.isNull(), c)
    return Value(none("double") if v.num is None else fine(v.num), none() if v.text is None else fine(v.text), fine(kind), none() if v.error is None else v.error)


def _either(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a | b, conditions) if conditions else None


def _failed(*errors: Column | None) -> Column | None:
    """The first of errors that there may be."""
    known = [e for e in errors if e is not None]
    return known[0] if len(known) == 1 else F.coalesce(*known) if known else None


def _not_text(*values: Value) -> Column | None:
    """The error of operands that must be numbers."""
    texts = _either([v.is_text() for v in values if "str" in v.sorts])
    return None if texts is None else F.when(texts, TYPE)


def _arithmetic(*values: Value) -> tuple[Column | None, frozenset[str]]:
    """(kind, sorts) of what whole numbers leave whole and a float makes a float."""
    if all(not v.sorts & {"float"} for v in values):
        return None, frozenset(("int",))
    if any(v.sorts - {"str"} == {"float"} for v in values):
        return None, frozenset(("float",))
    return F.when(_either([v.is_float() for v in values]), "float").otherwise("int"), frozenset(("int", "float"))


def cell(name: str, raw: Column, num: Column) -> Value:
    """A header's cell: its number where it has one, else its text, else a missing operand."""
    kind = F.when(num.isNotNull(), "float").when(raw.isNotNull(), "str")
    return Value(num, F.when(num.isNull(), raw), kind, F.when(kind.isNull(), MISSING + name), frozenset(("float", "str")))


def constant(value) -> Value:
    sorts = frozenset((type(value).__name__,))
    return Value(None, F.lit(value), None, None, sorts) if isinstance(value, str) else Value(F.lit(float(value)), None, None, None, sorts)


def float_text(c: Column) -> Column:
    """A double as Python writes it: the fewest digits, powers of ten from 1e16 and below 1e-4."""
    plain = F.regexp_replace(c.cast("string").try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    java = c.cast("string")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    power_text = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    scientific = F.concat(F.regexp_replace(F.regexp_replace(java, r"E.*$", ""), r"\.0$", ""), power_text)
    size = F.abs(c)
    # Only those powers take the first form that a double of 38 digits can hold.
    return F.when((c == 0) | ((size >= 1e-4) & (size < 1e16)), plain).when(power.isNotNull(), scientific).otherwise(java)


def whole_text(c: Column) -> Column:
    return c.cast("decimal(38,0)").cast("string")


def shown(v: Value) -> Column:
    """What `str` makes of a value."""
    return F.when(v.is_text(), v.text).when(v.kind == "bool", F.when(v.num == 1, "True").otherwise("False")).when(v.kind == "int", whole_text(v.num)).otherwise(float_text(v.num))


def _zero(divisor: Value, given: ast.expr) -> Column | None:
    """The error of a divisor, unless it is written out and isn't zero."""
    return None if isinstance(given, ast.Constant) and given.value else F.when(divisor.num == 0, ZERO)


def _sum(a: Value, b: Value) -> Value:
    kind, sorts = _arithmetic(a, b)
    num = None if a.num is None or b.num is None else a.num + b.num
    if "str" not in a.sorts or "str" not in b.sorts:
        return Value(num if num is not None else none("double"), None, kind, _failed(a.error, b.error, _not_text(a, b)), sorts)
    mixed = F.when(a.is_text() != b.is_text(), TYPE)
    both = F.when(a.is_text(), "str").otherwise(F.lit(next(iter(sorts))) if kind is None else kind)
    return Value(num, F.concat(a.text, b.text), None if num is None else both, _failed(a.error, b.error, mixed), frozenset(("str",)) if num is None else sorts | {"str"})


def _product(a: Value, b: Value) -> Value:
    kind, sorts = _arithmetic(a, b)
    num = None if a.num is None or b.num is None else a.num * b.num
    if "str" not in a.sorts | b.sorts:
        return Value(num, None, kind, _failed(a.error, b.error), sorts)
    whole = lambda n: F.lit(True) if n.sorts <= {"int", "bool"} else F.lit(False) if n.kind is None else n.kind.isin("int", "bool")
    times = lambda t, n: None if "str" not in t.sorts or not n.sorts & {"int", "bool"} else F.when(t.is_text() & whole(n), F.repeat(t.text, n.num.cast("int")))
    known = [x for x in (times(a, b), times(b, a)) if x is not None]
    texts = _either([v.is_text() for v in (a, b) if "str" in v.sorts])
    if not known:
        return Value(none("double") if num is None else num, None, kind, _failed(a.error, b.error, F.when(texts, TYPE)), sorts)
    repeated = F.coalesce(*known)
    both = F.when(texts, "str").otherwise(F.lit(next(iter(sorts))) if kind is None else kind)
    return Value(none("double") if num is None else num, repeated, both, _failed(a.error, b.error, F.when(texts & repeated.isNull(), TYPE)), sorts | {"str"})


def _binary(node: ast.BinOp, a: Value, b: Value) -> Value:
    op = node.op
    if isinstance(op, ast.Add):
        return _sum(a, b)
    if isinstance(op, ast.Mult):
        return _product(a, b)
    a_num, b_num = (none("double") if v.num is None else v.num for v in (a, b))
    kind, sorts = _arithmetic(a, b)
    before = a.error, b.error, _not_text(a, b)
    if isinstance(op, ast.Sub):
        return Value(a_num - b_num, None, kind, _failed(*before), sorts)
    error = _failed(*before, None if b.num is None else _zero(b, node.right))
    ratio = F.try_divide(a_num, b_num)
    if isinstance(op, ast.Div):
        return Value(ratio, None, None, error, frozenset(("float",)))
    if isinstance(op, ast.FloorDiv):
        return Value(F.floor(ratio).cast("double"), None, kind, error, sorts)
    # The remainder has the divisor's sign.
    return Value(a_num - b_num * F.floor(ratio), None, kind, error, sorts)


def _better(least: bool, a: Value, b: Value) -> Value:
    """The lesser or greater of two values of one sort; of equal ones the first."""
    sorts = a.sorts | b.sorts
    nums = all(v.num is not None for v in (a, b))
    texts = all(v.text is not None for v in (a, b))
    by_num = (b.num < a.num if least else b.num > a.num) if nums else None
    by_text = (b.text < a.text if least else b.text > a.text) if texts else None
    ahead = F.when(a.is_text(), by_text).otherwise(by_num) if nums and texts else by_num if nums else by_text if texts else F.lit(False)
    mixed = F.when(a.is_text() != b.is_text(), TYPE) if "str" in sorts and sorts != {"str"} else None

    def take(x: Column | None, y: Column | None, kind: str) -> Column | None:
        return None if x is None and y is None else F.when(ahead, none(kind) if y is None else y).otherwise(none(kind) if x is None else x)

    name = lambda v: F.lit(next(iter(v.sorts))) if v.kind is None else v.kind
    return Value(take(a.num, b.num, "double"), take(a.text, b.text, "string"), None if len(sorts) == 1 else take(name(a), name(b), "string"), _failed(a.error, b.error, mixed), sorts)


def _call(name: str, args: list[Value], raw: list[ast.expr]) -> Value:
    one = args[0] if args else None
    places = raw[1].value if len(raw) == 2 and isinstance(raw[1], ast.Constant) and isinstance(raw[1].value, int) else None
    if one is None or len(args) > 1 and not (name == "round" and places is not None):
        raise Refused(f"not allowed: {name} of {len(args)}")
    num, string = none("double") if one.num is None else one.num, none() if one.text is None else one.text
    number = _failed(one.error, _not_text(one))
    whole, real = frozenset(("int",)), frozenset(("float",))
    kind, sorts = _arithmetic(one)
    if name == "round":
        return Value(F.bround(num, places or 0), None, *((None, number, whole) if places is None else (kind, number, sorts)))
    if name == "abs":
        return Value(F.abs(num), None, kind, number, sorts)
    if name == "int":
        cut = F.when(num < 0, F.ceil(num)).otherwise(F.floor(num)).cast("double")
        if "str" not in one.sorts:
            return Value(cut, None, None, one.error, whole)
        read = F.when(string.rlike(_WHOLE), F.trim(string).try_cast("double"))
        return Value(F.when(one.is_text(), read).otherwise(cut), None, None, _failed(one.error, F.when(one.is_text() & read.isNull(), VALUE)), whole)
    if name == "float":
        if "str" not in one.sorts:
            return Value(num, None, None, one.error, real)
        read = text.to_float(string)
        return Value(F.when(one.is_text(), read).otherwise(num), None, None, _failed(one.error, F.when(one.is_text() & read.isNull(), VALUE)), real)
    if name == "str":
        return Value(None, shown(_filled(one)), None, one.error, frozenset(("str",)))
    if name == "len":
        return Value(F.length(string).cast("double"), None, None, _failed(one.error, None if one.sorts == {"str"} else F.when(~one.is_text(), TYPE)), whole)
    raise Refused(f"not allowed: {name} of {len(args)}")


def parsed(source: str) -> tuple[ast.expr, set[str]]:
    """The tree of an expression and the names in it; raises `Refused` for anything not allowed."""
    if not source.strip():
        raise Refused("an empty expression")
    try:
        tree = ast.parse(source, mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise Refused(str(e)) from e
    names: set[str] = set()

    def visit(node: ast.expr) -> None:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str)):
            return
        if isinstance(node, ast.Name):
            names.add(node.id)
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            visit(node.operand)
        elif isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod)):
            visit(node.left)
            visit(node.right)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords and not any(isinstance(x, ast.Starred) for x in node.args):
            for x in node.args:
                visit(x)
        else:
            raise Refused(f"not allowed: {ast.unparse(node)}")

    visit(tree)
    return tree, names


def _tree(source: str, env: dict[str, Value]) -> Value | Tree:
    tree, _ = parsed(source)

    def walk(node: ast.expr) -> Value | Tree:
        if isinstance(node, ast.Constant):
            return constant(node.value)
        if isinstance(node, ast.Name):
            return env.get(node.id) or Value(none("double"), None, None, F.lit(MISSING + node.id), frozenset(("float",)))
        if isinstance(node, ast.UnaryOp):
            def signed(v: Value) -> Value:
                num = none("double") if v.num is None else v.num
                kind, sorts = _arithmetic(v)
                return Value(-num if isinstance(node.op, ast.USub) else num, None, kind, _failed(v.error, _not_text(v)), sorts)

            return _bound([walk(node.operand)], lambda v: signed(*v))
        if isinstance(node, ast.BinOp):
            return _bound([walk(node.left), walk(node.right)], lambda v: _binary(node, *v))
        args = [walk(x) for x in node.args]
        if node.func.id in ("min", "max") and len(args) > 1:
            best = args[0]
            for other in args[1:]:
                best = _bound([best, other], lambda v: _better(node.func.id == "min", *v))
            return best
        return _bound(args, lambda v: _call(node.func.id, v, node.args))

    return walk(tree)


def bound(source: str, env: dict[str, Value], then: Callable[[Value], Column]) -> Column:
    """What `then` makes of an expression's value where `env` holds its names; others are missing operands."""
    found = _tree(source, env)
    if isinstance(found, Value):
        return then(_filled(found))
    return let(let(found.struct, lambda c: packed(_filled(unpacked(c, found.like)))), lambda c: then(unpacked(c, _WHOLE_VALUE)))


def compiled(source: str, env: dict[str, Value]) -> Value:
    """The value of an expression as fields of one struct; `bound` for those who name more than one of them."""
    found = _tree(source, env)
    if isinstance(found, Value):
        return _filled(found)
    return unpacked(let(found.struct, lambda c: packed(_filled(unpacked(c, found.like)))), _WHOLE_VALUE)


def evaluated(rows: DataFrame, target: str, source: str, kinds: str | None = None) -> DataFrame:
    """`rows` with `target`, the number that an expression over number columns gives, `reason`, and its type as `kinds`."""
    env = {n: Value(F.col(n).cast("double"), None, None, F.when(F.col(n).isNull(), MISSING + n), frozenset(("float",))) for n in parsed(source)[1] if n in rows.columns}
    found = rows.withColumn("_value", bound(source, env, packed))
    types = {} if kinds is None else {kinds: F.col("_value.kind")}
    return found.withColumns({target: F.col("_value.num"), "reason": F.col("_value.error"), **types}).drop("_value")


#: Stands for a value that has every field.
_WHOLE_VALUE = Value(*[...] * 4)
