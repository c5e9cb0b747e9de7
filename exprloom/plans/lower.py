"""Lowering: a syntax tree over a schema becomes one Spark column.

There are two modes.  A value has the language's exact result, so a comparison with null is false.  A
predicate stands where null counts as false anyway; there comparisons, ``&&``, ``||`` and ``in`` stay bare
Spark operators, which scans can apply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionReferenceError, ExpressionTypeError, LocatedError, suggest
from ..functions import typed as t
from ..functions.typed import Val
from ..operators import arithmetic as ops
from ..operators import methods
from ..policy import BLOCKED, Policy
from ..registry import Registry
from ..syntax import nodes as n

COMPARISONS = ("<", ">", "<=", ">=")
LOGIC = ("&&", "||")


def field_column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Lowering:
    def __init__(self, source: str, schema: T.StructType, registry: Registry, policy: Policy):
        self.source, self.registry, self.policy, self.options = source, registry, policy, policy.options
        self.fields = {f.name: f.dataType for f in schema.fields}
        self.bound: dict[int, Val] = {}

    # Entry points.

    def value(self, node: n.Node) -> Val:
        self.policy.depth(node)
        hosts = self.hoisted(node)
        out = self.around(hosts, node) if hosts else self.lower(node)
        if out.kind == "function":
            error = ExpressionTypeError("expression", "a value", "function")
            error.locate(self.source, node.start, node.end)
            raise error
        return out

    def predicate(self, node: n.Node) -> Column:
        self.policy.depth(node)
        return t.filter_condition(self.value(node)) if self.hoisted(node) else self.condition(node, None)

    # Host code inside lambdas.  Spark runs no Python inside a lambda, but a call there is about the outer row: it is made once
    # for the row, outside, and its value is passed in.

    def hoisted(self, node: n.Node) -> list[n.Node]:
        """All outermost calls of host code, if any stands inside a lambda."""
        found, inside, rest = [], False, [(node, False)]
        while rest:
            x, in_lambda = rest.pop()
            if self.is_host(x):
                found.append(x)
                inside = inside or in_lambda
                continue
            in_lambda = in_lambda or isinstance(x, n.LambdaExpression)
            rest += [(c, in_lambda) for c in x.children()]
        return found if inside else []

    def is_host(self, node: n.Node) -> bool:
        if isinstance(node, n.PipeExpression):
            stage = node.transform.callee if isinstance(node.transform, n.CallExpression) else node.transform
            entry = self.registry.transforms.get(stage.name) if isinstance(stage, n.Identifier) else None
        else:
            entry = self.registry.functions.get(node.callee.name) if isinstance(node, n.CallExpression) and isinstance(node.callee, n.Identifier) else None
        return entry is not None and entry.host

    def around(self, hosts: list[n.Node], node: n.Node) -> Val:
        calls, out = [self.lower(h) for h in hosts], []

        def body(row: Column) -> Column:
            self.bound = {id(h): t.of(row[f"c{k}"], v.type) for k, (h, v) in enumerate(zip(hosts, calls, strict=True))}
            out.append(self.lower(node))
            return out[-1].col

        made = F.struct(*[v.col.alias(f"c{k}") for k, v in enumerate(calls)])
        value = F.get(F.transform(F.array(made), body), F.lit(0))
        self.bound = {}
        return t.of(value, out[-1].type)

    # Nodes.  ``item`` is the element a lambda body is about; outside lambda bodies it is None.

    def lower(self, node: n.Node, item: Val | None = None) -> Val:
        if id(node) in self.bound:
            return self.bound[id(node)]
        try:
            return getattr(self, f"_{type(node).__name__}")(node, item)
        except LocatedError as error:
            error.locate(self.source, node.start, node.end)
            raise

    def condition(self, node: n.Node, item: Val | None) -> Column:
        """The node's truth where null counts as false."""
        if isinstance(node, n.BinaryExpression):
            if node.operator in LOGIC:
                a, b = self.condition(node.left, item), self.condition(node.right, item)
                return a & b if node.operator == "&&" else a | b
            if node.operator not in ("??",):
                return t.filter_condition(self.bare(node, item))
        if isinstance(node, n.UnaryExpression) and node.operator == "!":
            inner = node.argument
            if isinstance(inner, n.BinaryExpression) and inner.operator in ("==", "!="):
                flipped = "!=" if inner.operator == "==" else "=="
                return self.condition(n.BinaryExpression(inner.start, inner.end, flipped, inner.left, inner.right), item)
        return t.filter_condition(self.lower(node, item))

    def bare(self, node: n.BinaryExpression, item: Val | None) -> Val:
        """A comparison, membership or arithmetic whose null has not been made false."""
        try:
            op = node.operator
            left = self.lower(node.left, item)
            if op in ("in", "not in"):
                right = self.lower(node.right, item)
                literal = None
                if isinstance(node.right, n.ArrayLiteral) and not any(isinstance(e, n.SpreadElement) for e in node.right.elements):
                    literal = [self.lower(e) for e in node.right.elements]
                return ops.contains(left, right, op == "not in", literal)
            return ops.binary(op, left, self.lower(node.right, item))
        except LocatedError as error:
            error.locate(self.source, node.start, node.end)
            raise

    def _NumberLiteral(self, node, item):
        return t.number(node.value)

    def _StringLiteral(self, node, item):
        return t.string(node.value)

    def _BooleanLiteral(self, node, item):
        return t.boolean(node.value)

    def _NullLiteral(self, node, item):
        return t.null()

    def _UndefinedLiteral(self, node, item):
        return t.null(True)

    def _Identifier(self, node, item):
        self.policy.name(node.name, "identifier")
        if node.name in self.fields:
            return t.of(field_column(node.name), self.fields[node.name])
        if self.options.missing == "error":
            raise ExpressionReferenceError("column", node.name, suggest(node.name, self.fields))
        return t.null(True)

    def _BinaryExpression(self, node, item):
        op = node.operator
        if op in LOGIC:
            return self.logic(node, item)
        if op == "??":
            return ops.coalesce(self.lower(node.left, item), self.lower(node.right, item))
        out = self.bare(node, item)
        if op in (*COMPARISONS, "in", "not in") and not out.known:
            return t.of(F.coalesce(out.col, F.lit(False)), t.BOOLEAN)
        return out

    def logic(self, node: n.BinaryExpression, item: Val | None) -> Val:
        """The operand that decides, as a value."""
        a = self.lower(node.left, item)
        if a.known:
            decides = bool(a.const) and a.const == a.const
            return a if decides == (node.operator == "||") else self.lower(node.right, item)
        b = self.lower(node.right, item)
        test = t.truthy(a)
        return ops.choose(test, b, a) if node.operator == "&&" else ops.choose(test, a, b)

    def _UnaryExpression(self, node, item):
        if node.operator == "!":
            inner = self.lower(node.argument, item)
            if inner.kind == "function":
                raise ExpressionTypeError("!", "a value", "function")
            return ops.inverse(inner)
        return (ops.negative if node.operator == "-" else ops.positive)(self.lower(node.argument, item))

    def _ConditionalExpression(self, node, item):
        test = self.lower(node.test, item)
        if test.known:
            return self.lower(node.consequent if test.const and test.const == test.const else node.alternate, item)
        return ops.choose(self.condition(node.test, item), self.lower(node.consequent, item), self.lower(node.alternate, item))

    def _MemberExpression(self, node, item):
        owner = self.lower(node.object, item)
        if not node.computed:
            self.policy.name(node.property.name, "member")
            return ops.member(owner, node.property.name)
        key = self.lower(node.property)
        if key.known and key.const is not None:
            self.policy.name(t._literal_text(key.const), "member")
        elif isinstance(owner.type, T.MapType) and key.kind == "string":
            banned = sorted(BLOCKED | (self.options.denied_properties or frozenset()))
            bad = key.col.isin(*banned)
            if self.options.allowed_properties is not None:
                bad = bad | ~key.col.isin(*sorted(self.options.allowed_properties))
            key = t.of(F.when(bad, F.raise_error(F.lit("BLOCKED_PROPERTY"))).otherwise(key.col), key.type)
        return ops.element(owner, key)

    def _OptionalMemberExpression(self, node, item):
        owner = self.lower(node.object, item)
        if owner.kind == "null":
            return t.null(True)
        return self._MemberExpression(node, item)

    def _ArrayLiteral(self, node, item):
        runs: list[Val] = []
        singles: list[Val] = []
        count = 0

        def flush() -> None:
            if singles:
                cols, type_ = t.unify(singles)
                runs.append(Val(F.array(*cols), T.ArrayType(type_, True), parts=tuple(cols)))
                singles.clear()

        for element in node.elements:
            if isinstance(element, n.SpreadElement):
                spread = self.spread(element)
                if isinstance(spread, list):
                    singles += spread
                    count += len(spread)
                else:
                    flush()
                    runs.append(spread)
            else:
                singles.append(self.lower(element))
                count += 1
            self.policy.length(count)
        flush()
        if not runs:
            return t.array_of(F.array().cast("array<void>"), t.VOID)
        return runs[0] if len(runs) == 1 else methods.concatenated(runs)

    def spread(self, element: n.SpreadElement) -> list[Val] | Val:
        """The elements, where they are known while compiling, else an array column no longer than the limit."""
        inner = element.argument
        if isinstance(inner, n.ArrayLiteral) and not any(isinstance(e, n.SpreadElement) for e in inner.elements):
            return [self.lower(e) for e in inner.elements]
        value = self.lower(inner)
        if value.known and isinstance(value.const, str):
            return [t.string(c) for c in value.const]
        if value.kind == "string":
            value = methods.split(value, t.string(""))
        if value.kind != "array":
            raise ExpressionTypeError("spread", "an iterable value", value.label)
        most = self.options.max_array_length
        long = F.raise_error(F.lit(f"MAX_ARRAY_LENGTH: an array exceeds the limit of {most}"))
        return t.of(F.when(F.size(value.col) > most, long).otherwise(value.col), value.type)

    def _ObjectLiteral(self, node, item):
        entries: list[tuple[Val, Val]] = []
        for p in node.properties:
            if p.computed:
                key = self.lower(p.key)
                key = t.string(t._literal_text(key.const)) if key.known and key.const is not None else key
            else:
                key = t.string(p.key.value if isinstance(p.key, n.StringLiteral) else p.key.name)
            if key.known:
                self.policy.name(str(key.const), "object-key")
            value = self.lower(p.value)
            if value.kind == "function":
                raise ExpressionTypeError(str(key.const), "a value", "function")
            entries.append((key, value))
        if all(key.known for key, _ in entries):
            last = {key.const: value for key, value in entries}
            kept = [(name, v) for name, v in last.items()]
            fields = [T.StructField(name, v.type) for name, v in kept]
            return t.of(F.struct(*[v.col.alias(name) for name, v in kept]), T.StructType(fields))
        values, type_ = t.unify([v for _, v in entries])
        keys = [t.to_text(k) for k, _ in entries]
        rows = []
        for k, (key, value) in enumerate(zip(keys, values, strict=True)):
            pair = F.struct(key.alias("key"), value.alias("value"))
            later = keys[k + 1 :]
            rows.append(F.when(~key.isin(*later), pair) if later else pair)
        return t.of(F.map_from_entries(F.array_compact(F.array(*rows))), T.MapType(t.STRING, type_))

    def _TemplateLiteral(self, node, item):
        parts = [self.lower(p) for p in node.parts]
        if all(p.known for p in parts):
            return t.string("".join(t._literal_text(p.const) if p.const is not None else p.label for p in parts))
        return t.of(F.concat(*[t.to_text(p) for p in parts]), t.STRING)

    def _SpreadElement(self, node, item):
        return self.lower(node.argument)

    # Lambdas.  A body looks at its item only through members, operators and choices; all else, arguments of methods
    # included, is about the outer row, and a lambda among them is a function of its own item.

    def _LambdaAccessor(self, node, item):
        self.policy.name(node.property, "member")
        if item is not None:
            return ops.member(item, node.property)
        return Val(None, t.VOID, fn=lambda x: ops.member(x, node.property))

    def _LambdaIdentity(self, node, item):
        return item if item is not None else Val(None, t.VOID, fn=lambda x: x)

    def _LambdaExpression(self, node, item):
        if item is not None:
            return self.lower(node.body, item)
        return Val(None, t.VOID, fn=lambda x: self.lower(node.body, x))

    # Calls.

    def arguments(self, nodes: tuple[n.Node, ...], whole_array: bool = False) -> list[Val]:
        out: list[Val] = []
        for node in nodes:
            if not isinstance(node, n.SpreadElement):
                out.append(self.lower(node))
                continue
            spread = self.spread(node)
            if isinstance(spread, list):
                out += spread
            elif whole_array and len(nodes) == 1:
                out.append(spread)
            else:
                raise ExpressionTypeError("spread", "an array that is known when compiling", "an array column")
        return out

    def _CallExpression(self, node, item):
        callee = node.callee
        if isinstance(callee, (n.MemberExpression, n.OptionalMemberExpression)):
            receiver = self.lower(callee.object, item)
            optional = isinstance(callee, n.OptionalMemberExpression)
            if optional and receiver.kind == "null":
                return t.null(True)
            if callee.computed:
                key = self.lower(callee.property)
                if not key.known:
                    raise ExpressionTypeError("()", "a method name that is known when compiling", "a computed name")
                name = t._literal_text(key.const)
            else:
                name = callee.property.name
            self.policy.name(name, "method")
            return methods.call(receiver, name, self.arguments(node.args), self.options.strict and not optional)
        if not isinstance(callee, n.Identifier):
            raise ExpressionTypeError("()", "the name of a function", callee.type)
        entry = self.registry.functions.get(callee.name)
        if entry is None:
            raise ExpressionReferenceError("function", callee.name, suggest(callee.name, self.registry.functions))
        return entry.build(self.arguments(node.args, entry.spread))

    def _PipeExpression(self, node, item):
        stage, args = node.transform, ()
        if isinstance(stage, n.CallExpression):
            stage, args = stage.callee, stage.args
        if not isinstance(stage, n.Identifier):
            raise ExpressionTypeError("|>", "the name of a transform", stage.type)
        value = self.lower(node.input)
        entry = self.registry.transforms.get(stage.name)
        if entry is None:
            raise ExpressionReferenceError("transform", stage.name, suggest(stage.name, self.registry.transforms))
        if value.kind == "null" and entry.accepts and not self.options.strict and not value.known:
            return t.null(True)
        return entry.build([value, *self.arguments(args)])
