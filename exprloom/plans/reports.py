"""What the engine says about expressions themselves, as tables: syntax, references, policy, errors, registry, caches, completions.

Each report runs a list of cases and returns a row a case.  What the language demands for each stands next to it and
is the SQL that the report must agree with.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..autocomplete import create_autocomplete
from ..cache import Cache
from ..engine import Engine, evaluate_expression, references
from ..errors import EngineError, ExpressionError, format_any, format_error, position_at, suggest
from ..functions import typed as t
from ..functions.stdlib import everything, strings
from ..sources import from_contexts, table
from ..syntax import nodes as n
from ..syntax import parse, tokenize
from .fold import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONTEXT = {"user": {"name": "Alice", "age": 25, "address": {"city": "London", "zip": "1"}}, "items": [1, 2, 3], "users": [{"name": "Alice", "age": 25, "active": True}], "groups": [{"users": [{"name": "x"}]}], "text": "abc", "flag": True}


def report(name: str, cases: Sequence[tuple], run: Callable[..., str]) -> None:
    """Register a table of ``label`` and ``outcome``: a case is its label, the inputs of ``run``, and the outcome to be."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(str(c[0]), str(run(*c[1:-1]))) for c in cases], "label string, outcome string")

    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    QUERIES[name] = query
    ORACLES[name] = "SELECT * FROM (VALUES " + ", ".join(f"({quoted(c[0])}, {quoted(c[-1])})" for c in cases) + ") AS r(label, outcome)"


def shown(value) -> str:
    """A value as one text, whatever it is."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return t.python_number_text(value)
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {shown(v)}" for k, v in value.items()) + "}"
    return "[" + ", ".join(map(shown, value)) + "]" if isinstance(value, (list, tuple)) else str(value)


def outcome(options: dict, source: str) -> str:
    """The value of an expression over ``CONTEXT``, or what it fails with."""
    try:
        return shown(Engine(**options).use(everything).evaluate(source, CONTEXT))
    except EngineError as error:
        return f"{type(error).__name__}: {getattr(error, 'code', None) or getattr(error, 'raw_message', None) or error}"
    except Exception as error:  # what a rule raises while running
        text = str(error)
        return "runtime: " + next((k for k in ("MAX_ARRAY_LENGTH", "BLOCKED_PROPERTY", "expects") if k in text), type(error).__name__)


def syntax(source: str) -> str:
    """The tokens of an expression, or where and why it is none."""
    try:
        return " ".join(x.type + (f"({x.value})" if x.value else "") for x in tokenize(source)[:-1] if parse(source))
    except ExpressionError as error:
        at = position_at(source, error.start)
        return f"{error.raw_message} at {at.line}:{at.column} [{error.start}, {error.end})"


def validated(source: str) -> str:
    found = Engine().validate(source)
    names = found.references
    return f"{shown(found.valid)} {'|'.join(map(','.join, (names.identifiers, names.transforms, names.functions)))} {len(found.warnings)}{''.join(e.message for e in found.errors)}"


report("syntax_tokens", [
    ("hex", "0xFF", "Number(0xFF)"), ("separators", "1_000.5e-3", "Number(1000.5e-3)"), ("binary", "0b101 + 0o17", "Number(0b101) Operator(+) Number(0o17)"),
    ("space", "a\t+\r\n1", "Identifier(a) Operator(+) Number(1)"), ("names", "$a_1?.b", "Identifier($a_1) OptionalChain(?.) Identifier(b)"), ("pipe", "a|>b", "Identifier(a) Pipe(|>) Identifier(b)"),
    ("coalesce", "a??b", "Identifier(a) NullishCoalescing(??) Identifier(b)"), ("escape", r"'\x41B\u{43}'", "String(ABC)"), ("template", "`a${b}`", "TemplateLiteral(a${b})"), ("not in", "a not in b", "Identifier(a) Operator(not) Operator(in) Identifier(b)"),
    ("bad sign", "a @ b", 'Unexpected character "@" at 1:3 [2, 3)'), ("single equals", "a = b", 'Unexpected character "=" at 1:3 [2, 3)'), ("greedy chain", "a?.5:1", "Expected Identifier but got \"5\" at 1:4 [3, 4)"), ("open string", "1 +\n'abc", "Unterminated string at 2:1 [4, 8)"),
    ("open template", "`a${b", "Unterminated template expression at 1:3 [2, 5)"), ("end", "1 +", "Unexpected end of expression at 1:4 [3, 3)"), ("bracket", "[1, 2", 'Expected "," but got EOF at 1:6 [5, 5)'), ("bare dot", "items.filter(.)", 'Expected property name or operator after "." at 1:14 [13, 14)'), ("keyword", "a.in", 'Expected Identifier but got "in" at 1:3 [2, 4)'),
], syntax)
report("validation", [
    ("sum", "a.b + c", "true a,c|| 0"), ("calls", "f(x) |> g(y.z)", "true x,y|g|f 0"), ("keys", "{k: v, [m]: 1}", "true k,v,m|| 0"), ("lambda", "xs.map(.price * rate)", "true xs,rate|| 0"), ("index", "a[i]?.b", "true a,i|| 0"),
    ("template", "`${a} ${b |> up}`", "true a,b|up| 0"), ("spread", "max(...xs, 1)", "true xs||max 0"), ("broken", "a +", "false || 0Unexpected end of expression"), ("deep", "(" * 3000, "false || 0Expression is nested too deeply"), ("long", "a" + " + a" * 3000, "true a|| 0"), ("reference", "xs.filter(.a == .b)", "true xs|| 0"),
], validated)
report("policy_codes", [
    ("proto", {}, "user.__proto__", "SecurityError: BLOCKED_PROPERTY"), ("computed", {}, "user['constructor']", "SecurityError: BLOCKED_PROPERTY"), ("name", {}, "prototype", "SecurityError: BLOCKED_PROPERTY"), ("key", {}, "{'__proto__': 1}", "SecurityError: BLOCKED_PROPERTY"), ("lambda", {}, "users.map(.constructor)", "SecurityError: BLOCKED_PROPERTY"),
    ("joined key", {}, "user['constr' + 'uctor']", "SecurityError: BLOCKED_PROPERTY"), ("allowed", {"allowed_properties": ["name"]}, "user.name", "Alice"), ("not allowed", {"allowed_properties": ["name"]}, "user.age", "SecurityError: PROPERTY_NOT_ALLOWED"), ("method not allowed", {"allowed_properties": ["name"]}, "user.name.slice(1)", "SecurityError: PROPERTY_NOT_ALLOWED"),
    ("index exempt", {"allowed_properties": ["name"]}, "users[0].name", "Alice"), ("index text", {"allowed_properties": ["name"]}, "users['0'].name", "Alice"), ("key exempt", {"allowed_properties": ["x"]}, "{y: items}.x ?? text", "abc"), ("identifier exempt", {"denied_properties": ["text"]}, "text", "abc"),
    ("denied", {"denied_properties": ["age"]}, "user.age", "SecurityError: PROPERTY_DENIED"), ("denied in lambda", {"denied_properties": ["age"]}, "users.filter(.age > 1)", "SecurityError: PROPERTY_DENIED"), ("denied method", {"denied_properties": ["slice"]}, "text['slice'](1)", "SecurityError: PROPERTY_DENIED"), ("not denied", {"denied_properties": ["age"]}, "user.name", "Alice"),
    ("depth", {"max_depth": 3}, "user.address.city.length.x", "SecurityError: MAX_DEPTH"), ("atoms", {"max_depth": 1}, "text", "abc"), ("deep sum", {}, "1" + " + flag" * 150, "SecurityError: MAX_DEPTH"), ("long literal", {"max_array_length": 3}, "[1, 2, 3, 4]", "SecurityError: MAX_ARRAY_LENGTH"), ("long spread", {"max_array_length": 2}, "[...items]", "runtime: MAX_ARRAY_LENGTH"), ("fits", {"max_array_length": 3}, "[...items].length", "3"),
    ("receiver", {}, "items.sort()", "SecurityError: METHOD_NOT_ALLOWED"), ("push", {}, "items.push(1)", "SecurityError: METHOD_NOT_ALLOWED"), ("array method of text", {}, "text.map(. + 1)", "SecurityError: METHOD_NOT_ALLOWED"), ("object method", {}, "user.toString()", "SecurityError: METHOD_NOT_ALLOWED"), ("own names", {}, "1 |> hasOwnProperty", 'ExpressionReferenceError: Unknown transform "hasOwnProperty"'),
], outcome)
report("type_errors", [
    ("in", {}, "1 in 2", 'ExpressionTypeError: "in" expects a string or array, got number'), ("in object", {}, "1 in {a: 1}", 'ExpressionTypeError: "in" expects a string or array, got object'), ("spread", {}, "[...5]", 'ExpressionTypeError: "spread" expects an iterable value, got number'), ("spread null", {}, "[...null]", 'ExpressionTypeError: "spread" expects an iterable value, got null'), ("spread object", {}, "max(...user)", 'ExpressionTypeError: "spread" expects an iterable value, got object'),
    ("count", {}, "text |> count", 'ExpressionTypeError: "count" expects an array, got string'), ("upper", {}, "5 |> upper", 'ExpressionTypeError: "upper" expects a string, got number'), ("sum", {}, "['a'] |> sum", 'ExpressionTypeError: "sum" expects an array of numbers, got array of string'), ("unknown transform", {}, "text |> uper", 'ExpressionReferenceError: Unknown transform "uper". Did you mean "upper"?'), ("unknown function", {}, "mix(1)", 'ExpressionReferenceError: Unknown function "mix". Did you mean "min"?'),
    ("far off", {}, "frobnicate(1)", 'ExpressionReferenceError: Unknown function "frobnicate"'), ("null receiver", {"strict": True}, "missing.trim()", 'ExpressionTypeError: "trim" expects a string, array or number, got undefined'), ("lenient receiver", {}, "missing.trim() ?? 'none'", "none"), ("optional", {"strict": True}, "missing?.trim() ?? 'none'", "none"), ("missing column", {"missing": "error"}, "usr", 'ExpressionReferenceError: Unknown column "usr". Did you mean "user"?'),
    ("function as value", {}, ".x", 'ExpressionTypeError: "expression" expects a value, got function'), ("repeat", {}, "text.repeat(-1)", 'ExpressionTypeError: "repeat" expects a count from 0 to 100000, got -1.0'),
], outcome)


def error_text(kind: str, source: str) -> str:
    """An error as it is shown, on one line."""
    if kind == "position":
        at = position_at(source, len(source) - 1)
        return f"{at.line}:{at.column}:{at.offset}"
    if kind == "suggest":
        return str(suggest(source, ["upper", "lower", "trim"]))
    try:
        Engine().use(everything).evaluate(source, CONTEXT)
    except EngineError as error:
        text = format_any(error)
        located = getattr(error, "location", None)
        if located is not None and format_error(str(error), located) != text:
            return "differs"
        return text.replace("\n", "/")
    return "none"


report("error_texts", [
    ("syntax", "shown", "1 +", "Unexpected end of expression//1 | 1 +/       ^//at line 1, column 4 (offset 3-4)"), ("second line", "shown", "1 +\n  @", 'Unexpected character "@"//2 |   @/      ^//at line 2, column 3 (offset 6-7)'), ("member", "shown", "user.__proto__", 'Access to "__proto__" is blocked//1 | user.__proto__/    ^^^^^^^^^^^^^^//at line 1, column 1 (offset 0-14)'),
    ("innermost", "shown", "1 + (text |> count)", '"count" expects an array, got string//1 | 1 + (text |> count)/         ^^^^^^^^^^^^^//at line 1, column 6 (offset 5-18)'), ("first line", "position", "abc", "1:3:2"), ("third line", "position", "a\n\nbc", "3:2:4"),
    ("near", "suggest", "uper", "upper"), ("nearest first", "suggest", "lowr", "lower"), ("far", "suggest", "xyz12", "None"), ("long", "suggest", "u" * 65, "None"),
], error_text)
report("fold_values", [
    ("power", "2 ** 3 ** 2", "NumberLiteral 512"), ("logic", "true && false", "BooleanLiteral false"), ("text", "'a' + 'b'", "StringLiteral ab"), ("choice", "1 > 2 ? x : y", "Identifier y"), ("null", "null == null", "BooleanLiteral true"), ("nested", "(1 + 2) * a", "BinaryExpression"), ("negative", "-(3)", "NumberLiteral -3"), ("division", "1 / 0", "NumberLiteral Infinity"), ("not", "!true", "BooleanLiteral false"), ("kept", "a + 1", "BinaryExpression"),
], lambda source: (lambda x: x.type + (f" {shown(x.value)}" if hasattr(x, "value") else f" {x.name}" if isinstance(x, n.Identifier) else ""))(fold(parse(source))))


def registry_steps(step: str) -> str:
    """One use of the registry, from a new engine."""
    e = Engine().use(strings)
    try:
        return shown(_registry_step(e, step))
    except (EngineError, TypeError) as error:
        return type(error).__name__


def _registry_step(e: Engine, step: str):
    twice = lambda v: t.of(t.to_number(v) * 2, t.DOUBLE)
    if step == "plugin":
        return e.use(lambda x: x.add_function("one", lambda: t.number(1))).evaluate("one() + 1")
    if step == "listed":
        return e.list_transforms()[:3] + e.list_functions()
    if step == "added":
        return e.add_transform("twice", twice).evaluate("4 |> twice")
    if step == "overwritten":
        return e.add_transform("upper", twice).evaluate("4 |> upper")
    if step == "removed":
        return [e.remove_transform("upper"), e.remove_transform("upper"), e.has_transform("upper"), e.has_transform("lower"), e.remove_function("none")]
    if step == "apart":
        return [e.has_function("upper"), Engine().has_transform("upper"), e.evaluate("upper(1)")]
    if step == "by name only":
        return e.evaluate("text.toUpperCase", {"text": "a"}) is None and e.evaluate("toString |> upper", {})
    if step == "later change":
        compiled = e.add_transform("f", lambda v: t.number(1)).compile("1 |> f", from_contexts(_spark(), [{"a": 1}]))
        before = compiled.evaluate({"a": 1})
        e.add_transform("f", lambda v: t.number(2))
        return [before, compiled.evaluate({"a": 1})]
    if step == "coroutine":
        async def later(x):
            return x

        return e.add_transform("bare", later)
    if step == "compiled":
        compiled = e.compile("a + 1", from_contexts(_spark(), [{"a": 1}]))
        return [compiled.source, compiled.ast.type, compiled.data_type.simpleString(), compiled.evaluate({"a": 2})]
    if step == "policy":
        return [Engine(denied_properties=["b", "a"]).get_policy(), e.get_policy()]
    if step == "defaults":
        o = e.options
        return [o.timeout, o.max_depth, o.max_array_length, o.cache_size, o.strict]
    if step == "caches":
        first = e.parse("a + 1")
        same = e.parse("a + 1") is first
        e.clear_cache()
        return [same, e.parse("a + 1") is first]
    if step == "eviction":
        made: list[str] = []
        cache = Cache(2)
        for key in "aabcabb":
            cache.get(key, lambda key=key: made.append(key) or key)
        return ["".join(made), len(cache), Cache(0).get("x", lambda: 1), len(Cache(0))]
    if step == "shared default":
        return evaluate_expression("a.b ?? 'none'", {"a": {"b": 1}})
    if step == "pruning":
        return list(references(parse("{k: v, [m]: w.x}"), keys=False).identifiers)
    if step == "independent":
        other = Engine().use(strings)
        other.remove_transform("upper")
        return [e.has_transform("upper"), e.evaluate("'a' |> upper"), e.evaluate("'b' |> upper")]
    raise ValueError(step)


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


report("registry", [
    ("plugin", "plugin", "2"), ("listed", "listed", "[upper, lower, trim]"), ("added", "added", "8"), ("overwritten", "overwritten", "8"), ("removed", "removed", "[true, false, false, true, false]"), ("apart", "apart", "ExpressionReferenceError"), ("later change", "later change", "[1, 2]"), ("coroutine", "coroutine", "TypeError"), ("compiled", "compiled", "[a + 1, BinaryExpression, double, 3]"),
    ("policy", "policy", "[{denied_properties: [a, b]}, {}]"), ("defaults", "defaults", "[0, 100, 100000, 256, false]"), ("caches", "caches", "[true, false]"), ("eviction", "eviction", "[abcab, 2, 1, 0]"), ("shared default", "shared default", "1"), ("pruning", "pruning", "[v, m, w]"), ("independent", "independent", "[true, A, B]"),
], registry_steps)


def completed(source: str, options: dict) -> str:
    """The first three labels offered, and how the first is put in."""
    found = create_autocomplete(Engine(**options).use(everything), CONTEXT).complete(source)
    first = found[0] if found else None
    return " ".join(c.label for c in found[:3]) + (f" [{first.kind}, {first.detail}, {first.insert_text}, {first.cursor_offset}]" if first else "")


report("completions", [
    ("member", "user.na", {}, "name [property, string, None, None]"), ("nested", "user.address.c", {}, "city [property, string, None, None]"), ("lambda", "users.filter(.ag", {}, "age [property, number, None, None]"), ("nested lambda", "groups.map(.users.filter(.na", {}, "name [property, string, None, None]"), ("chain", "users.filter(.age > 1).map(.ac", {}, "active [property, boolean, None, None]"),
    ("method", "users.filt", {}, "filter [method, array → array, filter(.), 7]"), ("string method", "user.name.padS", {}, "padStart [method, string → string, padStart(), 9]"), ("transform", "items |> su", {}, "sum isNull isNumber [transform, None, None, None]"), ("piped type", "user.name |> upper |> trimm", {}, ""), ("wrong input", "user.name |> coun", {}, ""), ("keyword", "not", {}, "not in [keyword, None, None, None]"), ("function", "mi", {}, "min [function, None, min(), 4]"),
    ("text", "'user.", {}, ""), ("template text", "`user.", {}, ""), ("hole", "`${user.na", {}, "name [property, string, None, None]"), ("denied", "user.ag", {"denied_properties": ["age"]}, ""), ("variable", "user", {}, "user users [variable, object, None, None]"), ("preview", "tex", {}, 'text [variable, "abc", None, None]'), ("broken", "((((", {}, "flag text user [variable, true, None, None]"), ("unknown", "nope.", {}, ""), ("element", "users[0].ac", {}, "active [property, boolean, None, None]"),
], completed)


def strict_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict engine with lists of names over a table: rows whose receiver is never null pass as usual."""
    e = Engine(strict=True, missing="error", denied_properties=["repeat"], max_array_length=10).use(everything)
    return e.select(e.where(table(spark, sf_dir, "part"), "p_size > 10"), {"key": "p_partkey", "name": "p_name.toUpperCase()", "pair": "[p_brand, ...[p_type]].join('/')"})


QUERIES["strict_rules"] = strict_rules
ORACLES["strict_rules"] = "SELECT p_partkey AS key, upper(p_name) AS name, p_brand || '/' || p_type AS pair FROM part WHERE p_size > 10"


def timeout_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of an action that is cancelled for taking too long, and the value of one that is not."""
    e = Engine(timeout=150)
    slow = spark.range(0, 40_000_000_000, numPartitions=4).select(F.max(F.xxhash64("id")))
    try:
        e.collect(slow)
        late = "none"
    except EngineError as error:
        late = error.code
    quick = Engine(timeout=60_000).evaluate("a * 2", {"a": 4})
    return spark.createDataFrame([("late", late), ("quick", shown(quick))], "label string, outcome string")


QUERIES["timeout_code"] = timeout_code
ORACLES["timeout_code"] = "SELECT * FROM (VALUES ('late', 'TIMEOUT'), ('quick', '8')) AS r(label, outcome)"
