import random

import pytest

from exprloom import ExpressionError, fold, parse, tokenize
from exprloom.syntax import nodes as n


def kinds(source):
    return [(t.type, t.value) for t in tokenize(source)[:-1]]


def test_tokens():
    assert kinds("a |> b ?? c?.d") == [("Identifier", "a"), ("Pipe", "|>"), ("Identifier", "b"), ("NullishCoalescing", "??"), ("Identifier", "c"), ("OptionalChain", "?."), ("Identifier", "d")]
    assert kinds("1_000 0xFF 1.5e-3") == [("Number", "1000"), ("Number", "0xFF"), ("Number", "1.5e-3")]
    assert kinds(r"'a\n\x41B\u{43}\q'") == [("String", "a\nABCq")]
    assert kinds("...x not in true null undefined") == [("Spread", "..."), ("Identifier", "x"), ("Operator", "not"), ("Operator", "in"), ("Boolean", "true"), ("Null", "null"), ("Undefined", "undefined")]


@pytest.mark.parametrize("source", ["a = b", "a & b", "a ^ b", "#", "@", "'abc", "`abc", "`${a", "a === b", r"'\xZZ'"])
def test_bad_characters(source):
    with pytest.raises(ExpressionError) as e:
        parse(source)
    assert 0 <= e.value.start <= len(source)


@pytest.mark.parametrize("source", ["1 +", "1 + 2 |> f + 3", "items.filter(.)", ".", "f(", "[1", "{a:", "a ? b", 'x |> split(",")[0]', "obj.in", "{true: 1}", "a?.5:1", "f?.()", ") ", ""])
def test_syntax_errors(source):
    with pytest.raises(ExpressionError):
        parse(source)


def test_precedence():
    tree = parse("1 + 2 * 3")
    assert tree.operator == "+" and tree.right.operator == "*"
    assert fold(parse("2 ** 3 ** 2")).value == 512
    assert fold(parse("-2 ** 2")).value == 4
    assert parse("a ? b : c |> f").alternate.type == "PipeExpression"
    assert parse("x |> f + 3").operator == "+"
    assert parse("a || b && c ?? d").right.right.operator == "??"
    assert parse("a not in b").operator == "not in"


def test_lambdas():
    body = parse("f(.a * .b + .c)").args[0].body
    assert body.operator == "*" and body.right.body.operator == "+"
    assert parse("f(.a * .b + .c)", standard=True).args[0].body.operator == "+"
    assert parse("f(. > 2)").args[0].body.left.type == "LambdaIdentity"
    assert parse("f(.a?.b[0].c(1))").args[0].type == "LambdaExpression"
    assert parse("f(.x ? 1 : 2)").args[0].body.type == "ConditionalExpression"
    assert parse("f(.x)").args[0] == n.LambdaAccessor(2, 4, "x")


def test_templates_nest_to_a_limit():
    def nested(depth):
        return "1" if not depth else "`${" + nested(depth - 1) + "}`"

    parse(nested(32))
    with pytest.raises(ExpressionError):
        parse(nested(33))
    assert [p.type for p in parse("`a${b}c`").parts] == ["StringLiteral", "Identifier", "StringLiteral"]


@pytest.mark.parametrize(
    ("source", "value"),
    [("1 + 2 * 3", 7.0), ("'a' + 'b'", "ab"), ("true && false", False), ('"1" == 1', False), ("null == null", True), ("!true", False), ("-5", -5.0), ("10 % 3", 1.0), ("1 / 0", float("inf")), ('"a" < "b"', None), ("true ? 1 : 2", 1.0), ("0 ? 1 : 2", 2.0)],
)
def test_fold(source, value):
    tree = fold(parse(source))
    assert (tree.type == "BinaryExpression") if value is None else tree.value == value


def test_not_folded():
    for source in ["null == undefined", "null ?? 1", "1 in [1]", "+'1'"]:
        assert fold(parse(source)).type in ("BinaryExpression", "UnaryExpression")
    assert fold(parse("f(1 + 2)")).args[0].value == 3


def test_junk_raises_syntax_errors_only():
    rng = random.Random(4_711)
    pieces = list("abc123.,:?!()[]{}'\"`$+-*/%<>=&|~ \n") + ["|>", "?.", "??", "&&", "in ", "not ", "...", "${", "null", ".x"]
    for _ in range(1000):
        source = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        try:
            assert parse(source).end <= len(source)
        except ExpressionError:
            pass


def test_deep_input_is_refused_not_fatal():
    tree = parse("[" * 60 + "1" + "]" * 60)
    assert tree.type == "ArrayLiteral"
