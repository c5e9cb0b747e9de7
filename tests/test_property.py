"""Generated expressions: compiled columns against a small interpreter that lives only here."""

import math
import random

from exprloom import Engine, fold, parse
from tests.helpers import evaluate_all, same

CONTEXT = {"width": 4.0, "depth": 2.25, "word": "maple", "ready": True, "nothing": 0.0, "sizes": [8.0, 0.5, 12.0], "tree": {"rings": 61.0, "kind": "acer"}}


def generate(rng, depth, kind):
    """An expression of a kind: number, text or truth."""
    if depth == 0 or rng.random() < 0.15:
        return rng.choice({"number": ["width", "depth", "nothing", "1", "2.5", "tree.rings", "sizes[1]", "word.length"], "text": ["word", "tree.kind", "'a'", "''"], "truth": ["ready", "true", "false"]}[kind])
    sub = lambda k: generate(rng, depth - 1, k)
    return {
        "number": lambda: rng.choice([lambda: f"({sub('number')} {rng.choice(['+', '-', '*', '/', '%'])} {sub('number')})", lambda: f"(-{sub('number')})", lambda: f"({sub('truth')} ? {sub('number')} : {sub('number')})", lambda: f"sizes.map(. + {sub('number')})[0]"])(),
        "text": lambda: rng.choice([lambda: f"({sub('text')} + {sub('text')})", lambda: f"`<${{{sub('number')}}}|${{{sub('text')}}}>`", lambda: f"({sub('truth')} ? {sub('text')} : {sub('text')})", lambda: f"({sub('text')} || {sub('text')})"])(),
        "truth": lambda: rng.choice([lambda: f"({sub('number')} {rng.choice(['<', '>', '<=', '>=', '==', '!='])} {sub('number')})", lambda: f"({sub('truth')} {rng.choice(['&&', '||'])} {sub('truth')})", lambda: f"(!{sub(rng.choice(['truth', 'number', 'text']))})", lambda: f"({sub('text')} in {sub('text')})", lambda: f"sizes.some(. > {sub('number')})", lambda: f"({sub('number')} not in sizes)"])(),
    }[kind]()


def text_of(x):
    if isinstance(x, str):
        return x
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e16:
        return str(int(x))
    shown = repr(x)
    if "e" in shown:  # the generated numbers stay below 1e21
        mantissa, power = shown.split("e")
        power = int(power)
        if power < -6:
            return f"{mantissa}e-{-power}"
        digits = mantissa.lstrip("-").replace(".", "")
        sign = "-" if x < 0 else ""
        return sign + (digits.ljust(power + 1, "0") if power > 0 else "0." + "0" * (-power - 1) + digits)
    return shown[:-2] if shown.endswith(".0") else shown


def run(node, item=None):
    go = lambda n: run(n, item)
    kind = node.type
    if kind in ("NumberLiteral", "StringLiteral", "BooleanLiteral"):
        return node.value
    if kind == "Identifier":
        return CONTEXT[node.name]
    if kind == "LambdaIdentity":
        return item
    if kind == "LambdaExpression":
        return run(node.body, item)
    if kind == "TemplateLiteral":
        return "".join(text_of(run(p)) for p in node.parts)
    if kind == "MemberExpression":
        owner = go(node.object)
        if node.computed:
            return owner[int(go(node.property))]
        return float(len(owner)) if node.property.name == "length" else owner[node.property.name]
    if kind == "CallExpression":
        method, (body,) = node.callee.property.name, node.args
        results = [run(body, x) for x in go(node.callee.object)]
        return results if method == "map" else any(results)
    if kind == "UnaryExpression":
        value = go(node.argument)
        return -value if node.operator == "-" else not (value and value == value)
    if kind == "ConditionalExpression":
        return go(node.consequent) if go(node.test) else go(node.alternate)
    a, op = go(node.left), node.operator
    if op == "&&":
        return a and go(node.right)
    if op == "||":
        return a if a and a == a else go(node.right)
    b = go(node.right)
    if op in ("in", "not in"):
        return (b.find(a) >= 0 if isinstance(b, str) else a in b) == (op == "in")
    if op in ("+", "-", "*"):
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]()
    if op == "/":
        return a / b if b else math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
    if op == "%":
        return math.nan if not b or math.isinf(a) or b != b else math.fmod(a, b)
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "==": a == b, "!=": a != b}[op]


def test_compiled_columns_agree_with_the_interpreter(spark):
    rng, engine = random.Random(20_26), Engine()
    sources = [generate(rng, 3, rng.choice(["number", "text", "truth"])) for _ in range(300)]
    want = [run(parse(s)) for s in sources]
    keep = [k for k, w in enumerate(want) if not (isinstance(w, float) and abs(w) > 1e20) and "-0" not in str(w) and "Infinity" not in str(w) and w not in (math.inf, -math.inf)]
    got = evaluate_all(spark, engine, CONTEXT, [sources[k] for k in keep])
    wrong = [(sources[k], g, want[k]) for k, g in zip(keep, got, strict=True) if not (same(g, want[k]) or (isinstance(g, (int, float)) and not isinstance(g, bool) and g == want[k]))]
    assert len(keep) > 180 and not wrong


def test_folding_changes_no_value(spark):
    rng, engine = random.Random(5), Engine()
    sources = [generate(rng, 3, "number").replace("num", "4").replace("other", "2") for _ in range(40)]
    for s in sources:
        assert fold(fold(parse(s))) == fold(parse(s))
    assert len(evaluate_all(spark, engine, CONTEXT, sources)) == 40
