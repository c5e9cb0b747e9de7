"""Registry, policy, caches, push-down, streaming, UDFs."""

import pytest
from pyspark.sql import functions as F

from exprloom import Engine, ExpressionError, SecurityError, parse, references
from exprloom.autocomplete import create_autocomplete
from exprloom.cache import Cache
from exprloom.errors import suggest
from exprloom.functions import typed as t
from exprloom.functions.stdlib import everything, strings
from exprloom.sources import from_contexts

DATA = "/root/testdata/sf0.001"


def test_registry(spark):
    e = Engine().use(strings)
    assert e.has_transform("upper") and not e.has_function("min") and e.list_transforms()[0] == "upper"
    e.add_transform("twice", lambda v: t.of(t.to_number(v) * 2, t.DOUBLE)).add_function("one", lambda: t.number(1))
    assert e.evaluate("3 |> twice") == 6 and e.evaluate("one() + 1") == 2
    df = spark.range(1)
    compiled = e.compile("id |> twice", df)
    assert df.select(compiled.column).first()[0] == 0
    e.add_transform("twice", lambda v: t.of(t.to_number(v) + 5, t.DOUBLE))
    assert df.select(compiled.column).first()[0] == 5
    assert e.remove_transform("twice") and not e.remove_transform("twice")
    with pytest.raises(Exception, match="Unknown transform"):
        _ = compiled.column


def test_python_code(spark):
    async def later(x):
        return x + 1

    e = Engine().use(everything)
    e.add_transform("plus", later, returns="double").add_transform("shout", lambda s: s + "!", returns="string").add_transform("half", lambda s: s / 2, returns="double", vectorized=True)
    df = from_contexts(spark, [{"n": 1, "s": "a"}, {"n": 2, "s": "b"}])
    rows = e.select(df, {"a": "n |> plus", "b": "s |> shout", "c": "n |> half"}).collect()
    assert sorted(map(tuple, rows)) == [(2.0, "a!", 0.5), (3.0, "b!", 1.0)]
    with pytest.raises(TypeError):
        e.add_transform("bare", later)


def test_python_code_inside_lambdas(spark):
    async def tax(rate=5.0):
        return rate

    e = Engine().use(everything)
    e.add_function("tax", tax, returns="double").add_transform("twice", lambda x: x * 2, returns="double").add_function("word", lambda: "b", returns="string")
    context = {"items": [{"price": 10, "of": [1, 2]}, {"price": 20, "of": []}], "rate": 7, "words": ["a", "b"]}
    cases = {
        "items |> map(.price + tax())": [15.0, 25.0],
        "items.map(.price + tax(rate)).join()": "17,27",
        "items.filter(.price > tax(15)).length + (rate |> twice)": 15.0,
        "words.find(. == word())": "b",
        "words.findIndex(. == word())": 1,
        "items.some(.price == tax(20)) && items.every(.price > tax())": True,
        "items.flatMap(.of.map(. + tax()))": [6.0, 7.0],
        "words |> filter(. != word()) |> first": "a",
    }
    assert {s: e.evaluate(s, context) for s in cases} == cases
    df = from_contexts(spark, [context, context | {"rate": 30}])
    assert e.where(df, "items.some(.price > tax(rate))").count() == 1


def test_asynchronous_evaluation(spark):
    import asyncio

    async def both():
        return await asyncio.gather(Engine().evaluate_async("a + 1", {"a": 1}), Engine().evaluate_async("a + 'x'", {"a": "y"}))

    assert asyncio.run(both()) == [2.0, "yx"]


@pytest.mark.parametrize(
    ("options", "source", "code"),
    [
        ({}, "obj.__proto__", "BLOCKED_PROPERTY"), ({}, "obj['__proto__']", "BLOCKED_PROPERTY"), ({}, "constructor", "BLOCKED_PROPERTY"), ({}, "{'__proto__': 1}", "BLOCKED_PROPERTY"), ({}, "obj.map(.prototype)", "BLOCKED_PROPERTY"),
        ({"allowed_properties": ["name"]}, "xs.length", "PROPERTY_NOT_ALLOWED"), ({"denied_properties": ["name"]}, "obj.name", "PROPERTY_DENIED"), ({"denied_properties": ["slice"]}, "'abc'['slice'](0, 1)", "PROPERTY_DENIED"), ({"denied_properties": ["name"]}, "xs.map(.name)", "PROPERTY_DENIED"),
        ({"max_depth": 3}, "a.b.c.d.e", "MAX_DEPTH"), ({"max_array_length": 3}, "[1, 2, 3, 4]", "MAX_ARRAY_LENGTH"), ({"max_array_length": 3}, "[1, ...[2, 3, 4]]", "MAX_ARRAY_LENGTH"),
    ],
)
def test_policy(spark, options, source, code):
    with pytest.raises(SecurityError) as e:
        Engine(**options).evaluate(source, {"obj": {"name": "x"}, "xs": [{"name": "y"}]})
    assert e.value.code == code


def test_policy_exemptions(spark):
    e = Engine(allowed_properties=["name"])
    assert e.evaluate("xs[0].name", {"xs": [{"name": "y"}]}) == "y"
    assert e.evaluate("{a: secret}", {"secret": 1}) == {"a": 1.0}
    assert e.get_policy() == {"allowed_properties": ["name"]} and Engine().get_policy() == {}
    with pytest.raises(Exception, match="MAX_ARRAY_LENGTH"):
        Engine(max_array_length=2).evaluate("[...xs]", {"xs": [1, 2, 3]})


def test_cache():
    c, made = Cache(2), []
    for key in "aabca":
        c.get(key, lambda key=key: made.append(key) or key)
    assert made == ["a", "b", "c", "a"] and len(c) == 2
    assert Cache(0).get("x", lambda: 1) == 1
    assert suggest("uper", ["lower", "upper"]) == "upper" and suggest("x" * 65, ["x"]) is None and suggest("zzzz", ["a"]) is None


def test_references():
    r = references(parse("(a.b + f(c) |> g(d.e[x])) ?? {k: v, [m]: 1} in [.z]"))
    assert set(r.identifiers) >= {"a", "c", "d", "x", "k", "v", "m"} and r.transforms == ("g",) and r.functions == ("f",)
    assert "b" not in r.identifiers and "z" not in r.identifiers
    assert "k" not in references(parse("{k: v}"), keys=False).identifiers


def pushed(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("PushedFilters:") :]


@pytest.mark.parametrize(
    ("source", "want"),
    [("o_orderkey >= 100", "GreaterThanOrEqual(o_orderkey,100)"), ('o_orderstatus == "F"', "EqualNullSafe(o_orderstatus,F)"), ('o_orderstatus in ["F", "O"]', "In(o_orderstatus, [F,O])"), ('o_orderstatus.startsWith("F")', "StringStartsWith(o_orderstatus,F)"), ("o_totalprice > 5 && o_orderkey < 9", "LessThan(o_orderkey,9)"), ('!(o_orderstatus == "F")', "Not(EqualNullSafe(o_orderstatus,F))"), ("o_totalprice > 5.5", "GreaterThan(o_totalprice,5.5)")],
)
def test_predicates_reach_the_scan(spark, engine, source, want):
    df = engine.where(spark.read.parquet(f"{DATA}/orders.parquet"), source)
    assert want in pushed(df)


def test_columns_are_pruned_and_stay_in_the_jvm(spark, engine):
    df = engine.select(spark.read.parquet(f"{DATA}/lineitem.parquet"), {"x": "l_quantity * 2 |> round"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double>" in plan and "Python" not in plan and "Exchange" not in plan


def test_streaming(spark, engine, tmp_path):
    from exprloom.streaming import rules, write

    spark.range(10).withColumn("s", F.lit("ab")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, s string").parquet(str(tmp_path / "in"))
    out = rules(engine, stream, "id >= 5", {"double": "id * 2", "text": "s |> upper"})
    write(out, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["double"] for r in rows.collect()) == [10, 12, 14, 16, 18] and rows.first()["text"] == "AB"


def test_timeout(spark):
    e = Engine(timeout=200)
    slow = spark.range(0, 40_000_000_000, numPartitions=4).select(F.max(F.xxhash64("id")))
    with pytest.raises(SecurityError) as error:
        e.collect(slow)
    assert error.value.code == "TIMEOUT"


DEEP = {"brackets": "(" * 3000 + "1" + ")" * 3000, "nots": "!" * 5000 + "a", "members": "a" + ".b" * 5000, "sum": "a" + " + a" * 5000, "arrays": "[" * 3000 + "]" * 3000, "templates": "`${" * 3000 + "a" + "}`" * 3000, "choices": "a ? 1 : " * 3000 + "0"}


@pytest.mark.parametrize("name", DEEP)
def test_deep_input_is_refused(spark, name):
    e, source = Engine(), DEEP[name]
    found = e.validate(source)
    assert found.valid == (name in ("members", "sum"))
    if found.valid:
        assert found.references.identifiers == ("a",)
        with pytest.raises(SecurityError) as error:
            e.evaluate(source, {"a": 1})
        assert error.value.code == "MAX_DEPTH"
    else:
        assert "nested too deeply" in found.errors[0].message
        with pytest.raises(ExpressionError):
            e.evaluate(source, {"a": 1})


CONTEXT = {"user": {"name": "Alice", "age": 25, "address": {"city": "London", "zip": "1"}}, "items": [1, 2, 3], "users": [{"name": "Alice", "age": 25, "active": True}], "groups": [{"users": [{"name": "x"}]}]}


@pytest.mark.parametrize(
    ("source", "first"),
    [("user.", "age"), ("user.na", "name"), ("user.address.c", "city"), ("us", "user"), ("users.filter(.", "age"), ("users |> filter(.ac", "active"), ("user.name.toU", "toUpperCase"), ("groups.map(.users.filter(.", "name"), ("users.filter(.age > 1).map(.na", "name"), ("users[0].ac", "active"), ("`a ${user.na", "name"), ("user.name |> upper |> sp", "split"), ("items |> su", "sum"), ("no", "now"), ("not", "not in")],
)
def test_completion(spark, engine, source, first):
    assert create_autocomplete(engine, CONTEXT).complete(source)[0].label == first


def test_completion_guards(spark, engine):
    a = create_autocomplete(engine, CONTEXT)
    assert a.complete("'user.") == [] and a.complete("`user.") == [] and a.complete("nope.") == []
    assert "sum" not in [c.label for c in a.complete("user.name |> ")] and "upper" not in [c.label for c in a.complete("items |> ")]
    preview = {c.label: c.detail for c in a.complete("")}
    assert preview["items"] == "array(3)"
    method = next(c for c in a.complete("users.fil") if c.label == "filter")
    assert method.insert_text == "filter(.)" and method.cursor_offset == 7
    denied = create_autocomplete(Engine(denied_properties=["age"]), CONTEXT)
    assert [c.label for c in denied.complete("user.") if c.kind == "property"] == ["name", "address"]
    for junk in ["((((", "a.b.(", "|> |>", ". . .", "`${`${", "]}"]:
        for cursor in range(len(junk) + 1):
            a.complete(junk, cursor)
