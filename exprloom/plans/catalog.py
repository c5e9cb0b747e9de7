"""The engine's queries over the driver's tables, each with the SQL that DuckDB should agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..engine import Engine
from ..functions.stdlib import everything
from ..sources import nested, scratch, table, with_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def engine() -> Engine:
    return Engine().use(everything)


def over(name: str, source: str, columns: dict[str, str], sql: str, where: str | None = None, prepare: Callable | None = None) -> None:
    """Register expressions over a table, filtered by one, next to the SQL for the same."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, df = engine(), table(spark, sf_dir, source)
        if prepare:
            df = prepare(spark, sf_dir, df)
        if where:
            df = e.where(df, where)
        return e.select(df, columns)

    QUERIES[name], ORACLES[name] = run, sql


def _orders(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    """Customers with their orders as an array, and each customer's own columns."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return nested(customers, orders, "c_custkey", "o_custkey", "orders")


def _regions(spark: SparkSession, sf_dir: str, regions: DataFrame) -> DataFrame:
    """Regions with nations with customers."""
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    nations = nested(table(spark, sf_dir, "nation"), customers, "n_nationkey", "c_nationkey", "customers")
    return nested(regions, nations.select("n_regionkey", "n_nationkey", "n_name", "customers"), "r_regionkey", "n_regionkey", "nations")


def _with_status(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left")


def _dated(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"])


# Operators.
over("filter_logic", "lineitem", {"key": "l_orderkey", "line": "l_linenumber", "revenue": "l_extendedprice * (1 - l_discount)"},
     "SELECT l_orderkey AS key, l_linenumber AS line, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'R'",
     where='l_quantity >= 30 && l_returnflag == "R"')
over("filter_or_not", "orders", {"key": "o_orderkey"},
     "SELECT o_orderkey AS key FROM orders WHERE (o_totalprice < 50000 OR o_orderpriority = '1-URGENT') AND NOT (o_orderstatus = 'F') AND o_orderkey <> 7",
     where='(o_totalprice < 50000 || o_orderpriority == "1-URGENT") && !(o_orderstatus == "F") && o_orderkey != 7')
over("project_arith", "lineitem", {"key": "l_orderkey", "line": "l_linenumber", "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "diff": "l_quantity - 10", "neg": "-l_tax"},
     "SELECT l_orderkey AS key, l_linenumber AS line, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity - 10 AS diff, -l_tax AS neg FROM lineitem")
over("modulo_power", "part", {"key": "p_partkey", "rest": "p_size % 7", "negrest": "-p_size % 7 + 0", "square": "p_size ** 2", "root": "p_size ** 0.5"},
     "SELECT p_partkey AS key, (p_size % 7)::DOUBLE AS rest, (-p_size % 7)::DOUBLE AS negrest, pow(p_size, 2) AS square, pow(p_size, 0.5) AS root FROM part")
over("div_guard", "lineitem", {"key": "l_orderkey", "line": "l_linenumber", "zero": "l_discount == 0", "endless": "l_tax / l_discount == 1 / 0", "bounded": "l_tax / l_discount < 1e9"},
     "SELECT l_orderkey AS key, l_linenumber AS line, l_discount = 0 AS zero, l_discount = 0 AND l_tax > 0 AS endless, l_discount <> 0 AS bounded FROM lineitem")
over("ternary", "lineitem", {"key": "l_orderkey", "line": "l_linenumber", "size": 'l_quantity > 25 ? "bulk" : l_quantity > 10 ? "medium" : "small"'},
     "SELECT l_orderkey AS key, l_linenumber AS line, CASE WHEN l_quantity > 25 THEN 'bulk' WHEN l_quantity > 10 THEN 'medium' ELSE 'small' END AS size FROM lineitem")
over("nullish", "customer", {"key": "c_custkey", "okey": "o_orderkey ?? -1", "status": 'o_orderstatus ?? "none"', "segment": "no_such_column ?? c_mktsegment", "any": "o_orderstatus || c_name"},
     "SELECT c_custkey AS key, coalesce(o_orderkey, -1)::DOUBLE AS okey, coalesce(o_orderstatus, 'none') AS status, c_mktsegment AS segment, coalesce(o_orderstatus, c_name) AS any FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
     prepare=_with_status)
over("null_compare", "customer", {"key": "c_custkey", "open": 'o_orderstatus == "O"', "unlike": 'o_orderstatus != "O"', "isnull": "o_orderstatus == null", "above": "o_orderkey >= 0", "truth": "!o_orderstatus"},
     "SELECT c_custkey AS key, coalesce(o_orderstatus = 'O', false) AS open, o_orderstatus IS DISTINCT FROM 'O' AS unlike, o_orderstatus IS NULL AS isnull, coalesce(o_orderkey >= 0, false) AS above, o_orderstatus IS NULL AS truth FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
     prepare=_with_status)
over("strict_eq", "events", {"id": "event_id", "same": 'event_id == "1"', "differs": 'event_id != "1"', "one": "event_id == 1"},
     "SELECT event_id AS id, false AS same, true AS differs, event_id = 1 AS one FROM events")
over("in_list", "orders", {"key": "o_orderkey"}, "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus IN ('F', 'O')", where='o_orderstatus in ["F", "O"]')
over("not_in_list", "orders", {"key": "o_orderkey"}, "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (1, 2, 3) AND o_orderstatus NOT IN ('P')", where='o_orderkey not in [1, 2, 3] && o_orderstatus not in ["P"]')
over("in_string", "part", {"key": "p_partkey", "isin": '"widget" in p_name', "notin": '"widget" not in p_name'},
     "SELECT p_partkey AS key, contains(p_name, 'widget') AS isin, NOT contains(p_name, 'widget') AS notin FROM part")
over("unary_number", "orders", {"key": "o_orderkey", "num": "+(o_orderpriority.slice(0, 1))", "bad": "+o_orderstatus > 0", "flag": "+(o_orderkey > 5)"},
     "SELECT o_orderkey AS key, left(o_orderpriority, 1)::DOUBLE AS num, false AS bad, (o_orderkey > 5)::INT::DOUBLE AS flag FROM orders")
over("logic_values", "part", {"key": "p_partkey", "both": '(p_size > 10 ? p_name : "") || p_brand', "either": "p_size % 2 == 0 && p_size > 20 || p_size < 5"},
     "SELECT p_partkey AS key, CASE WHEN p_size > 10 THEN p_name ELSE p_brand END AS both, (p_size % 2 = 0 AND p_size > 20) OR p_size < 5 AS either FROM part")

# Strings.
over("template", "part", {"key": "p_partkey", "label": "`${p_brand}: ${p_name} (${p_size})`"}, "SELECT p_partkey AS key, p_brand || ': ' || p_name || ' (' || p_size || ')' AS label FROM part")
over("str_concat", "nation", {"key": "n_nationkey", "a": 'n_name + "/" + n_regionkey', "b": 'n_name.concat("-", n_nationkey)'}, "SELECT n_nationkey AS key, n_name || '/' || n_regionkey AS a, n_name || '-' || n_nationkey AS b FROM nation")
over("str_case", "customer", {"key": "c_custkey", "up": "c_name |> upper", "low": "c_name.toLowerCase()", "trimmed": '`  ${c_name} ` |> trim', "start": '("  " + c_name).trimStart()', "end": '(c_name + "  ").trimEnd()'},
     "SELECT c_custkey AS key, upper(c_name) AS up, lower(c_name) AS low, c_name AS trimmed, c_name AS start, c_name AS end FROM customer")
over("str_pad", "nation", {"key": "n_nationkey", "a": 'n_name.padStart(12, "*")', "b": 'n_name |> padEnd(9, "-+")', "c": "n_name.repeat(2)"},
     "SELECT n_nationkey AS key, CASE WHEN length(n_name) < 12 THEN lpad(n_name, 12, '*') ELSE n_name END AS a, CASE WHEN length(n_name) < 9 THEN rpad(n_name, 9, '-+') ELSE n_name END AS b, n_name || n_name AS c FROM nation")
over("str_replace", "part", {"key": "p_partkey", "one": 'p_brand |> replace("#", "-")', "all": 'p_name.replaceAll("e", "[$&]")', "first": 'p_name.replace("e", "E")'},
     "SELECT p_partkey AS key, CASE WHEN strpos(p_brand, '#') > 0 THEN left(p_brand, strpos(p_brand, '#') - 1) || '-' || substr(p_brand, strpos(p_brand, '#') + 1) ELSE p_brand END AS one, replace(p_name, 'e', '[e]') AS all, CASE WHEN strpos(p_name, 'e') > 0 THEN left(p_name, strpos(p_name, 'e') - 1) || 'E' || substr(p_name, strpos(p_name, 'e') + 1) ELSE p_name END AS first FROM part")
over("str_split", "part", {"key": "p_partkey", "head": '(p_name |> split(" ") |> first)', "tail": 'p_name.split(" ").at(-1)', "n": 'p_name.split(" ").length', "chars": 'p_brand.split("").length'},
     "SELECT p_partkey AS key, string_split(p_name, ' ')[1] AS head, string_split(p_name, ' ')[-1] AS tail, len(string_split(p_name, ' '))::INT AS n, length(p_brand)::INT AS chars FROM part")
over("str_slice", "customer", {"key": "c_custkey", "last": "c_name.slice(-4)", "mid": "c_name.substring(6, 2)", "at": "c_name.at(-1)", "char": "c_name.charAt(2)", "code": "c_name.charCodeAt(0)", "third": "c_name[2]", "size": "c_name.length"},
     "SELECT c_custkey AS key, right(c_name, 4) AS last, substr(c_name, 3, 4) AS mid, right(c_name, 1) AS at, substr(c_name, 3, 1) AS char, ascii(c_name)::DOUBLE AS code, substr(c_name, 3, 1) AS third, length(c_name)::INT AS size FROM customer")
over("str_find", "customer", {"key": "c_custkey", "first": 'c_name.indexOf("0")', "last": 'c_name.lastIndexOf("0")', "none": 'c_name.indexOf("~")', "has": 'c_name.includes("01")', "begins": 'c_name |> startsWith("C")', "ends": 'c_name.endsWith("1")', "later": 'c_name.startsWith("u", 1)'},
     "SELECT c_custkey AS key, (strpos(c_name, '0') - 1)::INT AS first, CASE WHEN strpos(reverse(c_name), '0') = 0 THEN -1 ELSE length(c_name) - strpos(reverse(c_name), '0') END::INT AS last, -1 AS none, contains(c_name, '01') AS has, starts_with(c_name, 'C') AS begins, ends_with(c_name, '1') AS ends, substr(c_name, 2, 1) = 'u' AS later FROM customer")

# Numbers, types, dates.
over("math_round", "supplier", {"key": "s_suppkey", "r": "s_acctbal |> round", "f": "s_acctbal |> floor", "c": "s_acctbal |> ceil", "a": "s_acctbal |> abs", "held": "s_acctbal |> round |> clamp(0, 5000)"},
     "SELECT s_suppkey AS key, floor(s_acctbal + 0.5) AS r, floor(s_acctbal) AS f, ceil(s_acctbal) AS c, abs(s_acctbal) AS a, least(greatest(floor(s_acctbal + 0.5), 0), 5000)::DOUBLE AS held FROM supplier")
over("math_minmax", "supplier", {"key": "s_suppkey", "low": "min(s_acctbal, 100, s_suppkey)", "high": "max(s_acctbal, 100)", "none": "min() == 1 / 0"},
     "SELECT s_suppkey AS key, least(s_acctbal, 100, s_suppkey)::DOUBLE AS low, greatest(s_acctbal, 100)::DOUBLE AS high, true AS none FROM supplier")
over("num_text", "part", {"key": "p_partkey", "fixed": "p_size.toFixed(2)", "hex": "p_size.toString(16)", "text": "p_size |> toString", "half": "(p_size / 2) |> toString"},
     "SELECT p_partkey AS key, printf('%.2f', p_size::DOUBLE) AS fixed, lower(to_hex(p_size)) AS hex, p_size::VARCHAR AS text, CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size // 2)::VARCHAR || '.5' END AS half FROM part")
over("type_tests", "part", {"key": "p_partkey", "s": "p_name |> isString", "n": "p_size |> isNumber", "a": "p_name |> isArray", "z": "null |> isNull", "b": "p_size |> toBool", "num": '"0x1F" |> toNumber', "t": "(p_size > 3) |> toString"},
     "SELECT p_partkey AS key, true AS s, true AS n, false AS a, true AS z, p_size <> 0 AS b, 31.0::DOUBLE AS num, CASE WHEN p_size > 3 THEN 'true' ELSE 'false' END AS t FROM part")
over("date_format", "orders", {"key": "o_orderkey", "day": 'o_orderdate |> formatDate("YYYY-MM-DD")', "time": 'o_orderdate |> formatDate("HH:mm:ss on DD.MM.YYYY")', "ms": "o_orderdate + 0"},
     "SELECT o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%H:%M:%S on %d.%m.%Y') AS time, epoch_ms(o_orderdate::TIMESTAMP)::DOUBLE AS ms FROM orders")
over("date_diff", "lineitem", {"key": "l_orderkey", "line": "l_linenumber", "days": "l_shipdate |> diffDays(o_orderdate)", "late": "l_shipdate > o_orderdate"},
     "SELECT l_orderkey AS key, l_linenumber AS line, abs(floor((epoch_ms(l_shipdate::TIMESTAMP) - epoch_ms(o_orderdate::TIMESTAMP)) / 86400000.0 + 0.5)) AS days, l_shipdate > o_orderdate AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
     prepare=_dated)

# Arrays and lambdas.
_GROUPED = "FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"
over("arr_folds", "customer", {"key": "c_custkey", "n": "orders |> count", "total": "orders |> map(.o_totalprice) |> sum |> round", "mean": "orders |> map(.o_totalprice) |> avg |> round", "first": "(orders |> first)?.o_orderkey", "last": "(orders |> last)?.o_orderkey"},
     f"SELECT c_custkey AS key, count(o_orderkey)::INT AS n, floor(coalesce(sum(o_totalprice), 0) + 0.5) AS total, floor(coalesce(avg(o_totalprice), 0) + 0.5) AS mean, min(o_orderkey) AS first, max(o_orderkey) AS last {_GROUPED}",
     prepare=_orders)
over("arr_filter_map", "customer", {"key": "c_custkey", "big": 'orders |> filter(.o_totalprice > 100000) |> map(.o_orderkey) |> join(",")', "n": "orders.filter(.o_totalprice > 100000 && .o_orderstatus != \"F\").length"},
     f"SELECT c_custkey AS key, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (WHERE o_totalprice > 100000), '') AS big, (count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'))::INT AS n {_GROUPED}",
     prepare=_orders)
over("arr_some_every", "customer", {"key": "c_custkey", "some": 'orders.some(.o_orderstatus == "F")', "every": "orders |> every(.o_totalprice > 20000)", "found": "orders.find(.o_totalprice > 200000)?.o_orderkey ?? -1", "at": "orders.findIndex(.o_totalprice > 200000)"},
     "SELECT c_custkey AS key, coalesce(bool_or(o_orderstatus = 'F'), false) AS some, coalesce(bool_and(o_totalprice > 20000), true) AS every, coalesce(min(o_orderkey) FILTER (WHERE o_totalprice > 200000), -1)::DOUBLE AS found, coalesce(min(rn) FILTER (WHERE o_totalprice > 200000), 0)::INT - 1 AS at FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) ON c_custkey = o_custkey GROUP BY c_custkey",
     prepare=_orders)
over("arr_unique_sort_join", "customer", {"key": "c_custkey", "kinds": 'orders |> map(.o_orderpriority) |> unique |> sort |> join(", ")', "back": 'orders.map(.o_orderstatus).toReversed().join("")', "texts": 'orders.map(.o_orderkey).toSorted().join(" ")'},
     f"SELECT c_custkey AS key, coalesce(string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority), '') AS kinds, coalesce(string_agg(o_orderstatus, '' ORDER BY o_orderkey DESC), '') AS back, coalesce(string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey::VARCHAR), '') AS texts {_GROUPED}",
     prepare=_orders)
over("arr_slice_at", "embeddings", {"id": "vec_id", "two": "embedding.slice(1, 3).length", "last": "embedding.at(-1)", "second": "embedding[1]", "none": "embedding[100000] == null", "size": "embedding.length", "cut": "embedding.toSpliced(0, 2).length", "put": "embedding.with(0, 9).at(0)"},
     "SELECT vec_id AS id, 2 AS two, embedding[-1] AS last, embedding[2] AS second, true AS none, len(embedding)::INT AS size, len(embedding)::INT - 2 AS cut, 9.0::DOUBLE AS put FROM embeddings")
over("arr_search", "customer", {"key": "c_custkey", "has": 'orders.map(.o_orderstatus).includes("P")', "first": 'orders.map(.o_orderstatus).indexOf("O")', "last": 'orders.map(.o_orderstatus).lastIndexOf("O")', "isin": '"F" in orders.map(.o_orderstatus)'},
     "SELECT c_custkey AS key, coalesce(bool_or(o_orderstatus = 'P'), false) AS has, coalesce(min(rn) FILTER (WHERE o_orderstatus = 'O'), 0)::INT - 1 AS first, coalesce(max(rn) FILTER (WHERE o_orderstatus = 'O'), 0)::INT - 1 AS last, coalesce(bool_or(o_orderstatus = 'F'), false) AS isin FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) ON c_custkey = o_custkey GROUP BY c_custkey",
     prepare=_orders)
over("arr_spread", "part", {"key": "p_partkey", "all": '[p_brand, ...p_name.split(" "), "end"].join("|")', "n": '[...p_name.split(" "), ...["a", "b"]] |> count', "joined": 'p_name.split(" ").concat(["x"], "y").join("")'},
     "SELECT p_partkey AS key, p_brand || '|' || replace(p_name, ' ', '|') || '|end' AS all, len(string_split(p_name, ' '))::INT + 2 AS n, replace(p_name, ' ', '') || 'xy' AS joined FROM part")
over("lambda_forms", "customer", {"key": "c_custkey", "tags": 'orders.map(.o_totalprice > 150000 ? "hi" : .o_orderstatus).join(",")', "scaled": "orders.map(.o_totalprice / c_custkey).filter(. > 1000).length", "texts": 'orders.map(.o_orderpriority.slice(0, 1)).join("")'},
     f"SELECT c_custkey AS key, coalesce(string_agg(CASE WHEN o_totalprice > 150000 THEN 'hi' ELSE o_orderstatus END, ',' ORDER BY o_orderkey), '') AS tags, (count(*) FILTER (WHERE o_totalprice / c_custkey > 1000))::INT AS scaled, coalesce(string_agg(left(o_orderpriority, 1), '' ORDER BY o_orderkey), '') AS texts {_GROUPED}",
     prepare=_orders)
over("nested_lambda", "region", {"key": "r_regionkey", "rich": 'nations.map(.customers.filter(.c_acctbal > 0).length).join(",")', "any": "nations.some(.customers.some(.c_acctbal > 9000))", "flat": "nations.flatMap(.customers).length", "names": 'nations |> map(.n_name) |> join("/")'},
     "WITH n AS (SELECT n_regionkey, n_nationkey, n_name, (count(c_custkey) FILTER (WHERE c_acctbal > 0)) AS rich, count(c_custkey) AS total, coalesce(bool_or(c_acctbal > 9000), false) AS top FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) SELECT r_regionkey AS key, string_agg(rich::VARCHAR, ',' ORDER BY n_nationkey) AS rich, bool_or(top) AS any, sum(total)::INT AS flat, string_agg(n_name, '/' ORDER BY n_nationkey) AS names FROM region JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey",
     prepare=_regions)

# Twins of methods and transforms, spreads, and forms of literals.
over("number_forms", "nation", {"key": "n_nationkey", "hex": "n_nationkey + 0xFF", "bin": "n_nationkey * 0b101", "oct": "0o17 - n_nationkey", "long": "n_nationkey + 1_000_000", "small": "n_nationkey + 25e-2"},
     "SELECT n_nationkey AS key, n_nationkey + 255.0::DOUBLE AS hex, n_nationkey * 5.0::DOUBLE AS bin, 15.0::DOUBLE - n_nationkey AS oct, n_nationkey + 1000000.0::DOUBLE AS long, n_nationkey + 0.25::DOUBLE AS small FROM nation")
over("string_escapes", "region", {"key": "r_regionkey", "tab": r'r_name + "\t\x41\u00e9\u{1F600}"', "quote": r"""'it\'s ' + r_name""", "nested": "`${`<${r_name}>`}${'}'.length}`"},
     "SELECT r_regionkey AS key, r_name || chr(9) || 'Aé😀' AS tab, 'it''s ' || r_name AS quote, '<' || r_name || '>1' AS nested FROM region")
over("optional_calls", "customer", {"key": "c_custkey", "low": 'o_orderstatus?.toLowerCase() ?? "none"', "cut": 'no_such_column?.slice(1) ?? c_name', "size": "o_orderstatus?.length ?? 0", "chain": "no_such_column?.a?.b(1)?.c == undefined"},
     "SELECT c_custkey AS key, coalesce(lower(o_orderstatus), 'none') AS low, c_name AS cut, coalesce(length(o_orderstatus), 0)::DOUBLE AS size, true AS chain FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
     prepare=_with_status)
over("call_spread", "part", {"key": "p_partkey", "most": "max(...[p_size, 10, 3])", "least": "min(p_size, ...[20, p_retailprice])", "text": 'p_brand.concat(...["-", p_name])', "chars": "[...p_brand].length", "letters": '[..."abc", p_brand].join("")'},
     "SELECT p_partkey AS key, greatest(p_size, 10)::DOUBLE AS most, least(p_size, 20, p_retailprice)::DOUBLE AS least, p_brand || '-' || p_name AS text, length(p_brand)::INT AS chars, 'abc' || p_brand AS letters FROM part")
over("string_methods", "customer", {"key": "c_custkey", "bare": '("  " + c_name + "\\t").trim()', "up": "c_name.toUpperCase()", "wide": 'c_name.padEnd(24, "ab")', "text": "c_name.toString()", "number": "c_custkey.toString()"},
     "SELECT c_custkey AS key, c_name AS bare, upper(c_name) AS up, rpad(c_name, 24, 'ab') AS wide, c_name AS text, c_custkey::VARCHAR AS number FROM customer")
over("string_transforms", "part", {"key": "p_partkey", "low": "p_name |> lower", "all": 'p_name |> replaceAll("e", "<$&>")', "ends": 'p_name |> endsWith("t")', "has": 'p_name |> includes("ge")', "left": 'p_brand |> padStart(10, "#.")'},
     "SELECT p_partkey AS key, lower(p_name) AS low, replace(p_name, 'e', '<e>') AS all, ends_with(p_name, 't') AS ends, contains(p_name, 'ge') AS has, CASE WHEN length(p_brand) < 10 THEN lpad(p_brand, 10, '#.') ELSE p_brand END AS left FROM part")
over("replace_around", "part", {"key": "p_partkey", "around": "p_name.replaceAll(' ', \"[$`|$']\")", "once": "p_name.replace(' ', \"[$`|$']\")", "parts": 'p_name.split(" ", -1).length', "none": 'p_name.split(" ", 0).length'},
     """WITH p AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey AS key, array_to_string([w[i] || CASE WHEN i < len(w) THEN '[' || array_to_string(w[1:i], ' ') || '|' || array_to_string(w[i + 1:], ' ') || ']' ELSE '' END FOR i IN range(1, len(w) + 1)], '') AS around,
       CASE WHEN len(w) > 1 THEN w[1] || '[' || w[1] || '|' || array_to_string(w[2:], ' ') || ']' || array_to_string(w[2:], ' ') ELSE p_name END AS once, len(w)::INT AS parts, 0 AS none FROM p""")  # fmt: skip
over("array_methods", "customer", {"key": "c_custkey", "every": "orders.every(.o_totalprice > 20000)", "flat": "[orders.map(.o_orderkey), [1]].flat().length", "deep": "[[orders.map(.o_orderkey)]].flat(2).length", "back": 'orders.map(.o_orderkey).toReversed().slice(0, 2).join(",")'},
     f"SELECT c_custkey AS key, coalesce(bool_and(o_totalprice > 20000), true) AS every, count(o_orderkey)::INT + 1 AS flat, count(o_orderkey)::INT AS deep, coalesce(array_to_string(list(o_orderkey ORDER BY o_orderkey DESC) FILTER (WHERE o_orderkey IS NOT NULL)[1:2], ','), '') AS back {_GROUPED}",
     prepare=_orders)
over("array_transforms", "customer", {"key": "c_custkey", "last": "(orders |> reverse |> first)?.o_orderkey", "flat": "[orders.map(.o_orderkey), [1]] |> flatten |> count", "found": "(orders |> find(.o_totalprice > 200000))?.o_orderkey ?? -1", "some": 'orders |> some(.o_orderstatus == "P")', "kept": "orders |> filter |> count", "same": 'orders |> map(.o_orderkey) |> map |> join("+")'},
     f"SELECT c_custkey AS key, max(o_orderkey) AS last, count(o_orderkey)::INT + 1 AS flat, coalesce(min(o_orderkey) FILTER (WHERE o_totalprice > 200000), -1)::DOUBLE AS found, coalesce(bool_or(o_orderstatus = 'P'), false) AS some, count(o_orderkey)::INT AS kept, coalesce(string_agg(o_orderkey::VARCHAR, '+' ORDER BY o_orderkey), '') AS same {_GROUPED}",
     prepare=_orders)
over("clock", "nation", {"key": "n_nationkey", "late": "now() > 1500000000000", "days": "now() |> diffDays(now() + 86400000 * n_nationkey)"},
     "SELECT n_nationkey AS key, true AS late, n_nationkey::DOUBLE AS days FROM nation")


def _mixed(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Events whose JSON holds a number, a text that looks like one, a truth, a list or nothing, in turn."""
    texts = F.array(*[F.lit(x) for x in ('{"v": %s}', '{"v": "%s"}', '{"v": true}', '{"v": [%s, "%s"]}', '{"v": null}', '{"v": "false"}', '{"v": 0}')])
    shape = F.get(texts, F.pmod("event_id", F.lit(7)).cast("int"))
    return events.withColumn("props", F.parse_json(F.replace(shape, F.lit("%s"), F.col("event_id").cast("string"))))


over("variant_strict", "events", {"id": "event_id", "same": "props.v == event_id", "text": 'props.v == event_id.toString()', "truth": "!!props.v", "sum": '(props.v + 1) |> toString', "none": "props.v == null", "size": "props.v.length ?? -1", "has": "(props.v |> isArray) && event_id in props.v", "number": "props.v |> isNumber", "label": "`<${props.v}>`"},
     """SELECT event_id AS id, event_id % 7 = 0 OR (event_id % 7 = 6 AND event_id = 0) AS same, event_id % 7 = 1 AS text, event_id % 7 IN (1, 2, 3, 5) OR (event_id % 7 = 0 AND event_id <> 0) AS truth,
       CASE event_id % 7 WHEN 0 THEN (event_id + 1)::VARCHAR WHEN 1 THEN event_id || '1' WHEN 2 THEN '2' WHEN 3 THEN event_id || ',' || event_id || '1' WHEN 4 THEN 'null' WHEN 5 THEN 'false1' ELSE '1' END AS sum,
       event_id % 7 = 4 AS none, CASE event_id % 7 WHEN 1 THEN length(event_id::VARCHAR) WHEN 3 THEN 2 WHEN 5 THEN 5 ELSE -1 END::DOUBLE AS size, event_id % 7 = 3 AS has, event_id % 7 IN (0, 6) AS number,
       '<' || CASE event_id % 7 WHEN 2 THEN 'true' WHEN 3 THEN event_id || ',' || event_id WHEN 4 THEN 'null' WHEN 5 THEN 'false' WHEN 6 THEN '0' ELSE event_id::VARCHAR END || '>' AS label FROM events""",
     prepare=_mixed)

# Constructors, JSON, and rules over text.
over("object_literal", "nation", {"id": "{ id: n_nationkey, name: n_name }.id", "name": '{ "id": n_nationkey, name: n_name }["name"]', "short": "{ n_name }.n_name", "computed": "{ [n_name]: n_nationkey }[n_name]"},
     "SELECT n_nationkey AS id, n_name AS name, n_name AS short, n_nationkey AS computed FROM nation")
over("json_variant", "events", {"id": "event_id", "high": "props.k >= 50", "k": "+props.k", "none": "props.missing?.deep == null"},
     "SELECT event_id AS id, (props->>'$.k')::DOUBLE >= 50 AS high, (props->>'$.k')::DOUBLE AS k, true AS none FROM events",
     prepare=lambda spark, sf_dir, df: with_json(df, "props"))
over("text_rules", "documents", {"id": "doc_id"}, "SELECT doc_id AS id FROM documents WHERE n_chars > 1000 AND lang = 'en' AND NOT contains(text, 'http')", where='n_chars > 1000 && lang == "en" && !text.includes("http")')
over("conv_roles", "conversations", {"conv": "conv_id", "turn": "turn", "size": 'role == "user" ? text.length : 0'}, "SELECT conv_id AS conv, turn, CASE WHEN role = 'user' THEN length(text) ELSE 0 END::DOUBLE AS size FROM conversations")


def rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions as grouping key and measure of a distributed aggregation."""
    e, df = engine(), table(spark, sf_dir, "lineitem")
    rows = e.select(e.where(df, "l_discount > 0.02"), {"flag": "`${l_returnflag}-${l_linestatus}`", "units": "l_quantity > 25 ? 1 : 0"})
    return rows.groupBy("flag").agg(F.sum("units").alias("bulk"), F.count("*").alias("n"))


QUERIES["rule_totals"] = rule_totals
ORACLES["rule_totals"] = "SELECT l_returnflag || '-' || l_linestatus AS flag, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::DOUBLE AS bulk, count(*) AS n FROM lineitem WHERE l_discount > 0.02 GROUP BY 1"


def host_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python code of the host: plain, asynchronous and vectorised, also inside a lambda."""

    async def later(x):
        return x + 1

    e = engine().add_transform("shout", lambda s: s + "!", returns="string").add_transform("next", later, returns="double").add_transform("half", lambda s: s / 2, returns="double", vectorized=True).add_function("rate", lambda x: x * 10, returns="double")
    return e.select(table(spark, sf_dir, "nation"), {"key": "n_nationkey", "loud": "n_name |> shout", "next": "n_nationkey |> next", "half": "n_nationkey |> half", "rated": '[1, 2].map(. + rate(n_regionkey)).join(",")'})


QUERIES["host_code"] = host_code
ORACLES["host_code"] = "SELECT n_nationkey AS key, n_name || '!' AS loud, n_nationkey + 1.0::DOUBLE AS next, n_nationkey / 2.0::DOUBLE AS half, (n_regionkey * 10 + 1) || ',' || (n_regionkey * 10 + 2) AS rated FROM nation"


def stream_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule over a stream of the events file, appended to Parquet and read back."""
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/*.parquet")
    out = streaming.rules(engine(), stream, 'event_type == "click" && value > 10', {"id": "event_id", "kind": "event_type |> upper", "double": "value * 2"})
    streaming.write(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


QUERIES["stream_rules"] = stream_rules
ORACLES["stream_rules"] = "SELECT event_id AS id, upper(event_type) AS kind, value * 2 AS double FROM events WHERE event_type = 'click' AND value > 10"
