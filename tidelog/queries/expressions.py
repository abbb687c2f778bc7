"""A query an operator of the expression language, with the SQL that should agree.

Each entry: table, key columns, and per result column the expression in the stream
language and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..lang.ast import DataType
from ..operators.core import quoted
from ..plans.compiler import Compiler

_T = lambda **kinds: {k: DataType(*v) if isinstance(v, tuple) else DataType(v) for k, v in kinds.items()}
#: Language types of the tables' columns.
TABLES = {
    "events": _T(event_id="bigint", ts="timestamp", user_id="bigint", event_type="text", value="double precision", props="json"),
    "lineitem": _T(l_orderkey="bigint", l_partkey="bigint", l_suppkey="bigint", l_linenumber="int", l_quantity="double precision", l_extendedprice="double precision", l_discount="double precision", l_tax="double precision", l_returnflag="text", l_linestatus="text", l_shipdate="timestamp"),
    "orders": _T(o_orderkey="bigint", o_custkey="bigint", o_orderstatus="text", o_totalprice="double precision", o_orderdate="timestamp", o_orderpriority="text"),
    "part": _T(p_partkey="bigint", p_name="text", p_brand="text", p_type="text", p_size="int", p_retailprice="double precision"),
    "customer": _T(c_custkey="bigint", c_name="text", c_nationkey="int", c_acctbal="double precision", c_mktsegment="text"),
    "nation": _T(n_nationkey="int", n_name="text", n_regionkey="int"),
}
EVENT, LINE, ORDER, PART, CUSTOMER, NATION = ("events", ("event_id",)), ("lineitem", ("l_orderkey", "l_linenumber")), ("orders", ("o_orderkey",)), ("part", ("p_partkey",)), ("customer", ("c_custkey",)), ("nation", ("n_nationkey",))
_SOME = "nullif(event_type, 'error')"
_FLAG = "(value > 50)"
_NULL_FLAG = f"({_SOME} = 'click')"
_SQL_CENTS = "CAST(round(l_extendedprice) AS BIGINT)"

SPECS: dict[str, tuple[tuple[str, tuple[str, ...]], dict[str, tuple[str, str]]]] = {
    # literals and references
    "lit_int": (NATION, {"v": ("1_000_000", "CAST(1000000 AS INTEGER)"), "big": ("9223372036854775807", "9223372036854775807")}),
    "lit_numeric": (NATION, {"v": ("(3.25 + .5 + 3. + 1e2)::double precision", "CAST(106.75 AS DOUBLE)")}),
    "lit_string": (NATION, {"v": ("'it''s '\n 'joined'", "'it''s joined'")}),
    "lit_bool_null": (NATION, {"t": ("true", "true"), "f": ("FALSE", "false"), "n": ("null::text", "CAST(NULL AS VARCHAR)")}),
    "col_ref": (NATION, {"v": ("n_name", "n_name"), "q": ('"n_regionkey"', "n_regionkey")}),
    # comparison and logic
    "cmp_eq": (EVENT, {"v": ("event_type = 'click'", "event_type = 'click'")}),
    "cmp_lt": (LINE, {"v": ("l_quantity < 25", "l_quantity < 25")}),
    "cmp_gt": (LINE, {"v": ("l_quantity > 25", "l_quantity > 25")}),
    "cmp_le": (LINE, {"v": ("l_discount <= 0.05::double precision", "l_discount <= CAST(0.05 AS DOUBLE)")}),
    "cmp_ge": (LINE, {"v": ("l_linenumber >= 3", "l_linenumber >= 3")}),
    "cmp_ne_angle": (EVENT, {"v": ("event_type <> 'click'", "event_type <> 'click'")}),
    "cmp_ne_bang": (LINE, {"v": ("l_linenumber != 1", "l_linenumber != 1")}),
    "logic_and": (EVENT, {"v": (f"{_NULL_FLAG} AND {_FLAG}", f"{_NULL_FLAG} AND {_FLAG}")}),
    "logic_or": (EVENT, {"v": (f"{_NULL_FLAG} OR {_FLAG}", f"{_NULL_FLAG} OR {_FLAG}")}),
    "logic_not": (EVENT, {"v": (f"NOT {_NULL_FLAG}", f"NOT {_NULL_FLAG}")}),
    "pred_between": (LINE, {"v": ("l_quantity BETWEEN 10 AND 20", "l_quantity BETWEEN 10 AND 20"), "n": ("l_linenumber NOT BETWEEN 2 AND 1 + 2", "l_linenumber NOT BETWEEN 2 AND 3")}),
    "pred_in": (CUSTOMER, {"v": ("c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_mktsegment IN ('BUILDING', 'MACHINERY')"), "n": ("c_nationkey NOT IN (1, 2, NULL)", "c_nationkey NOT IN (1, 2, NULL)")}),
    "pred_like": (PART, {"v": ("p_name LIKE '%a_e%'", "p_name LIKE '%a_e%'"), "n": ("p_brand NOT LIKE 'Brand\\#1%'", "p_brand NOT LIKE 'Brand#1%'")}),
    "pred_ilike": (PART, {"v": ("p_type ILIKE '%STEEL'", "p_type ILIKE '%STEEL'"), "n": ("p_name NOT ILIKE 'S%'", "p_name NOT ILIKE 'S%'")}),
    "pred_similar": (PART, {"v": ("p_brand SIMILAR TO 'Brand#(1|2)[0-9]'", "regexp_full_match(p_brand, 'Brand#(1|2)[0-9]')"), "n": ("p_type NOT SIMILAR TO '%(A|E)%'", "NOT regexp_matches(p_type, '(A|E)')")}),
    "pred_is_null": (EVENT, {"v": (f"{_SOME} IS NULL", f"{_SOME} IS NULL"), "n": (f"{_SOME} IS NOT NULL", f"{_SOME} IS NOT NULL")}),
    "pred_is_true": (EVENT, {"v": (f"{_NULL_FLAG} IS TRUE", f"{_NULL_FLAG} IS TRUE"), "n": (f"{_NULL_FLAG} IS NOT TRUE", f"{_NULL_FLAG} IS NOT TRUE")}),
    "pred_is_false": (EVENT, {"v": (f"{_NULL_FLAG} IS FALSE", f"{_NULL_FLAG} IS FALSE"), "n": (f"{_NULL_FLAG} IS NOT FALSE", f"{_NULL_FLAG} IS NOT FALSE")}),
    "pred_distinct_from": (EVENT, {"v": (f"{_SOME} IS DISTINCT FROM 'click'", f"{_SOME} IS DISTINCT FROM 'click'"), "n": (f"{_SOME} IS NOT DISTINCT FROM NULL", f"{_SOME} IS NOT DISTINCT FROM NULL")}),
    # arithmetic
    "arith_add": (LINE, {"v": ("l_partkey + l_linenumber", "l_partkey + l_linenumber"), "d": ("l_shipdate::date + l_linenumber", "CAST(l_shipdate AS DATE) + l_linenumber"), "i": ("l_shipdate + '1 month 2 days 03:00:00'::interval", "l_shipdate + INTERVAL '1 month' + INTERVAL '2 days' + INTERVAL '3 hours'")}),
    "arith_sub": (LINE, {"v": ("l_partkey - l_suppkey", "l_partkey - l_suppkey"), "d": ("l_shipdate::date - '1995-01-01'", "datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))")}),
    "arith_mul": (LINE, {"v": ("l_linenumber * l_quantity", "l_linenumber * l_quantity")}),
    "arith_div_int": (ORDER, {"v": ("(o_orderkey - 5000) / 7", "(o_orderkey - 5000) // 7")}),
    "arith_div": (LINE, {"v": ("l_extendedprice / l_quantity", "l_extendedprice / l_quantity")}),
    "arith_mod": (ORDER, {"v": ("(o_orderkey - 5000) % 7", "(o_orderkey - 5000) % 7")}),
    "arith_pow": (PART, {"v": ("p_size ^ 2", "CAST(p_size * p_size AS DOUBLE)"), "l": ("2 ^ 3 ^ 2", "CAST(64 AS DOUBLE)")}),
    "arith_neg": (CUSTOMER, {"v": ("-c_acctbal", "-c_acctbal"), "p": ("+c_nationkey", "c_nationkey"), "s": ("-2::int", "CAST(-2 AS INTEGER)")}),
    # text, bits and patterns
    "str_concat": (PART, {"v": ("p_brand || ' ' || p_size", "p_brand || ' ' || CAST(p_size AS VARCHAR)")}),
    "bit_and": (ORDER, {"v": ("o_orderkey & 255", "o_orderkey & 255")}),
    "bit_or": (ORDER, {"v": ("o_orderkey | 255", "o_orderkey | 255")}),
    "bit_xor": (ORDER, {"v": ("o_orderkey # 255", "xor(o_orderkey, 255)")}),
    "bit_shl": (PART, {"v": ("p_size << 3", "CAST(p_size * 8 AS INTEGER)")}),
    "bit_shr": (ORDER, {"v": ("o_orderkey >> 2", "o_orderkey >> 2")}),
    "bit_not": (PART, {"v": ("~p_size", "~p_size"), "p": ("~1 + 2", "CAST(-4 AS INTEGER)")}),
    "re_match": (PART, {"v": ("p_brand ~ '[[:digit:]]{2}$'", "regexp_matches(p_brand, '[0-9]{2}$')")}),
    "re_imatch": (PART, {"v": ("p_type ~* 'steel|TIN'", "regexp_matches(p_type, '(?i)steel|TIN')")}),
    "re_nmatch": (PART, {"v": ("p_name !~ '^[a-m]'", "NOT regexp_matches(p_name, '^[a-m]')")}),
    "re_nimatch": (PART, {"v": ("p_name !~* '^[A-M]'", "NOT regexp_matches(p_name, '(?i)^[A-M]')")}),
    # casts
    "cast_int": (LINE, {"v": ("(l_linenumber + 0.5)::int", "l_linenumber + 1"), "f": ("(l_linenumber + 0.5::double precision)::int", "CAST(round_even(l_linenumber + 0.5, 0) AS INTEGER)"), "t": ("' 42 '::int", "CAST(42 AS INTEGER)")}),
    "cast_decimal": (LINE, {"v": ("l_quantity::decimal(10,2)::double precision", "CAST(CAST(l_quantity AS DECIMAL(10,2)) AS DOUBLE)")}),
    "cast_text": (PART, {"v": ("p_size::text", "CAST(p_size AS VARCHAR)"), "s": ("p_brand::varchar(3)", "substr(p_brand, 1, 3)"), "c": ("p_size::char(4) || '.'", "CAST(p_size AS VARCHAR) || '.'")}),
    "cast_bool": (PART, {"v": ("'on'::boolean", "true"), "i": ("(p_size % 2)::boolean", "CAST(p_size % 2 AS BOOLEAN)")}),
    "cast_date": (ORDER, {"v": ("o_orderdate::date", "CAST(o_orderdate AS DATE)"), "l": ("'1996-02-29'::date", "DATE '1996-02-29'")}),
    "cast_ts": (ORDER, {"v": ("o_orderdate::date::timestamp", "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)"), "l": ("'1996-02-29 01:02:03'::timestamp", "TIMESTAMP '1996-02-29 01:02:03'")}),
    # JSON
    "json_get": (EVENT, {"v": ("props -> 'k'", "CAST(props -> 'k' AS VARCHAR)"), "m": ("props -> 'none'", "CAST(props -> 'none' AS VARCHAR)")}),
    "json_get_verbatim": (EVENT, {"v": ("('{\"a\":1.10,\"b\":{\"z\":' || event_id || ', \"y\":2}}') -> 'a'", "'1.10'"), "o": ("('{\"a\":1.10,\"b\":{\"z\":' || event_id || ', \"y\":2}}') -> 'b'", "'{\"z\":' || event_id || ', \"y\":2}'"), "t": ("('[1, {\"q\": ' || event_id || '.50}]') -> 1 ->> 'q'", "CAST(event_id AS VARCHAR) || '.50'")}),
    "json_get_text": (EVENT, {"v": ("props ->> 'k'", "props ->> 'k'"), "i": ("('[1,\"b\",' || event_id || ']') ->> 2", "CAST(event_id AS VARCHAR)")}),
    "json_path": (EVENT, {"v": ("('{\"a\":{\"b\":[0,' || props || ']}}') #> '{a,b,1,k}'", "CAST(props -> 'k' AS VARCHAR)")}),
    "json_path_text": (EVENT, {"v": ("('{\"a\":{\"b\":[\"x\",' || props || ']}}') #>> '{a,b,1,k}'", "props ->> 'k'"), "t": ("'{\"a\":[\"x\"]}' #>> '{a,0}'", "'x'"), "n": ("'{\"a\":[\"x\",\"y\"]}' #>> '{a,-1}'", "'y'")}),
    "json_contains": (EVENT, {"v": ("props @> '{\"k\": 7}'", "json_contains(props, '{\"k\": 7}')"), "a": ("'[1,2,3]' @> '[3,1]'", "true")}),
    "json_contained_by": (EVENT, {"v": ("'{\"k\": 7}' <@ props", "json_contains(props, '{\"k\": 7}')")}),
    # functions
    "fn_null": (EVENT, {"c": (f"coalesce({_SOME}, 'none')", f"coalesce({_SOME}, 'none')"), "n": (_SOME, _SOME), "g": ("greatest(event_id, user_id, NULL)", "greatest(event_id, user_id)"), "l": ("least(event_id, user_id)", "least(event_id, user_id)")}),
    "fn_string": (PART, {"a": ("lower(p_brand)", "lower(p_brand)"), "b": ("upper(p_name)", "upper(p_name)"), "c": ("length(p_name)", "CAST(length(p_name) AS INTEGER)"), "d": ("btrim('  x ') || ltrim('xxy', 'x') || rtrim('yxx', 'x')", "'xyy'"), "e": ("substr(p_name, 2, 3)", "substr(p_name, 2, 3)"), "f": ("replace(p_brand, 'Brand', 'B')", "replace(p_brand, 'Brand', 'B')"), "g": ("concat(p_brand, NULL, p_size)", "concat(p_brand, p_size)"), "h": ("strpos(p_brand, '#')", "CAST(strpos(p_brand, '#') AS INTEGER)"), "i": ("lpad(p_size::text, 5, '0')", "lpad(CAST(p_size AS VARCHAR), 5, '0')"), "j": ("rpad(p_size::text, 5)", "rpad(CAST(p_size AS VARCHAR), 5, ' ')"), "k": ("md5(p_name)", "md5(p_name)"), "m": ("starts_with(p_name, 's')", "starts_with(p_name, 's')"), "n": ("reverse(p_brand)", "reverse(p_brand)"), "o": ("repeat('ab', 2)", "'abab'"), "p": ("split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"), "q": ('"left"(p_name, 2) || "right"(p_name, 2)', "left(p_name, 2) || right(p_name, 2)")}),
    "fn_math": (CUSTOMER, {"a": ("abs(c_acctbal)", "abs(c_acctbal)"), "b": ("ceil(c_acctbal)::bigint", "CAST(ceil(c_acctbal) AS BIGINT)"), "c": ("floor(c_acctbal)::bigint", "CAST(floor(c_acctbal) AS BIGINT)"), "d": ("sqrt(c_custkey::double precision)", "sqrt(CAST(c_custkey AS DOUBLE))"), "e": ("sign(c_acctbal)", "CAST(sign(c_acctbal) AS DOUBLE)"), "f": ("mod(c_custkey, 7)", "c_custkey % 7"), "g": ("trunc(c_acctbal)::bigint", "CAST(trunc(c_acctbal) AS BIGINT)"), "h": ("power(c_nationkey, 2)", "CAST(c_nationkey * c_nationkey AS DOUBLE)"), "i": ("round(c_custkey / 3.0)::bigint", "CAST(round(c_custkey / 3.0) AS BIGINT)")}),
    "fn_date": (ORDER, {"a": ("date_trunc('month', o_orderdate)::date", "CAST(date_trunc('month', o_orderdate) AS DATE)"), "b": ("date_part('year', o_orderdate)", "CAST(date_part('year', o_orderdate) AS DOUBLE)"), "c": ("make_date(1996, 2, 29)", "DATE '1996-02-29'"), "d": ("to_timestamp(o_orderkey)::timestamp", "TIMESTAMP '1970-01-01' + to_seconds(o_orderkey)")}),
    "fn_round_float": (LINE, {"v": ("round(l_linenumber + 0.5::double precision)", "round_even(l_linenumber + CAST(0.5 AS DOUBLE), 0)"), "n": ("round(-(l_linenumber + 0.5::double precision))", "round_even(-(l_linenumber + CAST(0.5 AS DOUBLE)), 0)"), "d": ("round(l_linenumber + 0.5)::bigint", "CAST(l_linenumber + 1 AS BIGINT)")}),
    "fn_date_fields": (ORDER, {f: (f"date_part('{f}', o_orderdate)", f"CAST(date_part('{f}', o_orderdate) AS DOUBLE)") for f in ("month", "day", "hour", "minute", "dow", "isodow", "doy", "week", "isoyear", "quarter", "decade", "century", "millennium", "epoch")}),
    "fn_json": (EVENT, {"a": ("jsonb_typeof(props)", "'object'"), "b": ("jsonb_array_length('[1,2,3]')", "CAST(3 AS INTEGER)")}),
}


def _query(name: str):
    (table, keys), outputs = SPECS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        compiler = Compiler(TABLES[table])
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return df.select(*[quoted(k) for k in keys], *[compiler.column(e).alias(a) for a, (e, _) in outputs.items()])

    return run


def queries() -> dict:
    return {name: _query(name) for name in SPECS}


def oracle_sql() -> dict[str, str]:
    return {name: f"SELECT {', '.join(keys)}, {', '.join(f'{sql} AS {alias}' for alias, (_, sql) in outputs.items())} FROM {table}" for name, ((table, keys), outputs) in SPECS.items()}
