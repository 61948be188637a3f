"""The catalogue of engine queries over the driver tables, each with the SQL that gives the same rows.

Nested results are flattened, so that SQL can say the same: structs to ``parent__field``, arrays to one row per element.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presetlake.engine import Engine
from presetlake.importers.catalog import from_tables
from presetlake.sources import logs
from presetlake.sources.catalog import Catalog
from presetlake.sources.locale import Locale
from presetlake.sources.scratch import own_path
from presetlake.spec.loader import Registry

_I, _S, _N = "int", "string", "float"


def _f(source: str, type: str = _S, **more) -> dict:
    return {"source": source, "type": type, **more}


def _rel(source: str, preset: str, **more) -> dict:
    return {"source": source, "type": "preset", "preset": preset, **more}


def _fmt(template: str, alias: str, **more) -> dict:
    return {"source": template, "type": "formatter", "alias": alias, **more}


def _to(model: str, fk: str, pk: str, **more) -> dict:
    return {"type": "belongs_to", "model": model, "fk": fk, "pk": pk, **more}


def _many(model: str, fk: str, pk: str, **more) -> dict:
    return {"type": "has_many", "model": model, "fk": fk, "pk": pk, **more}


_ORDER_ID = [_f("o_orderkey", _I)]
MODELS: dict[str, dict] = {
    "Region": {"table": "region", "primary_keys": "r_regionkey", "presets": {"item": {"fields": [_f("r_regionkey", _I), _f("r_name")]}, "spare": {"fields": [_f("r_nothing")]}}},
    "Nation": {
        "table": "nation",
        "primary_keys": "n_nationkey",
        "relations": {"region": _to("Region", "n_regionkey", "r_regionkey"), "customers": _many("Customer", "c_nationkey", "n_nationkey"), "suppliers": _many("Supplier", "s_nationkey", "n_nationkey", order="s_name DESC")},
        "presets": {
            "item": {"fields": [_f("n_nationkey", _I), _f("n_name")]},
            "full": {"extends": "item", "fields": [_rel("region", "item")]},
            "words": {"fields": [_f("n_nationkey", _I), _f("n_regionkey", _I, alias="area", localize=True)]},
            "base": {"fields": [_f("n_nationkey", _I), _f("n_name"), _f("n_regionkey", _I)]},
            "override": {"extends": "base", "fields": [_f("n_nationkey", _I, alias="n_name"), _f("n_regionkey", _I, alias="r")]},
            "suppliers": {"fields": [_f("n_nationkey", _I), _rel("suppliers", "item", formatter="{s_name}", alias="names")]},
            "sellers": {"fields": [_f("n_nationkey", _I), _rel("suppliers", "item")]},
            "tagged": {"fields": [_f("n_nationkey", _I), _f("n_name", internal=True), _fmt("<{n_name}>", "tag")]},
        },
    },
    "Supplier": {"table": "supplier", "primary_keys": "s_suppkey", "relations": {"nation": _to("Nation", "s_nationkey", "n_nationkey")}, "presets": {"item": {"fields": [_f("s_suppkey", _I), _f("s_name")]}, "party": {"fields": [_f("s_name", alias="name")]}}},
    "Customer": {
        "table": "customer",
        "primary_keys": "c_custkey",
        "include": "labelled",
        "aggregatable": {"c_acctbal": {"type": "float", "functions": "sum, avg, min, max"}, "nation.n_nationkey": {"type": _I, "functions": "min, max"}},
        "computable": {
            "title": {"source": "concat({c_name}, nullif({nation.n_name}, 'NATION_6'))", "type": _S},
            "debt": {"source": "case when c_acctbal < 0 then 'owes' else 'fine' end", "type": _S},
            "n_orders": {"source": "(select count(*) from orders o where o.o_custkey = main.c_custkey)", "type": _I},
        },
        "relations": {
            "nation": _to("Nation", "c_nationkey", "n_nationkey"),
            "orders": _many("Order", "o_custkey", "c_custkey"),
            "last_order": {"type": "has_one", "model": "Order", "fk": "o_custkey", "pk": "c_custkey", "order": "o_orderdate DESC"},
            "open_order": {"type": "has_one", "model": "Order", "fk": "o_custkey", "pk": "c_custkey", "where": ".o_orderstatus = 'O'"},
        },
        "presets": {
            "item": {"fields": [_f("c_custkey", _I), _f("c_name")]},
            "card": {"extends": "item", "fields": [_rel("nation", "full")]},
            "last": {"fields": [_f("c_custkey", _I), _rel("last_order", "short")]},
            "open": {"fields": [_f("c_custkey", _I), _rel("open_order", "short")]},
            "history": {"fields": [_f("c_custkey", _I), _rel("orders", "lines")]},
            "computed": {"fields": [_f("c_custkey", _I), _f("title", "computable"), _f("debt", "computable")]},
            "counted": {"fields": [_f("c_custkey", _I), _f("n_orders", "computable")]},
            "party": {"fields": [_f("c_name", alias="name")]},
            "latest_text": {"fields": [_f("c_custkey", _I), _rel("last_order", "short", formatter="#{o_orderkey}/{o_orderstatus}", alias="latest")]},
            "slices": {"fields": [_f("c_custkey", _I), _f("c_name", internal=True), _f("c_mktsegment", internal=True), _fmt("{c_mktsegment}[0]{c_mktsegment}[1..4]-{c_name}[9..99]{c_name}[99]", "code")]},
            "choices": {"fields": [_f("c_custkey", _I), _f("c_acctbal", _N, internal=True), _f("c_mktsegment", internal=True), _fmt('{? c_acctbal < 0 ? "owes" : "{? c_mktsegment == BUILDING ? "builds" : "{c_mktsegment}[0..2]"}"}', "word")]},
            "copy": {"fields": [_f("c_custkey", _I), _rel("nation", "full", alias="home", internal=True), {"source": "{home.region.r_name}", "type": "nested_field", "alias": "region_name"}]},
            "market": {"fields": [_f("c_custkey", _I), _rel("nation", "sellers")]},
            "placed": {"fields": [_f("c_custkey", _I), _rel("nation", "full", formatter="{n_name}/{region.r_name}", alias="place")]},
            "tagged": {"fields": [_f("c_custkey", _I), _rel("nation", "tagged", alias="home")]},
            "labelled": {"fields": [_fmt("<{c_name}>", "label"), _f("c_acctbal", _N)]},
            "renamed": {"fields": [_f("c_custkey", _I, alias="id"), _rel("nation", "item", alias="home")]},
        },
    },
    "Order": {
        "table": "orders",
        "primary_keys": "o_orderkey",
        "aliases": {"land": "customer.nation"},
        "aggregatable": {"o_totalprice": {"type": "float", "functions": "sum, avg, min, max"}, "o_orderdate": {"type": "date", "functions": "min, max"}, "customer.c_acctbal": {"type": "float", "functions": "max"}},
        "computable": {
            "pieces": {"source": "coalesce(sum({lineitems}.l_quantity), 0)", "type": "float"},
            "n_lines": {"source": "count({lineitems}.l_orderkey)", "type": _I},
            "bulky": {"source": "max({lineitems}.l_quantity > 45)", "type": "bool"},
        },
        "relations": {
            "customer": _to("Customer", "o_custkey", "c_custkey"),
            "lineitems": _many("Lineitem", "l_orderkey", "o_orderkey"),
            "returns": _many("Lineitem", "l_orderkey", "o_orderkey", where=".l_returnflag = 'R'"),
            "parts": _many("Part", "l_orderkey", "o_orderkey", through="Lineitem", order="p_name"),
            "bulk_parts": _many("Part", "l_orderkey", "o_orderkey", through="Lineitem", through_where=".l_quantity > 40 and .l_returnflag <> 'N.A'"),
        },
        "presets": {
            "id": {"fields": _ORDER_ID},
            "short": {"fields": [*_ORDER_ID, _f("o_orderstatus")]},
            "card": {"fields": [*_ORDER_ID, _f("o_totalprice", _N), _rel("customer", "card")]},
            "priced": {"fields": [*_ORDER_ID, _f("o_totalprice", _N)]},
            "lines": {"fields": [*_ORDER_ID, _rel("lineitems", "item")]},
            "page": {"fields": [*_ORDER_ID, _f("o_totalprice", _N), _rel("customer", "card"), _rel("lineitems", "item")]},
            "parts": {"fields": [*_ORDER_ID, _rel("parts", "item")]},
            "inline": {"fields": [*_ORDER_ID, _f("(select count(*) from lineitem l where l.l_orderkey = main.o_orderkey)", _I, alias="n")]},
            "bulk": {"fields": [*_ORDER_ID, _rel("bulk_parts", "item")]},
            "sums": {"fields": [*_ORDER_ID, _f("pieces", "computable"), _f("n_lines", "computable")]},
            "dated": {"fields": [*_ORDER_ID, _f("o_orderdate", "date", alias="day", localize=True)]},
            "labels": {"fields": [*_ORDER_ID, _f("o_totalprice", _N, internal=True), _rel("customer", "item", internal=True), _fmt("{label} for {customer.c_name} in {customer.nation.n_name}", "line"), _fmt("No. {o_orderkey}", "label", internal=True)]},
        },
    },
    "Lineitem": {
        "table": "lineitem",
        "primary_keys": "l_orderkey, l_linenumber",
        "relations": {"order": _to("Order", "l_orderkey", "o_orderkey"), "part": _to("Part", "l_partkey", "p_partkey"), "supplier": _to("Supplier", "l_suppkey", "s_suppkey")},
        "presets": {"item": {"fields": [_f("l_linenumber", _I), _f("l_quantity", _N)]}, "key": {"fields": [_f("l_orderkey", _I), _f("l_linenumber", _I)]}},
    },
    "Event": {"table": "events", "primary_keys": "event_id", "presets": {"stamped": {"fields": [_f("event_id", _I), _f("ts", "datetime", alias="at", localize=True), _f("ts", "time", alias="clock", localize=True)]}}},
    "Part": {"table": "part", "primary_keys": "p_partkey", "presets": {"item": {"fields": [_f("p_partkey", _I), _f("p_name")]}}},
    "Sparse": {
        "table": "sparse",
        "primary_keys": "id",
        "relations": {"region": _to("SparseRegion", "region_id", "r_regionkey")},
        "presets": {"item": {"fields": [_f("id", _I), _f("name")]}, "placed": {"fields": [_f("id", _I), _rel("region", "item")]}},
    },
    "SparseRegion": {"table": "sparse_region", "primary_keys": "r_regionkey", "presets": {"item": {"fields": [_f("r_name")]}}},
    "Node": {
        "table": "part_tree",
        "primary_keys": "p_partkey",
        "relations": {"parent": _to("Node", "parent_id", "p_partkey", reentrant=True, max_depth=3)},
        "presets": {"chain": {"fields": [_f("p_partkey", _I), _rel("parent", "chain")]}},
    },
    "Party": {"table": "party", "primary_keys": "party_id, party_type", "relations": {"party": {"type": "belongs_to", "polymorphic": True}}, "presets": {"item": {"fields": [_f("party_id", _I), _f("party_type"), _rel("party", "party")]}}},
}
TEMPLATES = {"labelled": {"presets": {"labelled": {"fields": [_f("c_custkey", _I), _fmt("{c_name} ({c_custkey})", "label"), _f("c_mktsegment")]}}}}
LOCALE = {
    "layoutSettings": {"date": "02.01.2006", "datetime": "2006/01/02 15h04", "ttime": "15:04"},
    "Nation": {"words": {"area": {0: "south", 1: "west"}}},
    "words": {"area": {1: "not this", 2: "wide"}},
    "area": {0: "nor this", 2: "nor that", 3: "far"},
    "n_regionkey": {3: "last", 4: "by its column"},
}
#: Tables that are derived from others: with nulls, as a tree, and with two kinds of parents.
DERIVED = {
    "sparse": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 <> 2 THEN n_name END AS name, nullif(n_regionkey, 3) AS region_id FROM {nation}",
    "sparse_region": "SELECT r_regionkey, nullif(r_name, 'ASIA') AS r_name FROM {region}",
    "part_tree": "SELECT p_partkey, nullif(p_partkey div 2, 0) AS parent_id FROM {part}",
    "party": "SELECT c_custkey AS party_id, 'Customer' AS party_type FROM {customer} UNION ALL SELECT s_suppkey, 'Supplier' FROM {supplier} UNION ALL SELECT s_suppkey, 'Ghost' FROM {supplier}",
}


@cache
def registry() -> Registry:
    return Registry(MODELS, TEMPLATES)


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    catalog = Catalog(spark, sf_dir)
    for name, text in DERIVED.items():
        catalog.add(name, text)
    return Engine(registry(), catalog, Locale.of(LOCALE), **options)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: What the index queries ask for, by name.
REQUESTS: dict[str, dict] = {}


def _index(name: str, sql: str, model: str, preset: str = "", then: Callable[[DataFrame], DataFrame] | None = None, **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = engine(spark, sf_dir).index({"model": model, "preset": preset, **request})
        return then(made) if then else made

    QUERIES[name], SQL[name], REQUESTS[name] = run, sql, {"model": model, "preset": preset, **request}


def _stats(name: str, sql: str, model: str, **request) -> None:
    QUERIES[name], SQL[name] = lambda spark, sf_dir: engine(spark, sf_dir).stats({"model": model, **request}), sql


def _flat(**columns: str) -> Callable[[DataFrame], DataFrame]:
    """Columns by SQL expressions over the nested row."""
    return lambda df: df.select(*(F.expr(text).alias(name) for name, text in columns.items()))


# Projection and filters

_index("index_projection", "SELECT n_nationkey, n_name FROM nation", "Nation", "item")
_CUSTOMER = "SELECT c_custkey, c_name FROM customer WHERE "
for _name, _filters, _where in (
    ("filter_eq_ci", {"c_mktsegment": "building"}, "lower(c_mktsegment) = 'building'"),
    ("filter_eq_cs", {"c_mktsegment__eq_cs": "BUILDING"}, "c_mktsegment = 'BUILDING'"),
    ("filter_eq_num", {"c_nationkey": 1}, "c_nationkey = 1"),
    ("filter_in", {"c_mktsegment__in": ["BUILDING", "MACHINERY"]}, "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("filter_in_empty", {"c_custkey__in": []}, "false"),
    ("filter_range", {"c_acctbal__gte": 10, "c_acctbal__lt": 2000}, "c_acctbal >= 10 AND c_acctbal < 2000"),
    ("filter_start", {"c_mktsegment__start": "b"}, "c_mktsegment ILIKE 'b%'"),
    ("filter_start_cs", {"c_mktsegment__start_cs": "B"}, "c_mktsegment LIKE 'B%'"),
    ("filter_end", {"c_mktsegment__end": "ery"}, "c_mktsegment ILIKE '%ery'"),
    ("filter_end_cs", {"c_name__end_cs": "7"}, "c_name LIKE '%7'"),
    ("filter_cnt", {"c_mktsegment__cnt": "u_l"}, "c_mktsegment ILIKE '%u_l%'"),
    ("filter_cnt_cs", {"c_mktsegment__cnt_cs": "OUSE"}, "c_mktsegment LIKE '%OUSE%'"),
    ("filter_not_cnt", {"c_mktsegment__not_cnt": "ach"}, "c_mktsegment NOT ILIKE '%ach%'"),
    ("filter_not_cnt_cs", {"c_name__not_cnt_cs": "1"}, "c_name NOT LIKE '%1%'"),
    ("filter_or_group", {"or": {"c_nationkey": 3, "c_acctbal__lt": 0}}, "c_nationkey = 3 OR c_acctbal < 0"),
    ("filter_or_array", {"or": [{"c_nationkey": 3, "c_acctbal__lt": 0}, {"c_mktsegment": "furniture"}]}, "(c_nationkey = 3 AND c_acctbal < 0) OR lower(c_mktsegment) = 'furniture'"),
    ("filter_nested_groups", {"c_acctbal__gt": 100, "or": {"and": {"c_nationkey__gt": 5, "c_nationkey__lte": 9}, "or": [{"c_mktsegment": "BUILDING"}, {"c_name__end": "5"}]}}, "c_acctbal > 100 AND ((c_nationkey > 5 AND c_nationkey <= 9) OR c_mktsegment = 'BUILDING' OR c_name LIKE '%5')"),
    ("filter_composite_or", {"c_name_or_c_mktsegment__cnt": "in"}, "c_name ILIKE '%in%' OR c_mktsegment ILIKE '%in%'"),
    ("filter_composite_and", {"c_name_and_c_mktsegment__cnt": "u"}, "c_name ILIKE '%u%' AND c_mktsegment ILIKE '%u%'"),
    ("filter_eq_list", {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 4, 7]}, "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 4, 7)"),
    ("filter_cast_text", {"c_nationkey__start": "1"}, "CAST(c_nationkey AS VARCHAR) LIKE '1%'"),
):
    _index(_name, _CUSTOMER + _where, "Customer", "item", filters=_filters)
_index("filter_not_null", "SELECT id, name FROM (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 <> 2 THEN n_name END AS name FROM nation) WHERE name IS NOT NULL AND name NOT ILIKE '%1%'", "Sparse", "item", filters={"name__not_null": True, "name__not_cnt": "1"})
_index("filter_null", "SELECT n_nationkey AS id, NULL AS name FROM nation WHERE n_nationkey % 5 = 2", "Sparse", "item", filters={"name__null": True})

_index("filter_eq_null", "SELECT n_nationkey AS id, NULL AS name FROM nation WHERE n_nationkey % 5 = 2 AND n_nationkey > 5", "Sparse", "item", filters={"name": None, "id__gt": 5})

# Joins

_ID = "SELECT o_orderkey FROM orders"
_index("filter_null_anti", _ID + " WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", "Order", "id", filters={"returns.l_orderkey__null": True})
_index("path_belongs_to", _ID + " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_6'", "Order", "id", filters={"customer.nation.n_name": "nation_6"})
_index("path_alias", _ID + " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name ILIKE 'nation_1%'", "Order", "id", filters={"land.n_name__start": "nation_1"})
_index("has_many_filter", _ID + " WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)", "Order", "id", filters={"lineitems.l_quantity__gte": 49})
_index("has_many_same_row", _ID + " WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45 AND l_returnflag = 'R')", "Order", "id", filters={"lineitems.l_quantity__gte": 45, "lineitems.l_returnflag": "r"})
_index("has_many_or_root", _ID + " WHERE o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)", "Order", "id", filters={"or": {"o_orderstatus": "P", "lineitems.l_quantity__gte": 49}})
_index("through_filter", _ID + " WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_brand = (SELECT min(p_brand) FROM part))", "Order", "id", filters={"parts.p_brand": "Brand#11"})
SQL["through_filter"] = SQL["through_filter"].replace("(SELECT min(p_brand) FROM part)", "'Brand#11'")
_index("relation_where_join", _ID + " WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity < 3)", "Order", "id", filters={"returns.l_quantity__lt": 3})

# Sorts, pages, distinct values, counts

_index("sort_path_limit", "SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name DESC, c_custkey LIMIT 25", "Customer", "item", sorts=["nation.n_name DESC", "c_custkey"], limit=25)
_index("sort_nulls", "SELECT id, name FROM (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 <> 2 THEN n_name END AS name FROM nation) ORDER BY name DESC NULLS FIRST, id LIMIT 8", "Sparse", "item", sorts=["name DESC"], limit=8)
_index("sort_nulls_last", "SELECT id, name FROM (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 <> 2 THEN n_name END AS name FROM nation) ORDER BY name NULLS LAST, id LIMIT 5 OFFSET 17", "Sparse", "item", sorts=["name ASC"], limit=5, offset=17)
_index("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 15", "Order", "priced", sorts=["o_totalprice DESC", "o_orderkey"], limit=40, offset=15)
_index("sort_has_many_hidden", "SELECT o_orderkey FROM (SELECT DISTINCT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)", "Order", "id", sorts=["lineitems.l_linenumber"])
_index("distinct_values", "SELECT DISTINCT c_mktsegment AS value FROM customer", "Customer", unique_by="c_mktsegment")
_index("distinct_path", "SELECT DISTINCT n_name AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'", "Order", unique_by="customer.nation.n_name", filters={"o_orderstatus": "P"})
_index("distinct_page", "SELECT DISTINCT n_name AS value FROM nation ORDER BY value LIMIT 5 OFFSET 3", "Nation", unique_by="n_name", limit=5, offset=3)
_stats("distinct_count_null", "SELECT count(*) AS count FROM (SELECT DISTINCT CASE WHEN n_nationkey % 5 <> 2 THEN n_name END FROM nation)", "Sparse", unique_by="name")
_stats("count_all", "SELECT count(*) AS count FROM orders", "Order")
_stats("count_has_many", "SELECT count(DISTINCT o_orderkey) AS count FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 30", "Order", filters={"lineitems.l_quantity__gt": 30})
_stats("agg_sum_avg_min_max", "SELECT count(*) AS count, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders WHERE o_orderstatus = 'F'", "Order", filters={"o_orderstatus": "F"}, aggregates={"total": {"fn": "sum", "field": "o_totalprice"}, "mean": {"fn": "avg", "field": "o_totalprice"}, "least": {"fn": "min", "field": "o_totalprice"}, "most": {"fn": "max", "field": "o_totalprice"}, "first": {"fn": "min", "field": "o_orderdate"}})
_stats("agg_path", "SELECT count(*) AS count, max(c_acctbal) AS most FROM orders LEFT JOIN customer ON o_custkey = c_custkey", "Order", aggregates={"most": {"fn": "max", "field": "customer.c_acctbal"}})
_stats("agg_has_many_filter", "SELECT count(*) AS count, sum(o_totalprice) AS total FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)", "Order", filters={"lineitems.l_quantity__gt": 45}, aggregates={"total": {"fn": "sum", "field": "o_totalprice"}})

# Computed columns

_index("comp_scalar", "SELECT c_custkey, concat(c_name, nullif(n_name, 'NATION_6')) AS title, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'fine' END AS debt FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", "Customer", "computed")
_index("comp_concat_null", "SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_6' AND c_name LIKE '%1'", "Customer", "item", filters={"title__end": "1"})
SQL["comp_concat_null"] = "SELECT c_custkey, c_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE concat(c_name, nullif(n_name, 'NATION_6')) ILIKE '%1'"
_index("comp_correlated", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer", "Customer", "counted")
_SUMS = "SELECT o_orderkey, coalesce(sum(l_quantity), 0) AS pieces, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"
_index("comp_has_many_select", _SUMS, "Order", "sums")
_index("comp_has_many_filter", _SUMS + " HAVING sum(l_quantity) > 200", "Order", "sums", filters={"pieces__gt": 200})
_index("comp_has_many_sort", _SUMS + " ORDER BY pieces DESC, o_orderkey LIMIT 30", "Order", "sums", sorts=["pieces DESC", "o_orderkey"], limit=30)
_index("comp_has_many_page", _SUMS + " ORDER BY o_orderkey LIMIT 30", "Order", "sums", sorts=["o_orderkey"], limit=30)
_index("comp_false_is_not_null", "SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING NOT bool_or(l_quantity > 45)", "Order", "id", filters={"bulky": False})
_index("inline_subquery", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders", "Order", "inline")
_stats("count_comp_filter", "SELECT count(*) AS count FROM (" + _SUMS + ") WHERE n_lines = 0", "Order", filters={"n_lines": 0})

# Nested rows

_CARD = _flat(c_custkey="c_custkey", nation__n_name="nation.n_name", nation__region__r_name="nation.region.r_name")
_CARD_SQL = "SELECT c_custkey, n_name AS nation__n_name, r_name AS nation__region__r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
_index("nest_belongs_to", "SELECT n_nationkey, n_name, r_name AS region__r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", "Nation", "full", _flat(n_nationkey="n_nationkey", n_name="n_name", region__r_name="region.r_name"))
_index("nest_chain", _CARD_SQL, "Customer", "card", _CARD)
_index("nest_collapse_null", "SELECT n_nationkey AS id, nullif(r_name, 'ASIA') AS name, r_name IS NULL OR r_name = 'ASIA' AS missing FROM nation LEFT JOIN region ON nullif(n_regionkey, 3) = r_regionkey", "Sparse", "placed", _flat(id="id", name="region.r_name", missing="region is null"))
_index("has_one_first", "SELECT c_custkey, o_orderkey AS latest FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey) AS n FROM orders) ON o_custkey = c_custkey AND n = 1", "Customer", "last", _flat(c_custkey="c_custkey", latest="last_order.o_orderkey"))
_index("has_one_where", "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS first_open FROM customer", "Customer", "open", _flat(c_custkey="c_custkey", first_open="open_order.o_orderkey"))
_LINES = lambda df: df.select("o_orderkey", F.explode("lineitems").alias("x")).select("o_orderkey", "x.*")
_index("has_many_array", "SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "Order", "lines", _LINES)
_index("has_many_empty", "SELECT o_orderkey, count(l_orderkey)::INTEGER AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", "Order", "lines", _flat(o_orderkey="o_orderkey", n="size(lineitems)"))
_index("has_many_nested", "SELECT o_custkey AS c_custkey, o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey", "Customer", "history", lambda df: df.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey", F.explode("o.lineitems").alias("x")).select("c_custkey", "o_orderkey", "x.*"))
_index("through_has_many", "SELECT o_orderkey, string_agg(p_partkey, ',' ORDER BY p_name, p_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey", "Order", "parts", lambda df: df.where("size(parts) > 0").select("o_orderkey", F.expr("array_join(transform(parts, p -> string(p.p_partkey)), ',')").alias("parts")))
_index("through_where", "SELECT l_orderkey AS o_orderkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 40", "Order", "bulk", lambda df: df.select("o_orderkey", F.explode("bulk_parts").alias("p")).select("o_orderkey", "p.p_partkey"))
_PAGE = "WITH page AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10) "
_index("page_then_hydrate", _PAGE + "SELECT o_orderkey, o_totalprice, c_name, n_name, r_name, l_linenumber, l_quantity FROM page LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_orderkey = o_orderkey", "Order", "page", lambda df: df.select("o_orderkey", "o_totalprice", "customer.c_name", "customer.nation.n_name", "customer.nation.region.r_name", F.explode_outer("lineitems").alias("x")).select("o_orderkey", "o_totalprice", "c_name", "n_name", "r_name", "x.*"), sorts=["o_totalprice DESC", "o_orderkey"], limit=50, offset=10)
_index("recursive_chain", "WITH t AS (SELECT p_partkey, nullif(p_partkey // 2, 0) AS up FROM part) SELECT a.p_partkey, b.p_partkey AS up1, c.p_partkey AS up2, d.p_partkey AS up3 FROM t a LEFT JOIN t b ON a.up = b.p_partkey LEFT JOIN t c ON b.up = c.p_partkey LEFT JOIN t d ON c.up = d.p_partkey", "Node", "chain", _flat(p_partkey="p_partkey", up1="parent.p_partkey", up2="parent.parent.p_partkey", up3="parent.parent.parent.p_partkey"))
_index("polymorphic", "SELECT c_custkey AS party_id, 'Customer' AS party_type, c_name AS name FROM customer UNION ALL SELECT s_suppkey, 'Supplier', s_name FROM supplier UNION ALL SELECT s_suppkey, 'Ghost', NULL FROM supplier", "Party", "item", _flat(party_id="party_id", party_type="party_type", name="variant_get(party, '$.name', 'string')"))

_index("under_belongs_to", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey", "Customer", "market", lambda df: df.select("c_custkey", F.explode("nation.suppliers").alias("x")).select("c_custkey", "x.s_suppkey"))

# Text

_index("fmt_container_belongs_to", "SELECT c_custkey, n_name || '/' || r_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "Customer", "placed")
_index("fmt_nested", "SELECT c_custkey, '<' || n_name || '>' AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey", "Customer", "tagged", _flat(c_custkey="c_custkey", tag="home.tag"))
_index("localize_time", "SELECT event_id, strftime(ts, '%Y/%m/%d %Hh%M') AS at, strftime(ts, '%H:%M') AS clock FROM events", "Event", "stamped")
_index("fmt_tokens", "SELECT o_orderkey, 'No. ' || o_orderkey || ' for ' || c_name || ' in ' || n_name AS line FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "Order", "labels")
_index("fmt_slice", "SELECT c_custkey, substr(c_mktsegment, 1, 1) || substr(c_mktsegment, 2, 3) || '-' || substr(c_name, 10, 90) AS code FROM customer", "Customer", "slices")
_index("fmt_ternary", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_mktsegment = 'BUILDING' THEN 'builds' ELSE substr(c_mktsegment, 1, 2) END AS word FROM customer", "Customer", "choices")
_index("fmt_container_has_one", "SELECT c_custkey, latest FROM customer LEFT JOIN (SELECT o_custkey, '#' || o_orderkey || '/' || o_orderstatus AS latest, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey) AS n FROM orders) ON o_custkey = c_custkey AND n = 1", "Customer", "latest_text")
_index("fmt_container_has_many", "SELECT n_nationkey, coalesce(string_agg(s_name, ',' ORDER BY s_name DESC, s_suppkey), '') AS names FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey", "Nation", "suppliers", _flat(n_nationkey="n_nationkey", names="array_join(names, ',')"))
_index("nested_field", "SELECT c_custkey, r_name AS region_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", "Customer", "copy")
_index("internal_hidden", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_mktsegment = 'BUILDING' THEN 'builds' ELSE substr(c_mktsegment, 1, 2) END AS word FROM customer WHERE c_nationkey = 4", "Customer", "choices", filters={"c_nationkey": 4})
_index("preset_alias", "SELECT c_custkey AS id, n_name AS home__n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", "Customer", "renamed", _flat(id="id", home__n_name="home.n_name"))
_index("localize_dict", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'wide' WHEN 3 THEN 'far' ELSE 'by its column' END AS area FROM nation", "Nation", "words")
_index("localize_date", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders", "Order", "dated")
_index("extends_override", "SELECT n_nationkey, n_nationkey AS n_name, n_regionkey, n_regionkey AS r FROM nation", "Nation", "override")
_index("include_template", "SELECT c_custkey, '<' || c_name || '>' AS label, c_mktsegment, c_acctbal FROM customer", "Customer", "labelled")


def child_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines where all parents together get 100, as the original service cuts them at 1000."""
    made = engine(spark, sf_dir, child_cap=100).index({"model": "Order", "preset": "lines"})
    return made.select("o_orderkey", F.explode("lineitems").alias("x")).select("o_orderkey", "x.l_linenumber")


QUERIES["child_cap"], SQL["child_cap"] = child_cap, "SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100"


# Importer and logs


def import_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, preset, field`` of the models that the importer makes of the tables and their keys."""
    catalog = Catalog(spark, sf_dir)
    names = ["region", "nation", "customer", "supplier", "orders"]
    keys = {("nation", "n_regionkey"): ("region", "r_regionkey"), ("customer", "c_nationkey"): ("nation", "n_nationkey"), ("supplier", "s_nationkey"): ("nation", "n_nationkey"), ("orders", "o_custkey"): ("customer", "c_custkey")}
    made = from_tables({n: catalog.table(n) for n in names}, keys, {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"]})
    rows = [(model, preset, f.get("alias") or f["source"]) for model, raw in made.items() for preset, p in raw["presets"].items() for f in p["fields"]]
    return spark.createDataFrame(rows, "model string, preset string, field string")


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest purchases, from the events as a JSON log in the shared folder."""
    path = own_path(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.struct(F.lit("INFO").alias("level"), F.col("event_type").alias("msg"), F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user"))
    events.orderBy("event_id").select(F.to_json(line).alias("value")).write.text(path)
    return logs.scan(spark, path, level="info", message="purchase", key="user", limit=50).select("level", "msg", F.col("fields")["id"].alias("id"))


QUERIES |= {"import_models": import_models, "log_scan": log_scan}
SQL["log_scan"] = "SELECT 'INFO' AS level, event_type AS msg, CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type LIKE '%purchase%' ORDER BY event_id DESC LIMIT 50"
SQL["import_models"] = """
SELECT model, preset, unnest(string_split(fields, ' ')) AS field FROM (VALUES
  ('Region', 'item', 'id r_name'), ('Region', 'with_nation', 'nation'),
  ('Nation', 'item', 'id n_name'), ('Nation', 'full_info', 'n_nationkey n_name n_regionkey n_regionkey'),
  ('Nation', 'with_customer', 'customer'), ('Nation', 'with_supplier', 'supplier'),
  ('Customer', 'item', 'id c_name'), ('Customer', 'full_info', 'c_custkey c_name c_nationkey c_acctbal c_mktsegment c_nationkey'), ('Customer', 'with_orders', 'orders'),
  ('Supplier', 'item', 'id s_name'), ('Supplier', 'full_info', 's_suppkey s_name s_nationkey s_acctbal s_nationkey'),
  ('Order', 'item', 'id o_orderstatus'), ('Order', 'full_info', 'o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority o_custkey')
) t(model, preset, fields)
"""
