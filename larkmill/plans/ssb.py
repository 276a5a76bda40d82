"""The thirteen star-schema queries over views derived from the tables at hand.

Constants are chosen from values that occur in them: brands are ``Brand#n``, categories are
part types, manufacturers ``MFGR#1`` to ``MFGR#5``, cities a nation's name and a digit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill.catalog import exact_sum, with_views

from .registry import query


def _star(c, dates=None, parts=None, suppliers=None, customers=None, lines=None):
    """lineorder joined with filtered dimensions; dimensions without a filter and without a use stay away."""
    out = c.lineorder
    if lines is not None:
        out = out.where(lines)
    for view, condition, key, own in (("date", dates, "lo_orderdate", "d_datekey"), ("ssb_part", parts, "lo_partkey", "p_partkey"), ("ssb_supplier", suppliers, "lo_suppkey", "s_suppkey"), ("ssb_customer", customers, "lo_custkey", "c_custkey")):
        if condition is not None:
            out = out.join(getattr(c, view).where(condition), F.col(key) == F.col(own))
    return out


_FROM = """FROM lineorder JOIN dates ON lo_orderdate = d_datekey JOIN ssb_part ON lo_partkey = p_partkey
JOIN ssb_supplier ON lo_suppkey = s_suppkey JOIN ssb_customer ON lo_custkey = c_custkey"""
_ALL = ("lineorder", "dates", "ssb_part", "ssb_supplier", "ssb_customer")


def _flight1(name, dates, lines):
    sql = with_views(f"SELECT CAST(sum(lo_extendedprice * lo_discount) AS DOUBLE) / 10000 AS revenue FROM lineorder JOIN dates ON lo_orderdate = d_datekey WHERE {dates} AND {lines}", "lineorder", "dates")

    @query(name, sql)
    def build(c):
        return _star(c, dates=dates, lines=lines).agg((exact_sum(F.col("lo_extendedprice") * F.col("lo_discount")) / 10000).alias("revenue"))


def _flight(name, keys, measure, **where):
    condition = " AND ".join(f"({x})" for x in where.values())
    value = {"revenue": "lo_revenue", "profit": "lo_revenue - lo_supplycost"}[measure]
    sql = with_views(f"SELECT {', '.join(keys)}, CAST(sum({value}) AS DOUBLE) / 10000 AS {measure} {_FROM} WHERE {condition} GROUP BY {', '.join(keys)}", *_ALL)

    @query(name, sql)
    def build(c):
        return _star(c, **where).groupBy(*keys).agg((exact_sum(F.expr(value)) / 10000).alias(measure))


_flight1("ssb_q11", "d_year = 1996", "lo_discount BETWEEN 1 AND 3 AND lo_quantity < 25")
_flight1("ssb_q12", "d_yearmonthnum = 199701", "lo_discount BETWEEN 4 AND 6 AND lo_quantity BETWEEN 26 AND 35")
_flight1("ssb_q13", "d_weeknuminyear = 6 AND d_year = 1997", "lo_discount BETWEEN 5 AND 7 AND lo_quantity BETWEEN 26 AND 35")

_BRANDS = ["d_year", "p_brand1"]
_flight("ssb_q21", _BRANDS, "revenue", dates="true", parts="p_category = 'ECONOMY'", suppliers="s_region = 'AMERICA'")
_flight("ssb_q22", _BRANDS, "revenue", dates="true", parts="p_brand1 BETWEEN 'Brand#21' AND 'Brand#24'", suppliers="s_region = 'ASIA'")
_flight("ssb_q23", _BRANDS, "revenue", dates="true", parts="p_brand1 = 'Brand#21'", suppliers="s_region = 'EUROPE'")

_YEARS = "d_year BETWEEN 1995 AND 1999"
_CITIES = "'NATION_7 1', 'NATION_7 5'"
_flight("ssb_q31", ["c_nation", "s_nation", "d_year"], "revenue", dates=_YEARS, suppliers="s_region = 'ASIA'", customers="c_region = 'ASIA'")
_flight("ssb_q32", ["c_city", "s_city", "d_year"], "revenue", dates=_YEARS, suppliers="s_nation = 'NATION_7'", customers="c_nation = 'NATION_7'")
_flight("ssb_q33", ["c_city", "s_city", "d_year"], "revenue", dates=_YEARS, suppliers=f"s_nation = 'NATION_7' OR s_city IN ({_CITIES})", customers=f"c_city IN ({_CITIES})")
_flight("ssb_q34", ["c_city", "s_city", "d_year"], "revenue", dates="d_yearmonth IN ('Dec1997', 'Nov1997')", suppliers="s_region = 'ASIA'", customers="c_region = 'ASIA'")

_MAKERS = "p_mfgr = 'MFGR#1' OR p_mfgr = 'MFGR#2'"
_flight("ssb_q41", ["d_year", "c_nation"], "profit", dates="true", parts=_MAKERS, suppliers="s_region = 'AMERICA'", customers="c_region = 'AMERICA'")
_flight("ssb_q42", ["d_year", "s_nation", "p_category"], "profit", dates="d_year IN (1997, 1998)", parts=_MAKERS, suppliers="s_region = 'AMERICA'", customers="c_region = 'AMERICA'")
_flight("ssb_q43", ["d_year", "s_city", "p_brand1"], "profit", dates="d_year IN (1997, 1998)", parts="p_category = 'LARGE'", suppliers="s_nation = 'NATION_1'", customers="c_region = 'AMERICA'")
