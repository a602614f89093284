"""Parsing, typing, identity and catalogs."""

import pytest

from factorspark.engine import Engine, category, field_catalog
from factorspark.errors import ExpressionError
from factorspark.operators.catalogs import VERSIONS, catalog, everything
from factorspark.plans.compiler import PRICE_LEVEL_WARNING
from factorspark.plans.model import Basis, FieldSpec
from factorspark.plans.parser import fields_of, parse


def code_of(text, engine=None):
    with pytest.raises(ExpressionError) as e:
        (engine or Engine()).compile(text)
    return e.value.code


@pytest.mark.parametrize("text,code", [
    ("", "PARSE_ERROR"), ("  ", "PARSE_ERROR"), ("add(close", "PARSE_ERROR"), ("add(close,,open)", "PARSE_ERROR"), ("close open", "PARSE_ERROR"), ("close+open", "UNSAFE_SYNTAX"), ("__import__", "UNSAFE_SYNTAX"),
    ("close.x", "UNSAFE_SYNTAX"), ("'a'", "UNSAFE_SYNTAX"), ("add(close,True)", "UNSAFE_SYNTAX"), ("-close", "UNSAFE_SYNTAX"), ("add(close,1e999)", "UNSAFE_SYNTAX"), ("neg(neg(neg(neg(neg(neg(neg(neg(close))))))))", "RESOURCE_LIMIT"),
    ("f(" + ",".join(["1"] * 70) + ")", "RESOURCE_LIMIT"), ("nope(close)", "UNKNOWN_OPERATOR"), ("neg(nope)", "UNKNOWN_FIELD"), ("neg(close,open)", "TYPE_MISMATCH"), ("neg(1)", "TYPE_MISMATCH"), ("add(1,2)", "TYPE_MISMATCH"),
    ("where(close,1,2)", "TYPE_MISMATCH"), ("ts_mean(close,7)", "INVALID_PARAMETER"), ("signed_power(close,4)", "INVALID_PARAMETER"), ("add(close,volume)", "UNIT_MISMATCH"), ("where(gt(close,open),close,volume)", "UNIT_MISMATCH"),
    ("ts_median(close,5)", "UNKNOWN_OPERATOR"),
])
def test_errors(text, code):
    assert code_of(text) == code


def test_bases_do_not_mix():
    e = Engine(fields=field_catalog(extra=(FieldSpec("raw_close", unit="price", basis=Basis.RAW),)))
    assert code_of("sub(close,raw_close)", e) == "PRICE_BASIS_MISMATCH"


def test_canonical_form_and_identity():
    e = Engine()
    a, b = e.compile("add(open, close)"), e.compile(" add(close,open) ")
    assert a.canonical == b.canonical == "add(close,open)" and a.factor_id == b.factor_id
    assert e.compile("rank(pct_change(close,5))").canonical == "cs_rank(ts_pct_change(close,5))"
    assert e.compile("ts_corr(volume,close,10)").canonical == "ts_corr(close,volume,10)"
    assert e.compile("sub(close,-1)").canonical == "sub(close,-1)"
    assert Engine(catalog("astock_formula_ops_v7_production_path")).compile("add(close,open)").factor_id != a.factor_id
    assert fields_of("add(close,ts_mean(open,5))") == ("close", "open")
    assert parse("1.50").value == 1.5


@pytest.mark.parametrize("text,lookback,complexity,unit", [
    ("close", 0, 0, "price"), ("ts_delay(close,5)", 5, 1, "price"), ("ts_mean(ts_pct_change(close,5),10)", 14, 2, "ratio"), ("div(close,volume)", 0, 1, "price/shares"), ("div(1,close)", 0, 1, "1/price"), ("mul(close,volume)", 0, 1, "price*shares"),
    ("signed_power(volume,2)", 0, 1, "nonlinear(shares,2)"), ("ts_slope(close,5)", 4, 1, "price/observation"), ("ts_product(close,5)", 4, 1, "product(price)"), ("ts_argmax(close,5)", 4, 1, "observation_offset"),
    ("ts_beta(close,volume,5)", 4, 1, "price/shares"), ("ts_cov(close,volume,5)", 4, 1, "price*shares"), ("cs_residual(close,volume)", 0, 1, "price"), ("where(gt(close,open),volume,0)", 0, 2, "shares"),
])
def test_typing(text, lookback, complexity, unit):
    c = Engine().compile(text)
    assert (c.lookback, c.complexity, c.unit) == (lookback, complexity, unit)


@pytest.mark.parametrize("text,warned", [("cs_rank(close)", True), ("close", True), ("cs_rank(ts_pct_change(close,5))", False), ("div(close,open)", False), ("div(close,volume)", True), ("ts_zscore(close,5)", False), ("volume", False)])
def test_price_level_warning(text, warned):
    assert (PRICE_LEVEL_WARNING in Engine().compile(text).warnings) is warned


def test_catalogs():
    sizes = {v: len(catalog(v).specs) for v in VERSIONS}
    assert sizes["astock_formula_ops_v3"] == sizes["astock_formula_ops_v6_production"] == 45
    assert len(everything().specs) == sizes["astock_formula_ops_v3"] + 1 + 3 + 3 + 6 + 3
    e = Engine(everything(), field_catalog(extra=(category("industry"),)))
    for spec in everything().specs.values():
        assert e.compile(spec.example()).canonical.startswith(spec.name)
        assert spec.payload()["name"] == spec.name


def test_batches():
    good, bad = Engine().compile_many(["close", "nope(close)", "neg(close)"])
    assert [g.canonical for g in good] == ["close", "neg(close)"] and [b.code for b in bad] == ["UNKNOWN_OPERATOR"]
    with pytest.raises(ValueError, match="same"):
        Engine().compile_many(["add(close,open)", "add(open,close)"])


def test_operators_of_your_own(spark):
    import datetime

    from pyspark.sql import functions as F

    from factorspark.operators.catalogs import catalog, extended
    from factorspark.plans.model import Kind, OperatorSpec, Phase

    halved = OperatorSpec("halved", "arithmetic", (frozenset({Kind.FLOAT}),), Phase.ROW, lambda ctx, a: a / F.lit(2.0))
    own = Engine(extended("mine_v1", catalog(), halved))
    c = own.compile("cs_rank(halved(close))")
    assert c.canonical == "cs_rank(halved(close))" and c.factor_id != Engine().compile("cs_rank(close)").factor_id
    rows = [(k, datetime.date(2024, 1, 1), 0, float(k), True) for k in (1, 2, 3)]
    panel = spark.createDataFrame(rows, "code bigint, date date, pos int, close double, in_universe boolean")
    halves = own.compile("halved(close)")
    assert sorted(r[halves.factor_id] for r in own.plan(halves).results(panel).collect()) == [0.5, 1.0, 1.5]
    with pytest.raises(ValueError):
        extended("mine_v2", catalog(), halved, halved)
