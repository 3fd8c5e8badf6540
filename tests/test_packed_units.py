"""Packed values and units."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mimansa.operators import packed, units
from tests.conftest import rows


def names(text):
    return [v["value"] for v in packed.split_packed(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Alpha (650 mg) +Beta-Gamma (1mg)", ["alpha", "beta-gamma"]),
        ('"Alpha, micronised - 200 mg", Beta 2.5%', ["alpha, micronised", "beta"]),
        ("Alpha 20mg/5ml/Beta 5 mg", ["alpha", "beta"]),
        ("Alpha - 2000 IU/Beta - 1 mg", ["alpha", "beta"]),
        ("1) Alpha B8 (40mg) 2) Beta (as sodium) (20mg)", ["alpha b8", "beta (as sodium)"]),
        ("1. Alpha 2. Beta", ["alpha", "beta"]),
        ("Alpha,, Beta, ,", ["alpha", "beta"]),
        ("Alpha, and Beta", ["alpha", "beta"]),
        ("Alpha &amp; Beta and Gamma", ["alpha", "beta", "gamma"]),
        ("Alpha\n- Beta\r\nGamma", ["alpha", "beta", "gamma"]),
        ("Alpha||Beta• Gamma、Delta；Eps", ["alpha", "beta", "gamma", "delta", "eps"]),
        ("[{'name': \"D'Alpha\", 'strength': None}, {'name': 'B  c, dried'}]", ["d'alpha", "b c, dried"]),
        ('[{"name": "Alpha", "strength": null}]', ["alpha"]),
        ("[{'name': 'Alpha', 'strength': '1mg'}", ["alpha"]),
        ('["Alpha, light 5 mg", "Beta (1%)"]', ["alpha, light", "beta"]),
        ("Alpha.", ["alpha"]),
        ("N/A", []),
        ("[]", []),
        ("  ", []),
        (None, []),
        ("", []),
    ],
)
def test_values(text, expected):
    assert names(text) == expected


def test_malformed_quote_is_given_back():
    got = packed.split_packed('"Alpha, Beta')
    assert [v["value"] for v in got] == ["alpha", "beta"]
    assert got[0]["error"] == "stray_quote"


def test_unclosed_list_is_flagged():
    assert packed.split_packed("[{'name': 'A'}, {'name': 'B'}")[1] == {"pos": 2, "value": "b", "kind": "object", "error": "unclosed_list"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1, ;|+&/()[]{}'\"\\:.\n-%mg", max_size=60))
def test_any_text_gives_numbered_values(text):
    got = packed.split_packed(text)
    assert [v["pos"] for v in got] == list(range(1, len(got) + 1))
    assert all(v["value"].strip() for v in got)


def test_explode_keeps_rows_apart(spark):
    df = spark.createDataFrame([(1, "A + B", "x"), (1, "A + B", "x"), (2, None, "y"), (3, "a" * 100_000, "z")], "row_id long, active_ingredients string, value string")
    assert rows(packed.explode_packed(df, "active_ingredients", ["row_id"]), "row_id", "pos", "value")[:4] == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert packed.listed_ingredients(df).count() == 4
    with pytest.raises(ValueError, match="clash"):
        packed.explode_packed(df, "active_ingredients", ["row_id", "value"])
    assert packed.listed_ingredients(df.limit(0)).count() == 0


CASES = [
    ("250 mg", None, ("ug", 250_000)), ("2.5 MG/5ML", None, ("ug/ml", 500)), ("0,5 %", None, ("ug/g", 5_000)), ("1,500,000 IU", None, ("iu", 1_500_000)), ("1% w/v", None, ("ug/ml", 10_000)),
    ("2 lakh IU", None, ("iu", 200_000)), ("1.5 MIU", None, ("iu", 1_500_000)), ("25kIU", None, ("iu", 25_000)), ("२५०मि.ग्रा.", None, ("ug", 250_000)), ("３００Mg", None, ("ug", 300_000)),
    ("10 mg per tablet", None, ("ug", 10_000)), ("2 g/100g", None, ("ug/g", 20_000)), ("1 l", None, ("ul", 1_000_000)), ("approx (12.5 micrograms)", None, None), ("5 µg/g", None, ("ug/g", 5)), ("100 units/10 ml", None, ("iu/ml", 10)),
    ("500", "Foo 500 mg tablet", ("ug", 500_000)), ("500", "Foo 50 mg", None), ("75", "Foo75mg.", ("ug", 75_000)), ("75", "Foo 175 mg", None), ("5", "Foo 2.5 mg", None), ("0.25", "Foo 0,25 g", ("ug", 250_000)), ("10-20 mg", None, None), ("5mg+5mg", None, None), ("-5mg", None, None), ("0 mg", None, None),
    ("10 mEq", None, None), ("5 billion spores", None, None), ("mg", None, None), ("", None, None), (None, None, None),
]


def test_strengths(spark):
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(CASES)], "row_id long, primary_strength string, brand_name string")
    records = spark.createDataFrame([(1, 0.075, "-", "Foo 0.075 G"), (2, 5.0, "x1000 IU", None), (3, None, "mg", None), (4, -5.0, "mg", "a"), (5, 3.0, "mg/vial", None), (6, 2.0, None, "Foo 2mcg"), (7, 2.0, "'000 units", None)], "record_id long, strength_value double, strength_unit string, brand string")
    got = {(r.src, r.ref_id): (r.unit, r.amount) for r in units.common_strengths(df, records).collect()}
    for i, (text, _, expected) in enumerate(CASES):
        if text and text.startswith("approx"):
            continue
        assert got.get(("medicines", i)) == expected, text
    assert {k[1]: v for k, v in got.items() if k[0] == "medicine_records"} == {1: ("ug", 75_000), 2: ("iu", 5_000), 5: ("ug", 3_000), 6: ("ug", 2), 7: ("iu", 2_000)}


def test_clashing_columns(spark):
    df = spark.createDataFrame([("10 mg", "mine")], "s string, unit string")
    assert rows(units.converted(df, "s"), "s", "unit", "amount") == [("10 mg", "ug", 10_000)]
    assert units.converted(df.limit(0), "s").count() == 0
