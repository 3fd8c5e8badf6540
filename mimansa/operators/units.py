"""Quantities in different units: an automaton over unit aliases, then a broadcast join with conversion factors.

One automaton holds every alias. It runs over the text behind a number and takes the longest alias at each place;
what it leaves uncovered voids the reading, so "mg" is never found inside "mEq". Field context settles what is left:
an alias behind a slash or "per" is a denominator, a scale word needs a unit behind it, and a field without a unit
takes the one that follows the same number in the product's name.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal, InvalidOperation

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Alias -> (kind, factor to the common unit of the kind).
# Kinds: mass in ug, iu in iu, vol in ul, scale as a plain multiplier, pct as parts per hundred, each dropped as a
# denominator, basis a note on a percentage, fill words without meaning, other measures that are never converted.
ALIASES: dict[str, tuple[str, float]] = {
    **dict.fromkeys(["ug", "mcg", "mcgs", "µg", "μg", "microgram", "micrograms", "microgm", "मा.ग्रा.", "माइक्रोग्राम"], ("mass", 1.0)),
    **dict.fromkeys(["mg", "mgs", "m.g.", "milligram", "milligrams", "मि.ग्रा.", "मिग्रा", "मिलीग्राम"], ("mass", 1e3)),
    **dict.fromkeys(["g", "gm", "gms", "gram", "grams", "ग्राम", "ग्रा."], ("mass", 1e6)),
    **dict.fromkeys(["kg", "kgs"], ("mass", 1e9)),
    **dict.fromkeys(["ng", "nanogram", "nanograms"], ("mass", 1e-3)),
    **dict.fromkeys(["iu", "i.u.", "u", "unit", "units", "int. unit", "int. units", "international units", "international unit"], ("iu", 1.0)),
    **dict.fromkeys(["kiu", "ku"], ("iu", 1e3)),
    **dict.fromkeys(["miu"], ("iu", 1e6)),
    **dict.fromkeys(["ul", "µl", "μl"], ("vol", 1.0)),
    **dict.fromkeys(["ml", "m.l.", "cc", "c.c.", "millilitre", "millilitres", "milliliter", "milliliters", "मि.ली."], ("vol", 1e3)),
    **dict.fromkeys(["l", "litre", "litres", "liter", "liters", "ltr"], ("vol", 1e6)),
    **dict.fromkeys(["k", "thousand", "x1000", "x 1000", "'000", "000s", "1000"], ("scale", 1e3)),
    **dict.fromkeys(["lakh", "lakhs", "lac", "lacs"], ("scale", 1e5)),
    **dict.fromkeys(["m", "million", "mega", "mio", "mn"], ("scale", 1e6)),
    **dict.fromkeys(["crore", "crores"], ("scale", 1e7)),
    **dict.fromkeys(["%", "percent", "per cent", "pct"], ("pct", 1.0)),
    **dict.fromkeys(["tab", "tabs", "tablet", "tablets", "cap", "caps", "capsule", "capsules", "vial", "vials", "dose", "doses", "amp", "ampoule", "puff", "actuation", "sachet"], ("each", 1.0)),
    **dict.fromkeys(["w/w", "(w/w)"], ("basis_w", 1.0)),
    **dict.fromkeys(["w/v", "(w/v)"], ("basis_v", 1.0)),
    **dict.fromkeys(["/", "per"], ("per", 1.0)),
    **dict.fromkeys(["meq", "mmol", "mol", "billion", "spores", "cfu", "ppm", "kcal", "cm", "mm"], ("other", 1.0)),
}
# The common unit of numerator and denominator kinds, and its scale.
TARGETS = [
    ("mass", None, "ug"), ("iu", None, "iu"), ("vol", None, "ul"),
    ("mass", "vol", "ug/ml"), ("iu", "vol", "iu/ml"), ("mass", "mass", "ug/g"),
    ("pct", "basis_w", "ug/g"), ("pct", None, "ug/g"), ("pct", "basis_v", "ug/ml"),
]
#: Factor of a ratio's denominator: amounts are per ml and per g.
PER_BASE = {"vol": 1e3, "mass": 1e6}
#: One per cent is 1 g in 100 g or 100 ml, thus 10,000 ug in a g or ml.
PERCENT = 10_000.0

READING = T.StructType().add("value", T.DoubleType()).add("scale", T.StringType()).add("unit", T.StringType()).add("per_value", T.DoubleType()).add("per_unit", T.StringType())
_NUM = r"\d{1,3}(?:,\d{2,3})*,\d{3}(?:\.\d+)?(?!\d)|\d+(?:[.,]\d+)?|\.\d+"
_HEAD = re.compile(rf"(?P<num>{_NUM})(?P<rest>.*)$", re.S)
_LEAD = re.compile(r"^(?:(?:strength|approx|about|each|contains|conc)\b\.?|[:=~(\[≈\s])+", re.I)
_WORDS = re.compile(r"\s+")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for alias in ALIASES:
        found.add_word(alias, alias)
    found.make_automaton()
    return found


_FOUND = _automaton()


def number(text: str) -> Decimal | None:
    """A comma marks decimals if fewer than three digits follow it, else it groups."""
    if text.count(",") == 1 and "." not in text and len(text.split(",")[1]) < 3:
        text = text.replace(",", ".")
    try:
        return Decimal(text.replace(",", ""))
    except InvalidOperation:
        return None


def fold(text: str) -> str:
    """Compatibility forms, digits of any script as 0-9, lower-case, single spaces."""
    text = "".join(str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else c for c in unicodedata.normalize("NFKC", text))
    return _WORDS.sub(" ", text.lower()).strip()


def _tokens(text: str) -> list[tuple[str, str]] | None:
    """The text as aliases and numbers, leaving nothing uncovered; None where that fails."""
    longest: dict[int, str] = {}
    for end, alias in _FOUND.iter(text):
        start = end - len(alias) + 1
        before, after = text[start - 1 : start], text[end + 1 : end + 2]
        if alias[0].isalpha() and before.isalpha() or alias[-1].isalpha() and (after.isalpha() or unicodedata.category(after or " ")[0] == "M"):
            continue
        if alias[0].isdigit() and (before.isdigit() or after.isdigit() or after in (".", ",")):
            continue
        if len(alias) > len(longest.get(start, "")):
            longest[start] = alias
    out, i = [], 0
    while i < len(text):
        if i in longest and not (longest[i] == "1000" and out and out[-1][1] == "/"):
            out.append(("alias", longest[i]))
            i += len(longest[i])
        elif m := re.match(_NUM, text[i:]):
            out.append(("num", m[0]))
            i += m.end()
        elif text[i] in " .)(;,*":
            i += 1
        else:
            return None
    return out


def reading(text: str) -> tuple | None:
    """(value, scale, unit, per_value, per_unit) of a text that states one positive quantity; unit None where bare.

    None for ranges, sums, negative or zero amounts, several quantities, and words that are no unit.
    """
    rest = _LEAD.sub("", fold(text))
    m = _HEAD.match(rest)
    if not m or (value := number(m["num"])) is None or value <= 0:
        return None
    tokens = _tokens(m["rest"])
    if tokens is None:
        return None
    scale = unit = per_unit = None
    per_value, i = None, 0
    kind = lambda j: ALIASES[tokens[j][1]][0] if j < len(tokens) and tokens[j][0] == "alias" else (tokens[j][0] if j < len(tokens) else "")
    if kind(i) == "scale" and kind(i + 1) in ("iu", "mass", "vol"):
        scale, i = tokens[i][1], i + 1
    if kind(i) == "scale" and tokens[i][1] not in ("m", "k") or kind(i) in ("num", "other", "each", "per", "basis_w", "basis_v"):
        return None
    if i < len(tokens):
        unit, i = tokens[i][1], i + 1
        if ALIASES[unit][0] not in ("mass", "iu", "vol", "pct"):
            return None
    if unit and kind(i) in ("basis_w", "basis_v"):
        per_unit, i = tokens[i][1], i + 1
    elif unit and kind(i) == "per":
        i += 1
        if kind(i) == "num":
            per_value, i = number(tokens[i][1]), i + 1
        if kind(i) not in ("vol", "mass", "each"):
            return None
        per_unit, i = tokens[i][1], i + 1
        if ALIASES[per_unit][0] == "each":
            if per_value not in (None, 1):
                return None
            per_unit = per_value = None
        elif per_value is not None and per_value <= 0:
            return None
    if i < len(tokens):
        return None
    return float(value), scale, unit, None if per_value is None else float(per_value), per_unit


def unit_reading(value: float | None, unit: str | None) -> tuple | None:
    """The reading of a number kept apart from its unit."""
    if value is None or value != value or value <= 0:
        return None
    folded = fold(unit) if isinstance(unit, str) else ""
    if folded in ("", "-", "--", "–"):
        return float(value), None, None, None, None
    # "1" stands for the number; a unit that itself begins with a number ("1000 IU") is a scale
    got = reading(f"1 {folded}")
    return got and (float(value), *got[1:])


def named_reading(value: float, name: str | None) -> tuple | None:
    """The unit that follows the same number in a product's name."""
    if not isinstance(name, str):
        return None
    text = fold(name)
    for m in re.finditer(rf"(?<!\d)(?<!\d[.,])(?:{_NUM})", text):
        if (n := number(m[0])) is None or float(n) != value:
            continue
        tail = text[m.end() :]
        # the longest run of words that reads as a unit
        for end in sorted({len(tail), *(x.start() for x in re.finditer(r"\s", tail))}, reverse=True):
            if tail[:end].strip() and (got := reading(f"{m[0]}{tail[:end]}")) and got[2]:
                return got
    return None


def _read_text(text, name):
    got = reading(text) if isinstance(text, str) else None
    return named_reading(got[0], name) if got and got[2] is None else got


def _read_number(value, unit, name):
    got = unit_reading(value, unit)
    return named_reading(got[0], name) if got and got[2] is None else got


def _frame(rows: list[tuple | None]) -> pd.DataFrame:
    return pd.DataFrame([r or (None,) * 5 for r in rows], columns=READING.names).astype({"value": float, "per_value": float})


@F.pandas_udf(READING)
def read_text(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
    return _frame([_read_text(t, n) for t, n in zip(texts, names)])


@F.pandas_udf(READING)
def read_number(values: pd.Series, units: pd.Series, names: pd.Series) -> pd.DataFrame:
    return _frame([_read_number(v, u if isinstance(u, str) else None, n) for v, u, n in zip(values, units, names)])


def convert(readings: DataFrame, column: str = "_q") -> DataFrame:
    """Joins readings with the factor tables (fixed size, broadcast); adds `unit` and `amount`, rounded to whole units.

    Rows without a reading, without a unit, or whose kinds of units make no common unit are left out.
    """
    spark = readings.sparkSession
    factors = spark.createDataFrame([(a, k, f) for a, (k, f) in ALIASES.items()], "alias string, kind string, factor double")
    targets = spark.createDataFrame([(n, d or "", u) for n, d, u in TARGETS], "num_kind string, per_kind string, unit string")
    q = readings.withColumn("_u", F.col(f"{column}.unit")).where(F.col("_u").isNotNull())
    for role, source in (("u", F.col("_u")), ("s", F.col(f"{column}.scale")), ("p", F.col(f"{column}.per_unit"))):
        side = F.broadcast(factors.select(F.col("alias").alias(f"_{role}_alias"), F.col("kind").alias(f"_{role}_kind"), F.col("factor").alias(f"_{role}_factor")))
        q = q.join(side, source == F.col(f"_{role}_alias"), "left")
    q = q.join(F.broadcast(targets), (F.col("_u_kind") == F.col("num_kind")) & (F.coalesce("_p_kind", F.lit("")) == F.col("per_kind")))
    base = F.when(F.col("per_kind") == "vol", PER_BASE["vol"]).when(F.col("per_kind") == "mass", PER_BASE["mass"])
    per = F.coalesce(F.coalesce(F.col(f"{column}.per_value"), F.lit(1.0)) * F.col("_p_factor") / base, F.lit(1.0))
    top = F.col(f"{column}.value") * F.coalesce("_s_factor", F.lit(1.0)) * F.when(F.col("_u_kind") == "pct", PERCENT).otherwise(F.col("_u_factor"))
    return q.withColumn("amount", F.round(top / per).cast("bigint")).where(F.col("amount") > 0)


def common_strengths(medicines: DataFrame, records: DataFrame) -> DataFrame:
    """src, ref_id, unit, amount of every row that states one convertible positive quantity.

    Nulls, blanks and other measures give no row; repeated rows give one each under their own id.
    """
    spelled = medicines.where(F.col("primary_strength").isNotNull()).select(
        F.lit("medicines").alias("src"), F.col("row_id").alias("ref_id"), read_text("primary_strength", "brand_name").alias("_q")
    )
    numbered = records.where(F.col("strength_value") > 0).select(
        F.lit("medicine_records").alias("src"), F.col("record_id").alias("ref_id"), read_number("strength_value", "strength_unit", "brand").alias("_q")
    )
    return convert(spelled.unionByName(numbered)).select("src", "ref_id", "unit", "amount")


def converted(df: DataFrame, text: str, name: str | Column | None = None) -> DataFrame:
    """All rows of `df` that state a quantity in column `text`, with `unit` and `amount` in place of columns so named."""
    named = F.lit(None).cast("string") if name is None else F.col(name) if isinstance(name, str) else name
    kept = [c for c in df.columns if c not in ("unit", "amount")]
    return convert(df.select(*kept, read_text(F.col(text), named).alias("_q"))).select(*kept, "unit", "amount")
