"""Several values packed in one field: a parsing expression grammar that yields one row per value.

    List       <- Structured / Delimited
    Structured <- '[' Entry (',' Entry)* ','? ']'? End
    Entry      <- Object / String / Bare
    Object     <- '{' String ':' Value (',' String ':' Value)* '}'
    Delimited  <- (Sep / Item)*
    Item       <- Mark? (Quoted / Bracketed / Strength / Char)+
    Quoted     <- '"' [^"]* '"' &(Strength / Sep / End)
    Bracketed  <- '(' (Bracketed / [^()])* ')'

Choices are ordered: each alternative is tried where it stands, and one that fails gives back what it read. A quote
without a partner is thus read as a plain character and flagged, and a broken structured list is read as a delimited
one and flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUES = T.ArrayType(
    T.StructType().add("pos", T.IntegerType()).add("value", T.StringType()).add("kind", T.StringType()).add("error", T.StringType())
)

# Words that stand for an absent list.
ABSENT = {"", "n/a", "na", "nil", "none", "null", "-", "--", "?", "unknown", "not stated", "not given", "see label", "as directed"}

_UNIT = (
    r"(?:mg|mcg|µg|μg|ug|kg|gm|g|iu|i\.u\.|ku|mega\s*units|million\s*(?:iu|units)|(?:lakh|lac|thousand|k)\s*(?:iu|units)"
    r"|units?|u|ml|cc|l|litre|milligrams?|micrograms?|grams?|meq|mmol|%|percent|मि\.ग्रा\.)"
)
_NUMBER = r"\d[\d.,]*"
_PER = rf"(?:\s*(?:/|per)\s*(?:{_NUMBER}\s*)?(?:ml|gm|g|l|mg|tab(?:let)?|cap(?:sule)?|vial|dose|puff|actuation)(?![^\W\d_])\.?)"
STRENGTH = re.compile(rf"{_NUMBER}\s*{_UNIT}(?:(?<=%)|(?<=\.)|(?![^\W\d_])){_PER}?(?:\s*\(?w/[wv]\)?)?", re.I)
_SEP = re.compile(r"\s*(?:&amp;|\|+|[,;+&•·、；，\n\r\t]|\s/\s|/|\s(?:and|AND|And)(?=\s))\s*")
_AND = re.compile(r"(?:and|AND|And)\s+")
_MARK = re.compile(r"(?:\(?\d{1,2}[.)](?=\s)|[-*–](?=\s)|[a-z]\)(?=\s))\s*")
_NUMBERED = re.compile(r"\s+\(?\d{1,2}[.)]\s+(?=[^\W\d_\"(])")
_SPACE = re.compile(r"\s+")
_ESCAPE = re.compile(r"\\(.)", re.S)


def _string(s: str, i: int) -> tuple[str, int] | None:
    quote = s[i] if i < len(s) else ""
    if quote not in ("'", '"'):
        return None
    j = i + 1
    while j < len(s):
        if s[j] == "\\":
            j += 2
        elif s[j] == quote:
            return _ESCAPE.sub(r"\1", s[i + 1 : j]), j + 1
        else:
            j += 1
    return None


def _blank(s: str, i: int) -> int:
    while i < len(s) and s[i].isspace():
        i += 1
    return i


def _word(s: str, i: int) -> tuple[str | None, int]:
    j = i
    while j < len(s) and s[j] not in ",}]":
        j += 1
    bare = s[i:j].strip()
    return (None if bare.lower() in ("none", "null", "") else bare), j


def _object(s: str, i: int) -> tuple[dict[str, str | None], int] | None:
    if i >= len(s) or s[i] != "{":
        return None
    fields: dict[str, str | None] = {}
    i = _blank(s, i + 1)
    while i < len(s) and s[i] != "}":
        if not (key := _string(s, i)):
            return None
        i = _blank(s, key[1])
        if i >= len(s) or s[i] != ":":
            return None
        i = _blank(s, i + 1)
        value = _string(s, i) or _word(s, i)
        fields[key[0].lower()] = value[0]
        i = _blank(s, value[1])
        if i < len(s) and s[i] == ",":
            i = _blank(s, i + 1)
    return (fields, i + 1) if i < len(s) else None


def _structured(s: str) -> tuple[list[tuple[str, str]], list[str]] | None:
    """Entries as (kind, value); None where the text is no such list."""
    i, entries, flags = _blank(s, 0), [], []
    if i >= len(s) or s[i] != "[":
        return None
    i = _blank(s, i + 1)
    while i < len(s) and s[i] != "]":
        if s[i] == "{":
            if (got := _object(s, i)) is None:
                if not entries:
                    return None
                return entries, [*flags, "cut_entry"]
            entries.append(("object", got[0].get("name") or ""))
        elif (got := _string(s, i)) is not None:
            entries.append(("quoted", got[0]))
        elif s[i] in "'\"":
            return None
        else:
            got = _word(s, i)
            entries.append(("bare", got[0] or ""))
        i = _blank(s, got[1])
        if i < len(s) and s[i] == ",":
            i = _blank(s, i + 1)
        elif i < len(s) and s[i] != "]":
            return None
    if i >= len(s):
        flags.append("unclosed_list")
    elif s[i + 1 :].strip(" .;,\n\r\t"):
        return None
    return entries, flags


def _bracketed(s: str, i: int) -> int | None:
    if s[i] != "(":
        return None
    depth = 0
    for j in range(i, len(s)):
        depth += {"(": 1, ")": -1}.get(s[j], 0)
        if not depth:
            return j + 1
    return None


def _separator(s: str, i: int) -> int | None:
    if m := _SEP.match(s, i):
        j = m.end()
        while more := _SEP.match(s, j):
            j = more.end()
        if word := _AND.match(s, j):
            j = word.end()
        return j
    m = _NUMBERED.match(s, i)
    return m.end() if m else None


def _quoted(s: str, i: int) -> int | None:
    if s[i] not in "\"“":
        return None
    j = s.find("”" if s[i] == "“" else '"', i + 1)
    if j < 0:
        return None
    k = _blank(s, j + 1)
    rest = k >= len(s) or _separator(s, j + 1) is not None or STRENGTH.match(s, k) or s[k] in "-(.:"
    return j + 1 if rest else None


def _delimited(s: str) -> tuple[list[tuple[str, str]], list[str]]:
    entries: list[tuple[str, str]] = []
    flags: list[str] = []
    i, start, kind = 0, 0, "bare"
    m = _MARK.match(s, _blank(s, 0))
    if m:
        i = start = m.end()
    while i < len(s):
        if (j := _separator(s, i)) is not None and j > i:
            entries.append((kind, s[start:i]))
            if m := _MARK.match(s, j):
                j = m.end()
            i, start, kind = j, j, "bare"
        elif s[i] in '"“' and s[start:i].strip() == "" and (j := _quoted(s, i)) is not None:
            i, kind = j, "quoted"
        elif (j := _bracketed(s, i)) is not None:
            i, kind = j, kind if kind == "quoted" else "bracketed"
        elif s[i].isdigit() and (i == 0 or not s[i - 1].isalnum()) and (m := STRENGTH.match(s, i)):
            i = m.end()
        else:
            if s[i] in '"“”':
                flags.append("stray_quote")
            if s[i] == "(":
                flags.append("unclosed_bracket")
            i += 1
    entries.append((kind, s[start:]))
    return entries, flags


def value_name(raw: str) -> str:
    """The name alone: no strength, list mark or enclosing quotes; lower-case, single spaces."""
    name = _SPACE.sub(" ", raw).strip()
    while True:
        before = name
        if len(name) > 1 and name[0] in "\"“" and name[-1] in "\"”":
            name = name[1:-1].strip()
        if m := _MARK.match(name):
            name = name[m.end() :]
        name = name.strip(" .;,:|+&•").strip()
        if m := re.search(r"\(([^()]*)\)$", name):
            inner = m[1].strip()
            if STRENGTH.fullmatch(inner) or not inner:
                name = name[: m.start()]
        if m := re.search(rf"(?<![^\W_])(?:{STRENGTH.pattern})$", name, re.I):
            name = name[: m.start()]
        name = re.sub(r"\s[-–—:=]+\s*$|[-–—:=]+$", "", name.strip()).strip()
        if name.count('"') == 1:
            name = name.replace('"', "").strip()
        if name == before:
            return name.lower()


def split_packed(text: str | None) -> list[dict]:
    """Values of one field, counted from 1 in the written order; empty slots are skipped and not counted."""
    if text is None or text.strip().lower() in ABSENT:
        return []
    flags: list[str] = []
    parsed = _structured(text)
    if parsed is None:
        if text.lstrip().startswith("[{"):
            flags.append("broken_structure")
        parsed = _delimited(text.strip().strip("[]") if text.lstrip().startswith("[") else text)
    entries, more = parsed
    out: list[dict] = []
    flag = ",".join(sorted({*flags, *more})) or None
    for kind, raw in entries:
        name = _SPACE.sub(" ", raw).strip().lower() if kind == "object" else value_name(raw)
        if name and name not in ABSENT:
            out.append({"pos": len(out) + 1, "value": name, "kind": kind, "error": flag})
    return out


@F.pandas_udf(VALUES)
def packed_values(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: split_packed(t if isinstance(t, str) else None))


def explode_packed(df: DataFrame, field: str | Column, keep: list[str]) -> DataFrame:
    """One row per packed value: the `keep` columns, then pos, value, kind and error (null where the text is sound).

    Null, empty and blank fields and fields that hold an absence mark give no row. Repeated values stay, each with its
    own position. An input column named pos, value, kind or error that is not in `keep` does not disturb the result;
    one that is in `keep` is a ValueError.
    """
    if clash := {"pos", "value", "kind", "error"} & set(keep):
        raise ValueError(f"columns clash with the result: {sorted(clash)}")
    column = F.col(field) if isinstance(field, str) else field
    return df.select(*keep, F.explode(packed_values(column)).alias("_v")).select(*keep, "_v.*")


def listed_ingredients(medicines: DataFrame) -> DataFrame:
    """Every ingredient of every row that lists two or more: row_id, pos, ingredient."""
    rows = medicines.where(F.col("active_ingredients").isNotNull()).select("row_id", packed_values("active_ingredients").alias("_vs"))
    return (
        rows.where(F.size("_vs") >= 2)
        .select("row_id", F.explode("_vs").alias("_v"))
        .select("row_id", F.col("_v.pos").alias("pos"), F.col("_v.value").alias("ingredient"))
    )


def iter_values(texts: Iterator[str]) -> Iterator[list[dict]]:
    """The grammar outside Spark, for tests."""
    return map(split_packed, texts)
