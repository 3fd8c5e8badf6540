"""Personal information in free text: detection, typed placeholders and keyed surrogates.

Detection runs over whole texts in Arrow batches. Surrogates are keyed and type-consistent: a value has the same one in
every document (coreference), two values never share one and none equals a value of the corpus (the collision check,
which draws again with a higher attempt until none is left). A name's parts are replaced each, by names of the same
gender and script, so "Narvi Tororuthal", "Tororuthal, Narvi" and "N. Tororuthal" stay one person; of an address house,
street, place and PIN are replaced, and only its general words ("House No.", "Street", "near") stay; numbers keep their
length, separators, prefix and script; letters keep their case. Names are found by `names`.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mimansa.llm import names as people
from mimansa.plans.support import checkpointed, hot_safe_join

# Words before a number that make it no personal one.
NOT_ID = re.compile(r"(?:payment|bank|reference|ref|strip|batch|lot|invoice|circular|order|receipt|transaction|txn|scheme|bill|tender|account|serial)\b[^\n]{0,24}$|(?:\b(?:rs\.?|inr)|₹|[#&])\s*$", re.I)
NOT_PHONE = re.compile(r"(?:toll[- ]?free|invoice|reference|batch|code|circular|payment|order|receipt|strip|pin)\b[^\n]{0,16}$|(?:\b(?:rs\.?|inr)|₹|#)\s*$", re.I)

_AT, _DOT = r"(?:\s?[@＠]\s?|\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+)", r"(?:\s?\.\s?(?=[A-Za-z])|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?"
EMAIL_PLAIN = re.compile(rf"(?<![\w.+-]){_LOCAL}\s?[@＠]\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.A)
EMAIL_SPOKEN = re.compile(rf"(?<![\w.+-]){_LOCAL}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_DIGITS = re.compile(r"(?<![\w.,-])(?<!\d/)(?:\+|\(\+?)?\d(?:[ .() -]{0,2}\d){9,13}(?![\w])(?![.,/-]\d)")
ID_LETTERS = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z]{5}[ -]?\d{4}[ -]?[A-Za-z]|[A-Za-z]{3}[ /-]?\d{7})(?![A-Za-z0-9])")
# A card's or file's word right before a number, and words that start no such number when in lower case.
_CARD = re.compile(r"\b(?:card|passport|file|id|pan|number|no\.?)\b\s*(?:(?:number|no\.?|is|hai)\b\s*)?[:=#-]?\s*$", re.I)
_LABELS = {"ref", "lot", "txn", "inr", "inv", "tel", "mob", "pin", "fax"}
_PROSE = {"about", "after", "april", "august", "since", "until", "march", "early", "later", "under", "above", "below", "dated", "issue", "valid", "for", "was", "and", "the", "num", "nos", "has", "had", "not", "are", "but"}
_HOUSE = r"(?:(?:House|H\.?|Plot|Flat|Door|Shop|Room|Quarter)\s*(?:No\.?|#)?\s*[A-Z]?-?\d+[A-Z]?(?:/\d+)?|(?<![\w/.-])[A-Z]-\d+(?:/\d+)?|(?<![\w/.,-])\d{1,4}(?:/\d+)?[A-Z]?)"
# Words of a street, as they are written.
STREETS = ["Street", "Road", "Marg", "Gali", "Lane", "Path", "Avenue", "Cross", "Sadak", "STREET", "ROAD", "MARG", "GALI", "LANE", "street", "road", "marg", "gali", "lane"]
_STREET = re.compile(rf"\b(?:{'|'.join(STREETS)})\b")
_SPOKEN = re.compile(r"(?<![A-Za-z])(?:dot|DOT|Dot)(?![A-Za-z])|[\[({<]\s?(?:at|AT)\s?[\])}>]")
_DOT_WORDS, _AT_WORDS, _STREET_WORDS = {b"dot", b"DOT", b"Dot"}, {b"at", b"AT"}, {x.encode() for x in STREETS}
_RUN = re.compile(rb"[0-9]{4,}+")
#: All digits as 0.
_ZEROS = bytes(48 if 48 <= c < 58 else c for c in range(256))
#: The longest stretches that can hold a number of ten digits or more.
_STRETCH, _TEN = re.compile(r"[0-9](?:[ .() -]{0,2}[0-9]){9,}+"), b"0" * 10
ADDRESS = re.compile(rf"{_HOUSE},?\s+(?:[^\s,]+\s+){{1,4}}?(?:Street|Road|Marg|Gali|Lane|Path|Avenue|Cross|Sadak)\b(?:[^\n।]|\n(?!\n)){{0,110}}?(?<![\d/])(\d{{3}}\s?\d{{3}})(?![,/]?\d)", re.I)

#: Characters of texts whose words are held at once.
SLICE_CHARS = 1 << 21

ENTITY = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("kind", T.StringType()).add("val", T.StringType())
ENTITIES = T.ArrayType(ENTITY)


#: Characters by their code that have not been met, or have an ASCII one; and those that have one. Codes of pairs stay open.
_OPEN = np.arange(1 << 16) > 127
_PLAIN: dict[str, str] = {}


def _plain(text: str) -> str:
    """Digits and signs of other scripts and widths as ASCII, one character for one."""
    if text.isascii():
        return text
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    some = codes[_OPEN[codes]]
    if not len(some):
        return text
    for c in map(chr, set(some.tolist())) if len(codes) == len(text) else set(text):
        if c not in _PLAIN and ord(c) > 127:
            d = unicodedata.decimal(c, None)
            if d is not None:
                _PLAIN[c] = str(d)
            elif unicodedata.category(c) == "Pd":
                _PLAIN[c] = "-"
            elif c in "＋＠．（）":
                _PLAIN[c] = unicodedata.normalize("NFKC", c)
            elif ord(c) < 0xD800 or 0xDFFF < ord(c) < 1 << 16:
                _OPEN[ord(c)] = False
        if c in _PLAIN:
            text = text.replace(c, _PLAIN[c])
    return text


def _around(pattern: re.Pattern, text: str, places: list[tuple[int, int]], before: int, after: int) -> list[re.Match]:
    """Matches of a pattern in the stretches around some places, each stretch widened to whole words and searched once."""
    out, at = [], 0
    stretches: list[list[int]] = []
    for a, b in places:
        a, b = max(0, a - before), min(len(text), b + after)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    for a, b in stretches:
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        at = max(at, a)
        while at < b and (m := pattern.search(text, at, b)):
            out.append(m)
            at = max(m.end(), m.start() + 1)
    return out


def _id_starts(flat: bytes) -> Iterator[int]:
    """Where a number of letters and digits can begin: five letters before four digits in a row, or three before seven."""
    zeros = flat.translate(_ZEROS)
    a = zeros.find(b"0000")
    while a >= 0:
        b = _RUN.match(flat, a).end()
        start = a - {4: 5, 7: 3}.get(b - a, a + 1)
        if start >= 0:
            # a sign may stand between them
            start -= not flat[a - 1 : a].isalpha()
        if start >= 0:
            yield start
        a = zeros.find(b"0000", b)


def _number(text: str, m: re.Match) -> tuple[str, str] | None:
    raw, digits = m[0], re.sub(r"\D", "", m[0])
    before = text[max(0, m.start() - 40) : m.start()]
    groups = [len(g) for g in re.findall(r"\d+", raw)]
    n = len(digits)
    fours = groups in ([4, 4, 4], [2, 4, 4, 4], [12], [14]) and not raw.startswith("+")
    if n == 12 and digits[:2] == "91" and digits[2] in "56789" and (raw[0] in "+(" or groups[0] == 2 or groups == [12] and re.search(r"(?:mob|ph|tel|call|phone|whatsapp|mobile|alt|on|contact)\W*$", before, re.I)):
        return None if NOT_PHONE.search(before) else ("phone", digits[-10:])
    if n in (12, 14) and fours:
        return None if NOT_ID.search(before) else ("id", digits)
    if n == 10 and digits[0] in "56789" or n == 11 and digits[0] == "0" and digits[1] in "56789":
        return None if NOT_PHONE.search(before) or NOT_ID.search(before) else ("phone", digits[-10:])
    if n in (13, 14) and digits[:4] in ("0091", "0910") and digits[-10] in "56789":
        return "phone", digits[-10:]
    return None


def _lettered(raw: str, before: str) -> bool:
    """Whether letters and digits are one number: prose in lower case ("since 2019 a") is none, nor are "ref" and its like."""
    letters = "".join(c for c in raw if c.isalpha())
    if letters.isupper():
        return True
    word = re.match("[A-Za-z]+", raw)[0].lower()
    if word in _LABELS:
        return False
    return " " not in raw or word not in _PROSE and bool(_CARD.search(before))


def entities(text: str | None, scores: people.Scores | None = None, words: set[bytes] | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, val) of a text, in order, without overlaps; an address spans from the house to the PIN.

    `scores` holds the odds of the words; without it those of the common names alone. `words` are those of the text, if they are there.
    """
    if not text:
        return []
    plain = _plain(text)
    flat = people.flattened(plain)
    words = people.words_of(flat) if words is None else words
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def add(a: int, b: int, kind: str, val: str) -> None:
        found.append((a, b, kind, val))
        taken.append((a, b))

    # each pattern is tried only where a sign or word that it needs stands
    ats = [(k, k + 1) for k in people.places(flat, b"@")]
    for m in _around(EMAIL_PLAIN, plain, ats, 60, 60):
        add(m.start(), m.end(), "email", re.sub(r"\s", "", m[0]).replace("＠", "@").lower())
    spoken = [k for w in words & _DOT_WORDS for k in people.places(flat, w)]
    if not words.isdisjoint(_AT_WORDS):
        spoken += [k for c in (b"[", b"(", b"{", b"<") for k in people.places(flat, c)]
    dots = [m.span() for m in people.matches(_SPOKEN, plain, spoken)]
    for m in _around(EMAIL_SPOKEN, plain, dots, 90, 60):
        # a bare "at" is a word, so it needs a spoken dot
        if not free(m.start(), m.end()) or not re.search(r"\bdot\b|[\[({<]\s*at\s*[\])}>]", m[0], re.I):
            continue
        val = re.sub(r"\s*[\[({<]?\s*\bdot\b\s*[\])}>]?\s*", ".", re.sub(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+", "@", m[0], flags=re.I), flags=re.I)
        add(m.start(), m.end(), "email", re.sub(r"\s", "", val).lower())
    streets = [m.span() for m in people.matches(_STREET, plain, [k for w in words & _STREET_WORDS for k in people.places(flat, w)])]
    for m in _around(ADDRESS, plain, streets, 80, 180):
        if free(m.start(), m.end()):
            add(m.start(), m.end(), "address", re.sub(r"\D", "", m[1]))
    for m in people.matches(ID_LETTERS, plain, _id_starts(flat)):
        before = plain[max(0, m.start() - 40) : m.start()]
        if free(m.start(), m.end()) and not NOT_ID.search(before) and _lettered(m[0], before):
            add(m.start(), m.end(), "id", re.sub(r"[^A-Z0-9]", "", m[0].upper()))
    for stretch in _STRETCH.finditer(plain) if _TEN in flat.translate(_ZEROS, b" .()-") else ():
        # a sign and a bracket may stand before it, and what follows it is looked at
        for m in _DIGITS.finditer(plain, max(0, stretch.start() - 2), stretch.end() + 2):
            if free(m.start(), m.end()) and (got := _number(plain, m)):
                add(m.start(), m.end(), *got)
    for a, b in people.mentions(text, scores or people.Scores(people.seeded(), [text]), flat, words):
        if free(a, b):
            add(a, b, "name", name_value(text[a:b]))
    return sorted(found)


def name_value(raw: str) -> str:
    """A name as it stands, in small letters, letters and their marks alone, single spaces."""
    return " ".join(w for w in re.split(r"[\s.,]+", raw.lower()) if w)


def _slices(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in their order, in lists that end where they have SLICE_CHARS characters."""
    some, chars = [], 0
    for t in texts:
        some.append(t)
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield some
            some, chars = [], 0
    yield some


def _entities(texts: list[str | None], scores: people.Scores) -> list[list[tuple[int, int, str, str]]]:
    """The entities of each text, which is cut into words once, for the scores and the search."""
    words = [people.words_of(people.flattened(t or "")) for t in texts]
    scores.add(set().union(*words))
    return [entities(t, scores, w) for t, w in zip(texts, words)]


def entities_of(docs: DataFrame, model: people.NameModel, text: str = "text") -> Column:
    """The entities of every text as a column; a word is scored once for as long as it is held."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(ENTITIES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = people.Scores(shared.value)
        for texts in batches:
            yield pd.Series([e for some in _slices(texts) for e in _entities(some, scores)], dtype=object)

    # else a filter on the entities is pushed below them, which finds them twice
    return find.asNondeterministic()(F.col(text))


def detect(docs: DataFrame, doc: str = "doc_id", text: str = "text", model: people.NameModel | None = None) -> DataFrame:
    """doc_id, start, end, kind, val: one row for each mention. Null, empty and blank texts have none."""
    found_ = entities_of(docs, model or people.trained(docs, text), text)
    some = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), found_.alias("_e"))
    return some.where(F.size("_e") > 0).select("doc_id", F.explode("_e").alias("_e")).select("doc_id", "_e.*")


def found(docs: DataFrame, model: people.NameModel | None = None) -> DataFrame:
    """doc_id, kind, val, distinct. Mentions are made distinct within their document, which no shuffle needs to gather."""
    found_ = entities_of(docs, model or people.trained(docs))
    some = docs.where(F.col("text").isNotNull()).select("doc_id", found_.alias("_e")).where(F.size("_e") > 0)
    kinds = F.array_distinct(F.transform("_e", lambda e: F.struct(e["kind"].alias("kind"), e["val"].alias("val"))))
    return some.select("doc_id", F.explode(kinds).alias("_k")).select("doc_id", "_k.*")


# --- surrogates -----------------------------------------------------------------------------------------------------


# General words of an address, which tell of no place.
GENERAL = set(
    """house h plot flat door shop room quarter no number street road marg gali lane path avenue cross sadak near opp opposite behind beside next to ward block sector floor phase stage main
    post office p o po pin code pincode dist district tehsil taluk village town city at and of the temple school market bus stand station hospital clinic ji state india""".split()
)
# Consonants and vowel signs of other scripts, by the first and last code point of their block.
SCRIPTS = {(0x900, 0x97F): ("कगजतदनपबमरलवसह", "ािीुेो"), (0x980, 0x9FF): ("কগজতদনপবমরলসহ", "ািীুেো"), (0xB80, 0xBFF): ("கசதநபமரலவ", "ாிீுேோ")}
# Endings of made-up names and places.
ENDINGS = {"women": ["ika", "ini", "isha", "iya"], "men": ["esh", "ant", "ul", "dev"], "family": ["ar", "an", "ath", "ur"], "place": ["pur", "nagar", "ganj", "garh"]}
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[\u0900-\u0BFF\u200C\u200D])*")
_PIN = re.compile(r"\d{3}\s?\d{3}$")


def gender(word: str) -> str:
    """women or men: listed names by the list, other given names by their last letter."""
    if word in people.MEN or word in people.WOMEN:
        return "women" if word in people.WOMEN else "men"
    return "women" if word[-1:] in tuple("aiािী") or word[-2:] in ("ee", "ah") else "men"


def address_parts(raw: str) -> list[tuple[int, int, str, str]]:
    """(start, end, part kind, part) of all in an address that tells where it is; the PIN ends it."""
    pin = _PIN.search(_plain(raw))
    stop = pin.start() if pin else len(raw)
    out = []
    for m in _TOKEN.finditer(raw, 0, stop):
        low = m[0].lower()
        if any(c.isdigit() for c in low):
            out.append((m.start(), m.end(), "house", _plain(low)))
        elif low not in GENERAL:
            out.append((m.start(), m.end(), "place", low))
    return [*out, (stop, len(raw), "address", re.sub(r"\D", "", pin[0]))] if pin else out


def parts_of(kind: str, val: str, raw: str) -> list[tuple[str, str]]:
    """The parts of a mention that are replaced each: names and addresses by word, anything else whole."""
    if kind == "name":
        return [("name", word) for word in val.split() if len(word) > 1]
    if kind == "address":
        return [(k, v) for _, _, k, v in address_parts(raw)]
    return [(kind, val)]


def _stream(key: str, *what: object):
    block = n = 0
    while True:
        block = hmac.new(key.encode(), "\x1f".join(map(str, (*what, n))).encode(), hashlib.sha256).digest()
        yield from block
        n += 1


def _letter(key: str, letter: str) -> str:
    """A keyed permutation of the alphabet."""
    order = sorted("abcdefghijklmnopqrstuvwxyz", key=lambda c: hmac.new(key.encode(), c.encode(), hashlib.sha256).digest())
    return order[ord(letter) - 97] if "a" <= letter <= "z" else letter


def _word_like(key: str, kind: str, val: str, draw) -> str:
    """A made-up word: the keyed first letter, so initials stay with their name, five drawn ones and an ending."""
    for (a, b), (consonants, signs) in SCRIPTS.items():
        if a <= ord(val[0]) <= b:
            return "".join(consonants[next(draw) % len(consonants)] + signs[next(draw) % len(signs)] for _ in range(4))
    vowels, consonants = "aeiou", "bdghjklmnprstvz"
    middle = "".join((vowels if i % 2 == 0 else consonants)[next(draw) % (5 if i % 2 == 0 else 15)] for i in range(4))
    endings = ENDINGS["place" if kind == "place" else "family" if val in people.FAMILY else gender(val)]
    return _letter(key, val[0]) + middle + endings[next(draw) % len(endings)]


def surrogate(key: str, kind: str, val: str, attempt: int) -> str:
    draw = _stream(key, kind, val, attempt)
    if kind in ("name", "place"):
        return _word_like(key, kind, val, draw)
    if kind == "email":
        return "user" + "".join("abcdefghijklmnopqrstuvwxyz"[next(draw) % 26] for _ in range(10)) + "@masked.invalid"
    if kind == "house":
        # few numbers are as short as a house's, so a drawn one has a digit more for each four attempts
        return str(1 + next(draw) % 9) + "".join(str(next(draw) % 10) for _ in range(2 + attempt // 4)) + "".join(c for c in val if c.isalpha())[:1]
    out = []
    for i, c in enumerate(val):
        if c.isdigit():
            out.append(val[i] if kind == "phone" and i == 0 else str(next(draw) % 10))
        else:
            out.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ"[next(draw) % 26])
    return "".join(out)


def surrogate_table(parts: DataFrame, key: str) -> DataFrame:
    """part_kind, part, surrogate, n of every part_kind and part, without collisions among surrogates or with real values.

    `n` is the number of rows that `parts` has of the part.
    """

    @F.pandas_udf(T.StringType())
    def draw(kinds: pd.Series, vals: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, int(a)) for k, v, a in zip(kinds, vals, attempts)], dtype=object)

    real = checkpointed(parts.groupBy("part_kind", "part").agg(F.count("*").alias("n")))
    open_, done = real.select("part_kind", "part", F.lit(0).alias("attempt")), None
    while True:
        drawn = checkpointed(open_.withColumn("surrogate", draw("part_kind", "part", "attempt")))
        best = drawn.groupBy("part_kind", "surrogate").agg(F.min("part").alias("part"))
        good = best.join(real.select("part_kind", F.col("part").alias("surrogate")), ["part_kind", "surrogate"], "left_anti")
        if done is not None:
            good = good.join(done.select("part_kind", "surrogate"), ["part_kind", "surrogate"], "left_anti")
        good = checkpointed(good.select("part_kind", "part", "surrogate"))
        done = good if done is None else done.unionByName(good)
        open_ = drawn.select("part_kind", "part", "attempt").join(good, ["part_kind", "part"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        open_ = checkpointed(open_)
        if open_.isEmpty():
            return done.join(real, ["part_kind", "part"])


def _render(raw: str, kind: str, replace: dict[tuple[str, str], str], val: str, key: str) -> str:
    """The mention with its surrogate in it, in the written format."""
    if kind == "name":

        def word(m: re.Match) -> str:
            w = m[0].lower()
            new = _letter(key, w) if len(w) == 1 else replace[("name", w)]
            return new.upper() if m[0].isupper() else new.capitalize() if m[0][0].isupper() else new

        return re.sub(r"[^\s.,]+", word, raw)
    if kind == "address":
        out, last = [], 0
        for a, b, part_kind, part in address_parts(raw):
            new, old = replace[(part_kind, part)], raw[a:b]
            if part_kind == "address":
                new = _digits_into(old, new)
            elif part_kind == "place":
                new = new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[0].isupper() else new
            else:
                new = new.upper() if any(c.isupper() for c in old) else new
            out += [raw[last:a], new]
            last = b
        return "".join([*out, raw[last:]])
    new = replace[(kind, val)]
    if kind == "email":
        return new.upper() if raw.isupper() else new
    return _digits_into(raw, new, letters=kind == "id")


def _digits_into(raw: str, new: str, letters: bool = False) -> str:
    """The signs of `new` in the places of the last digits (and letters) of `raw`, in their script and case."""
    chars, out = list(new), []
    at = set([i for i, c in enumerate(raw) if c.isdigit() or letters and c.isascii() and c.isalpha()][-len(chars) :])
    for i, c in enumerate(raw):
        if i in at:
            n = chars.pop(0)
            zero = ord(c) - unicodedata.decimal(c) if c.isdigit() else 0
            out.append(chr(zero + int(n)) if c.isdigit() and n.isdigit() else n.lower() if c.islower() else n)
        else:
            out.append(c)
    return "".join(out)


def redacted(docs: DataFrame, key: str, doc: str = "doc_id", text: str = "text", model: people.NameModel | None = None) -> DataFrame:
    """doc_id, placeholders, surrogates: each text with typed placeholders, and with keyed surrogates, for its mentions.

    Texts without mentions come out as they are, null as null. `doc` must be unique.
    """
    found_ = entities_of(docs, model or people.trained(docs, text), text)
    cut = checkpointed(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), found_.alias("_e")))
    some = cut.where(F.size("_e") > 0)

    @F.pandas_udf("array<struct<part_kind:string,part:string>>")
    def parts(texts: pd.Series, es: pd.Series) -> pd.Series:
        return pd.Series([sorted({p for e in rows for p in parts_of(e["kind"], e["val"], t[e["start"] : e["end"]])}) for t, rows in zip(texts, es)])

    @F.pandas_udf("struct<placeholders:string,surrogates:string>")
    def rebuild(texts: pd.Series, es: pd.Series, pairs: pd.Series) -> pd.DataFrame:
        rows = []
        for t, e, p in zip(texts, es, pairs):
            replace = {(x["part_kind"], x["part"]): x["surrogate"] for x in p}
            a, b, last = [], [], 0
            for x in sorted(e, key=lambda x: x["start"]):
                kept = t[last : x["start"]]
                a += [kept, f"<{x['kind'].upper()}>"]
                b += [kept, _render(t[x["start"] : x["end"]], x["kind"], replace, x["val"], key)]
                last = x["end"]
            rows.append(("".join([*a, t[last:]]), "".join([*b, t[last:]])))
        return pd.DataFrame(rows, columns=["placeholders", "surrogates"])

    each = some.select("doc_id", F.explode(parts("text", "_e")).alias("p")).select("doc_id", "p.*")
    # a name or town may stand in a third of all texts, so parts go by their counted rows
    pairs = hot_safe_join(each, surrogate_table(each, key), ["part_kind", "part"], "n")
    per_doc = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("part_kind", "part", "surrogate")).alias("_p"))
    new = some.join(per_doc, "doc_id").select("doc_id", rebuild("text", "_e", "_p").alias("r")).select("doc_id", "r.*")
    rest = cut.where(~(F.coalesce(F.size("_e"), F.lit(0)) > 0)).select("doc_id", F.col("text").alias("placeholders"), F.col("text").alias("surrogates"))
    return new.unionByName(rest)
