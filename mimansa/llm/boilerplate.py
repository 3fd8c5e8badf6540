"""Main content of web pages by line-block distribution.

Markup is stripped and every line gets a mass: its text length, or nothing where the line stands outside the body by its
odds. The odds are those of `lines`, a model that the line-block distribution of the corpus teaches, without any given
wording; where they leave a line open, a list of phrases refines them. Masses are summed over sliding windows of lines.
The content begins at the first surge, where a window holds SURGE characters, and ends at the last dive, after which no
window does; text between them is kept. Lines short of mass at either edge join the content as the page's heading, a
list or a table that touches it; furniture between surge and dive is cut out by the same odds that gave it no mass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mimansa.llm import lines as block

WINDOW, SURGE = 3, 60
#: Log odds from which a line stands outside the body. Sentences are what a body is made of and have far lower odds in it
#: than other lines, entries of lists and tables stand at its edges too, and so does a heading, which is let go last.
SENTENCE, OUTSIDE, LISTED, HEADING = -1.2, 0.9, 1.6, 2.6
#: Log odds down to which the phrases are asked.
OPEN = -4.0
#: Characters scored at once in a worker.
CHUNK_CHARS = 1_000_000

# Entries of site menus, and words of cookie notes, bylines, prompts, notices, counters and footers.
MENU = (
    "home|about us|about|contact|contact us|downloads?|hospitals?|medicines?|schemes?|english|hindi|हिन्दी|हिंदी|मराठी|বাংলা|தமிழ்|rti|faqs?|site ?map|careers?|tenders?|gallery"
    "|feedback|login|log in|register|search|skip to main content|skip to content|skip navigation|archive|help|accessibility statement|terms of use|privacy policy|hyperlink policy"
    "|back to top|top|menu|news|events|services|media|press|blog|forum|notifications?|circulars?|accept all|reject|accept|print|save|share|send to a friend|yes|no|मुखपृष्ठ|होम|संपर्क"
)
# All are matched against lower-cased lines. STARTS: what a furniture line begins with, or the whole line where it says $.
STARTS = (
    # bylines and dates
    r"(?:by|from) the .{2,60}\b(?:desk|team|bureau|staff)$|(?:written|compiled|edited|reported|prepared) (?:for|by) |reviewed by |updated (?:on|:)|(?:posted|published) on\b|(?:version|revision)\b.{0,12}\d"
    # share and subscription prompts
    r"|share (?:this|on|via)|follow .{2,60}\b(?:updates|us|on)\b|subscribe\b|sign up\b|print\b.{0,12}[|/]"
    # links to other pages, with their headings
    r"|(?:related|previous|next|also read|read also|read more|see also|you may also like|sponsored|advertisement|more like this|recommended)\s*[:\-–—]|»|(?:quick links|trending now|more from|related (?:articles|links|stories)|most (?:read|popular)|latest (?:news|posts)|popular posts|in this section|recommended)\b.{0,30}$"
    r"|(?:यह भी पढ़ें|अगला|पिछला|संबंधित|और पढ़ें|पुढील|मागील|हेही वाचा|संबंधित लेख|আরও পড়ুন|পরবর্তী|পূর্ববর্তী|সম্পর্কিত|மேலும் படிக்க|அடுத்து|முந்தைய|தொடர்புடைய)(?:\s*[:\-–—]|$)|संबंधित लेख|(?:संबंधित|সম্পর্কিত|தொடர்புடைய)\s+\S+$"
    # breadcrumbs
    r"|you are here\b|(?:home|मुखपृष्ठ|होम|প্রচ্ছদ|முகப்பு)\s*(?:>|»|/|›)"
    # notices and footers
    r"|copyright\b|about us\s*[:\-]|helpline\b|disclaimer"
)
# Phrases that stand anywhere in a furniture line; the first of each pair is a piece that every match holds.
ANYWHERE = [
    ("cookie", r"\bcookies? (?:to|policy|settings|notice)\b|\b(?:use|uses|keeps?|stores?|sets?) cookies"), ("small files", r"small files on your device"), ("session files", r"browser keeps session files"),
    ("you agree", r"by (?:staying|continuing|using)\b.{0,40}\byou agree"), ("accept all", r"accept all"), ("कुकी", r"कुकीज़?"),
    ("staff report", r"\bstaff reporters?\b"), ("editorial cell", r"editorial cell"), ("content board", r"content board"), ("web desk", r"web desk"),
    ("last ", r"\blast (?:updated|reviewed|modified)\b"), ("form revision", r"form revision"), ("वेब टीम", r"वेब टीम"), ("संपादकीय", r"संपादकीय"), ("अंतिम बार", r"अंतिम बार अपडेट"), ("संपादन मंडळ", r"संपादन मंडळ"),
    ("like what you read", r"like what you read"), ("tell your friends", r"tell your friends"), ("newsletter", r"\bnewsletter\b"), ("our app", r"download our app|our app from"), ("alerts", r"\bget alerts\b|\balerts$"),
    ("mobile number to", r"mobile number to get"), ("send to a friend", r"send to a friend"), ("to advertise", r"to advertise"), ("sales team", r"sales team"), ("printed edition", r"printed edition"),
    ("साझा करें", r"साझा करें"), ("शेयर करें", r"शेयर करें"), ("सदस्यता लें", r"सदस्यता लें"), ("ऐप डाउनलोड", r"ऐप डाउनलोड"), ("से जुड़ने के लिए", r"से जुड़ने के लिए"), ("अ‍ॅप डाउनलोड", r"अ‍ॅप डाउनलोड"), ("শেয়ার করুন", r"শেয়ার করুন"), ("பகிர", r"பகிர"),
    ("comment", r"\d+ comments?\b|post a comment|leave a comment"), ("be the first to", r"be the first to"), ("leave a reply", r"leave a reply"), ("log in to", r"log in to"), ("was this", r"was this (?:page|information|article) (?:helpful|useful)"),
    ("rate this", r"rate this"), ("टिप्पणी", r"टिप्पणी"),
    ("©", r"©\s*\d{4}"), ("(c)", r"\(c\)\s*\d{4}"), ("rights reserved", r"all rights reserved"), ("designed ", r"designed (?:and \w+ )?by\b"), ("hosted by", r"hosted by\b"), ("developed ", r"developed (?:and \w+ )?by\b"), ("maintained by", r"maintained by\b"),
    ("powered by", r"powered by\b"), ("best viewed", r"best viewed"), ("accessibility statement", r"accessibility statement"), ("terms of use", r"terms of use"), ("privacy policy", r"privacy policy"), ("hyperlink policy", r"hyperlink policy"), ("content owned", r"content owned"),
    ("written permission", r"written permission"), ("no liability", r"accepts? no liability"), ("on this site", r"on this site is|information on this site"), ("on this portal", r"on this portal is|information on this portal"), ("on this website", r"on this website is|information on this website"),
    ("does not replace advice", r"does not replace advice"), ("may change without notice", r"may change without notice"), ("private initiative", r"private initiative"), ("in no way connected", r"in no way connected"), ("was set up to", r"was set up to"), ("run by volunteers", r"run by volunteers"),
    ("visitor", r"visitors? (?:so far|number|count)|you are visitor"), ("helpline of", r"helpline of"), ("back to top", r"back to top"), ("these pages", r"(?:of|on) these pages"),
    ("पूरी सामग्री", r"पूरी सामग्री"), ("लिखित अनुमति", r"लिखित अनुमति"), ("की संपत्ति", r"की संपत्ति"), ("सर्वाधिकार", r"सर्वाधिकार"), ("कॉपीराइट", r"कॉपीराइट"), ("हेल्पलाइन", r"हेल्पलाइन"), ("सर्व हक्क", r"सर्व हक्क"), ("স্বত্ব", r"স্বত্ব"), ("காப்புரிமை", r"காப்புரிமை"),
]


def _pieces() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for piece, phrase in ANYWHERE:
        found.add_word(piece, re.compile(phrase))
    found.make_automaton()
    return found


_PIECES = _pieces()
_STARTS = re.compile(STARTS)
_MENU = re.compile(rf"(?:\W*(?:{MENU})(?!\w))+\W*")
_BULLET = re.compile(r"(?:[-*•·–▪◦]|\(?\d{1,3}[.)]|[a-z][.)])\s+\S", re.I)
_ROW = re.compile(r"\S\s*\|\s*\S.*\|\s*\S|\S\s+[-:]\s+\S.*\S\s+[-:]\s+\S|\t\S")
_TAG = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->|</?[a-zA-Z][^<>\n]*>", re.S)
#: Lines that name a site's owner, with the name behind.
_OWNER = re.compile(r"(?:©|\(c\)|copyright)\s*\d{4}\s+([^,|.]{4,60})|(?:powered|designed and hosted|content owned|designed|hosted|maintained) by\s+([^,|.]{4,60}?)(?:\s+web services)?$|helpline of\s+([^:,|.]{4,60})|visitor number \d+ of\s+([^,|.]{4,60})|last reviewed on \S+ by\s+([^,|.]{4,60})")


def lines_of(text: str) -> list[str]:
    """Lines between line feeds, without markup; spaces folded, ends trimmed."""
    if "<" in text:
        text = _TAG.sub(lambda m: "\n" * m[0].count("\n"), text)
    if "&" in text:
        text = html.unescape(text)
    return [" ".join(line.split()) for line in text.split("\n")]


def said_by_furniture(low: str) -> bool:
    """Whether a lower-cased line is furniture by its words; phrases are looked for where one of their pieces stands."""
    return _STARTS.match(low) is not None or any(phrase.search(low) for _, phrase in _PIECES.iter(low)) or len(low) < 300 and _MENU.fullmatch(low) is not None


def is_sentence(line: str) -> bool:
    return line.rstrip("\"'”’»)]")[-1:] in tuple(".?!।॥…:;") and line != ""


def site_names(lines: list[str]) -> set[str]:
    return {next(g for g in m.groups() if g).strip() for line in lines if (m := _OWNER.search(line))}


def line_mass(line: str) -> int:
    """What a line weighs by its form alone: sentences have their length."""
    return len(line) if is_sentence(line) and not line.endswith(":") and len(line) >= 40 else 0


def said_outside(lines: list[str], listed: list[bool], odds: list[float] | None, phrases: bool) -> list[bool]:
    """For every line whether it stands outside the body: by its odds and, where those are open, by phrases."""
    if odds is None:
        return [bool(line) and said_by_furniture(line.lower()) for line in lines]
    least = [LISTED if entry else SENTENCE if line_mass(line) else OUTSIDE for line, entry in zip(lines, listed)]
    return [bool(line) and (z >= t or phrases and z > OPEN and said_by_furniture(line.lower())) for line, t, z in zip(lines, least, odds)]


def _tail(line: str) -> str:
    """What stands last in a path such as "Home > Schemes > Heart"; nothing for other lines."""
    return re.split(r"\s*(?:>|»|›)\s*| / ", line)[-1].strip() if re.search(r">|»|›| / ", line) else ""


def content(text: str, title: str | None = None, odds: list[float] | None = None, phrases: bool = True) -> list[bool]:
    """For every line whether it is main content; blank lines are not.

    `odds` are the log odds of the lines to stand outside; without them the phrases alone decide.
    """
    lines = lines_of(text)
    low = [line.lower() for line in lines]
    listing_ = [bool(_BULLET.match(line) or len(line) < 300 and _ROW.search(line)) for line in lines]
    said = said_outside(lines, listing_, odds, phrases)
    names = [n for n in site_names([line for line, f in zip(low, said) if f]) if len(n.split()) > 1] if phrases else []
    own = " ".join(title.split()).lower() if isinstance(title, str) else ""
    crumbs = [t for line, f in zip(low, said) if f and (t := _tail(line))]
    heading = {h for h in {own, *crumbs} & set(low) if h and not _MENU.fullmatch(h)}
    n = len(lines)
    furniture = [low[i] not in heading and (said[i] or any(name in low[i] for name in names)) for i in range(n)]
    mass = [0 if furniture[i] else len(lines[i]) for i in range(n)]
    at = [i for i in range(n) if lines[i]]
    kept = [False] * n
    if not at:
        return kept
    # sums over windows of lines that hold text; a line is in a surge where a window over it is full and has a sentence
    m = [mass[i] for i in at]
    whole = [mass[i] >= SURGE or is_sentence(lines[i]) for i in at]
    sums = [0, *accumulate(m)]
    before = [sums[j + 1] - sums[max(0, j - WINDOW + 1)] for j in range(len(at))]
    after = [sums[min(len(at), j + WINDOW)] - sums[j] for j in range(len(at))]
    strong = [j for j in range(len(at)) if m[j] and whole[j] and max(before[j], after[j]) >= SURGE]
    surge, dive = (strong[0], strong[-1]) if strong else (len(at), -1)
    # lists, tables and short lines that touch the content belong to it
    if strong:
        while surge > 0 and m[surge - 1]:
            surge -= 1
        while dive + 1 < len(at) and m[dive + 1]:
            dive += 1
    if odds is not None and not heading and not own and surge > 0:
        # of what stands above the content, the least outlying short line can be its heading
        above = [i for i in at[: min(surge, len(at))] if len(lines[i]) < 150 and not _tail(low[i]) and odds[i] < HEADING and not (phrases and said_by_furniture(low[i]))]
        heading = {low[min(above, key=lambda i: odds[i])]} if above and strong else heading
        furniture = [f and low[i] not in heading for i, f in enumerate(furniture)]
    headed, listing = bool(heading), False
    for j, i in enumerate(at):
        if furniture[i]:
            continue
        line = lines[i]
        inside = surge <= j <= dive
        listed = line.endswith(":") or listing_[i]
        first = j < surge and not headed  # the page's heading, with furniture between it and the content
        kept[i] = bool(inside or listed or low[i] in heading or first or listing and not whole[j])
        headed = headed or not listed
        listing = bool(listed) or listing and not whole[j]
    return kept


LINES = T.ArrayType(T.IntegerType())


def trained(texts: DataFrame, text: str = "text") -> block.LineModel | None:
    """The model of a corpus, from a sample of bounded size."""
    return block.fit([[line for line in lines_of(t) if line] for t in block.sample(texts, text)], line_mass)


def _kept(texts: pd.Series, titles: pd.Series, model: block.LineModel | None, phrases: bool) -> Iterator[tuple[list[str], list[bool]] | None]:
    """Lines and verdicts of each text, None for a null; the lines of many texts are scored at once."""
    rows = [(lines_of(x), x, t) if isinstance(x, str) else None for x, t in zip(texts, titles)]
    at = 0
    while at < len(rows):
        stop, size = at, 0
        while stop < len(rows) and (stop == at or size < CHUNK_CHARS):
            size += len(rows[stop][1]) if rows[stop] else 0
            stop += 1
        odds = model.odds([line for r in rows[at:stop] if r for line in r[0]]).tolist() if model else None
        used = 0
        for r in rows[at:stop]:
            if r is None:
                yield None
                continue
            mine = None if odds is None else odds[used : used + len(r[0])]
            used += len(r[0])
            yield r[0], content(r[1], r[2], mine, phrases)
        at = stop


def _column(df: DataFrame, model: block.LineModel | None, phrases: bool, kind: str | T.DataType, of: Callable) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(kind)
    def run(texts: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([of(x) for x in _kept(texts, titles, shared.value, phrases)], dtype=object)

    return run("text", "title")


def _other(x) -> list[int]:
    """Numbers of the lines, from 1, that hold text and are no main content."""
    return [] if x is None else [i + 1 for i, (line, keep) in enumerate(zip(*x)) if line and not keep]


def _main(x) -> str | None:
    return None if x is None else "\n".join(line for line, keep in zip(*x) if keep)


def _pages(pages: DataFrame, zones: DataFrame) -> DataFrame:
    one = pages.select(F.lit("stored_pages").alias("src"), F.col("text_path").alias("ref"), F.col("body").alias("text"), F.lit(None).cast("string").alias("title"))
    two = zones.select(F.lit("zone_docs").alias("src"), F.col("doc_id").alias("ref"), "text", "title")
    return one.unionByName(two).where(F.col("ref").isNotNull() & F.col("text").isNotNull())


def found(pages: DataFrame, zones: DataFrame, phrases: bool = True) -> DataFrame:
    """src, ref, line_no of every line that is not main content. Rows that share a ref are read each; nulls have none.

    Without `phrases` the list of phrases has no say.
    """
    every = _pages(pages, zones)
    rows = every.select("src", "ref", _column(every, trained(every), phrases, LINES, _other).alias("_n"))
    return rows.where(F.size("_n") > 0).select("src", "ref", F.explode("_n").alias("line_no")).distinct()


def main_text(pages: DataFrame, zones: DataFrame, phrases: bool = True) -> DataFrame:
    """src, ref and the main text, one row for each distinct text of a ref."""
    every = _pages(pages, zones)
    return every.distinct().select("src", "ref", _column(every, trained(every), phrases, "string", _main).alias("main"))
