"""Pages as typed zones: a table function from HTML to one row a zone."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Headings of the zones, words that may follow one, states with other spellings, labels.
PHRASES = {
    "eligibility": ["eligibility", "who is eligible", "who are eligible", "who can apply", "पात्रता"],
    "benefits": ["benefits", "benefit", "coverage", "what is covered", "लाभ"],
    "documents": ["documents required", "required documents", "document checklist", "documents", "दस्तावेज", "दस्तावेज़"],
    "how_to_apply": ["how to apply", "application process", "application procedure", "आवेदन प्रक्रिया", "आवेदन कैसे करें", "आवेदन"],
}
SUFFIXES = {"criteria", "criterion", "details", "detail", "section", "information", "required", "process", "procedure", "checklist", "list", "online", "offline"}
STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh",
    "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal",
    "Andaman and Nicobar Islands", "Chandigarh", "Dadra and Nagar Haveli and Daman and Diu", "Delhi", "Jammu and Kashmir", "Ladakh", "Lakshadweep", "Puducherry",
]
STATE_ALIASES = {"up": "Uttar Pradesh", "u.p.": "Uttar Pradesh", "mp": "Madhya Pradesh", "m.p.": "Madhya Pradesh", "orissa": "Odisha", "pondicherry": "Puducherry", "nct of delhi": "Delhi"}
STATE_LABELS, CONDITION_LABELS = {"state", "राज्य"}, {"condition", "conditions", "disease", "ailment"}

_LABEL = re.compile(rf"({'|'.join([*STATE_LABELS, *CONDITION_LABELS])})\s*[:\-–—：]\s*(.+)", re.I)
HIDDEN = {"script", "style", "noscript", "template"}
HEADINGS = {f"h{i}" for i in range(1, 7)}
#: Elements that end a line of text, and those whose text is read as one cell.
BREAKS = {"p", "div", "li", "section", "article", "blockquote", "br", "ul", "ol", "table"}
CELLS = HEADINGS | {"title", "td", "th", "dt", "dd"}


def squeeze(text: str) -> str:
    return " ".join(text.replace("\xa0", " ").split())


def key_of(text: str) -> str:
    """Lower-case words of letters, marks and numbers."""
    import unicodedata

    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in folded).split())


_KEYS = {zone: [key_of(p) for p in phrases] for zone, phrases in PHRASES.items()}
_STATES = {k: s for s in STATES for k in (key_of(s), key_of(s).replace(" ", ""))} | {k: s for a, s in STATE_ALIASES.items() for k in (key_of(a), key_of(a).replace(" ", ""))}


def heading_zone(text: str, longest: int = 80) -> str | None:
    """The one zone whose phrase is the heading, bare or with generic words behind; None if another one is in it too."""
    key = key_of(text)
    if not key or len(key) > longest:
        return None
    named = {z for z, ps in _KEYS.items() if any(key == p or key.startswith(p + " ") and set(key[len(p) :].split()) <= SUFFIXES for p in ps)}
    present = {z for z, ps in _KEYS.items() if any(f" {p} " in f" {key} " for p in ps)}
    return named.pop() if len(named) == 1 and len(named | present) == 1 else None


class _Flow(HTMLParser):
    """Blocks of a page in order, as (element, texts): the innermost open cell collects text, else the running line does."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[str]]] = []
        self.line: list[str] = []
        self.open: list[tuple[str, list[str]]] = []
        self.row: list[str] | None = None
        self.term: str | None = None
        self.hidden = 0

    def end_line(self) -> None:
        if text := squeeze("".join(self.line)):
            self.blocks.append(("text", [text]))
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif not self.hidden:
            if tag in BREAKS or tag in CELLS or tag == "tr":
                self.end_line()
            if tag in CELLS:
                self.open = [o for o in self.open if o[0] != tag] + [(tag, [])]
            elif tag == "tr":
                self.row = []

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if self.hidden or tag in HIDDEN:
            return
        if tag in BREAKS:
            self.end_line()
        elif tag == "tr" and self.row is not None:
            if cells := [c for c in self.row if c]:
                self.blocks.append(("row", cells))
            self.row = None
        elif tag in CELLS and (mine := next((o for o in reversed(self.open) if o[0] == tag), None)):
            self.open.remove(mine)
            self.finish(tag, squeeze("".join(mine[1])))

    def finish(self, tag: str, text: str) -> None:
        if tag in HEADINGS or tag == "title":
            if text:
                self.blocks.append(("title" if tag == "title" else "heading", [text]))
        elif tag == "dt":
            self.term = text
        elif tag == "dd":
            parts = [x for x in (self.term, text) if x]
            if parts:
                self.blocks.append(("row" if len(parts) == 2 else "text", parts))
            self.term = None
        elif self.row is not None:
            self.row.append(text)
        elif text:
            self.blocks.append(("text", [text]))

    def handle_data(self, data):
        if not self.hidden:
            (self.open[-1][1] if self.open else self.line).append(data)

    def finished(self) -> list[tuple[str, list[str]]]:
        self.close()
        self.end_line()
        if self.term:
            self.blocks.append(("text", [self.term]))
        return self.blocks


def conditions_in(value: str) -> list[str]:
    """Items of a condition label; prose and over-long items void it."""
    value = squeeze(value)
    items = [i.strip() for i in re.split("[,;]", value)]
    return [] if not value or len(value) > 80 or set(value) & set(".?!") or any(not i or len(i) > 40 for i in items) else items


def extract(html: str) -> dict:
    """title, state, conditions and sections (zone, text) of a page; a state only if all its labels name the same one."""
    flow = _Flow()
    flow.feed(html)
    title, sections, states, conditions = "", [], [], {}
    current: tuple[str, list[str]] | None = None

    def label(name: str, value: str) -> None:
        kind = key_of(name)
        if kind in STATE_LABELS:
            states.append(_STATES.get(key_of(value)) or _STATES.get(key_of(value).replace(" ", "")))
        elif kind in CONDITION_LABELS:
            for item in conditions_in(value):
                conditions.setdefault(item.casefold(), item)

    for kind, texts in flow.finished():
        if kind == "title":
            title = texts[0]
            continue
        zone = heading_zone(texts[0]) or "other" if kind == "heading" else heading_zone(texts[0], 60) if kind == "text" else None
        if zone:
            current = (zone, [])
            sections.append(current)
            continue
        if kind == "text" and (m := _LABEL.fullmatch(texts[0])):
            label(m[1], m[2].strip())
        elif kind == "row" and len(texts) >= 2:
            label(texts[0], texts[1])
        if current is None:
            current = ("other", [])
            sections.append(current)
        current[1].extend(texts)
    state = states[0] if states and len(set(states)) == 1 else None
    return {"title": title, "state": state, "conditions": list(conditions.values()), "sections": [(z, "\n".join(p)) for z, p in sections if p]}


ZONES = "url string, ordinal int, doc_id string, title string, zone string, text string, state string, conditions array<string>"


def zones(pages: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each zone of `pages(url, content_hash, html)`. A page without text gives none, or an error if strict."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, digest, html in zip(frame["url"], frame["content_hash"], frame["html"]):
                page = extract(html.removeprefix("﻿") if isinstance(html, str) else "")
                if strict and not page["sections"]:
                    raise ValueError(f"no text in {url}")
                for n, (zone, text) in enumerate(page["sections"]):
                    name = hashlib.sha256("\n".join([url or "", digest or "", str(n), zone]).encode()).hexdigest()
                    rows.append((url, n, name, page["title"], zone, text, page["state"], page["conditions"]))
            yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in ZONES.split(", ")])

    return pages.select("url", "content_hash", "html").mapInPandas(run, ZONES)


def corpus(pages: DataFrame, urls: list[str] | None = None) -> DataFrame:
    """Zone documents of all pages or of some; an unknown url raises ValueError."""
    if urls is not None:
        wanted = pages.sparkSession.createDataFrame([(u,) for u in urls], "url string")
        missing = wanted.join(pages.select("url").distinct(), "url", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"unknown url: {missing[0]['url']!r}")
        pages = pages.join(F.broadcast(wanted), "url", "left_semi")
    return zones(pages)
