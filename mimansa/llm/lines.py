"""What a line's words say about its place: a linear model taught by the line-block distribution of the corpus itself.

On pages with a clear body the distribution tells most lines by where they stand: between surge and dive, or outside.
Lines of a bounded sample of such pages so teach a logistic model over hashed words, pairs of words and the shape of a
line. It is fitted twice; the second time the first model takes the mass from lines that plainly stand outside, so that
notices which happen to touch a body teach the right side. No wording is given, a site's furniture is learned from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the training sample, and the characters a page of it has.
SAMPLE_PAGES, LEAST_CHARS, MOST_CHARS = 1_500, 800, 20_000
BUCKETS, EPOCHS = 1 << 17, 4
#: Characters that the greatest block of a teaching page has; the share of it that another block of the body has; empty
#: lines that part blocks.
BODY, SHARE, GAP = 400, 0.3, 2
#: Log odds from which a line teaches the other side than its place in the second fit.
PLAIN = 2.0

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _word_bytes() -> np.ndarray:
    """Letters and bytes of other scripts stay, all digits are one, the rest parts words."""
    out = np.zeros(256, dtype=np.uint64)
    for c in range(256):
        out[c] = c if c >= 128 or chr(c).isalpha() else 48 if chr(c).isdigit() else 0
    return out


_BYTES = _word_bytes()


def features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and line index of words, pairs of neighbouring words, first and last words, and the shape of every line."""
    blob = np.frombuffer(("\n".join(lines) + "\n").lower().encode(), dtype=np.uint8)
    kept = _BYTES[blob]
    is_word = kept > 0
    before = np.concatenate(([False], is_word[:-1]))
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(~is_word & before)
    powers = np.full(len(blob) + 1, _P, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(kept * powers[:-1], dtype=np.uint64)))
    inverse = np.full(len(blob) + 1, _P_INV, dtype=np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    words = (sums[ends] - sums[starts]) * inverse[starts]
    words = (words ^ (words >> np.uint64(29))) * _M1
    line = (np.cumsum(blob == 10) - (blob == 10))[starts]
    same = line[1:] == line[:-1]
    first, last = np.concatenate(([True], ~same))[: len(line)], np.concatenate((~same, [True]))[: len(line)]
    bucket = lambda h: (h >> np.uint64(64 - 17)).astype(np.int64)
    grams = [bucket(words), bucket(words[:-1] * np.uint64(3) + words[1:] * _M2)[same], bucket(words * np.uint64(5) + _M2)[first], bucket(words * np.uint64(9) + _M2)[last]]
    owners = [line, line[1:][same], line[first], line[last]]
    shape, of = [], []
    for i, s in enumerate(lines):
        marks = (s.count("|"), s.count(" / ") + s.count("»") + s.count(" > "), s.count(":"), s.count("©"))
        shape += [min(len(s) // 20, 12), 20 + ord(s[-1]) % 64 if s else 19, 90 + (not s[:1].isalpha()) + 2 * s.isupper(), *[100 + 10 * k + min(m, 3) for k, m in enumerate(marks)]]
        of += [i] * 7
    return np.concatenate([*grams, np.array(shape, dtype=np.int64)]), np.concatenate([*owners, np.array(of, dtype=np.int64)])


@dataclass
class LineModel:
    """Log odds of a line to stand outside the body of its page."""

    weights: np.ndarray
    bias: float

    def odds(self, lines: list[str]) -> np.ndarray:
        if not lines:
            return np.zeros(0)
        grams, owners = features(lines)
        n = np.maximum(np.bincount(owners, minlength=len(lines)), 1)
        return np.bincount(owners, weights=self.weights[grams], minlength=len(lines)) / np.sqrt(n) + self.bias


def places(mass: list[int]) -> tuple[int, int] | None:
    """First and last line of the body by the masses of the lines that hold text: the great blocks and all between them."""
    blocks: list[list[int]] = []
    gap = GAP
    for j, x in enumerate(mass):
        if not x:
            gap += 1
            continue
        if gap >= GAP:
            blocks.append([j, j, 0])
        blocks[-1][1], blocks[-1][2], gap = j, blocks[-1][2] + x, 0
    top = max((b[2] for b in blocks), default=0)
    if top < BODY:
        return None
    body = [b for b in blocks if b[2] >= SHARE * top]
    return body[0][0], body[-1][1]


def _fit(lines: list[str], outside: np.ndarray, seed: int) -> LineModel:
    rng = np.random.default_rng(seed)
    grams, owners = features(lines)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(lines))
    parts = np.split(grams[order], np.cumsum(counts)[:-1])
    weights, seen, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2), 0.0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(lines))
        for at in range(0, len(shuffled), 64):
            mine = shuffled[at : at + 64]
            sizes = counts[mine]
            used = np.concatenate([parts[i] for i in mine])
            scale = 1 / np.sqrt(sizes)
            z = np.add.reduceat(weights[used], np.cumsum(sizes) - sizes) * scale + bias
            wrong = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - outside[mine]
            back = np.repeat(wrong * scale, sizes)
            np.add.at(seen, used, back**2)
            np.add.at(weights, used, -0.3 * back / np.sqrt(seen[used]))
            bias -= 0.02 * wrong.mean()
    return LineModel(weights.astype(np.float32), bias)


def fit(pages: list[list[str]], mass: Callable[[str], int], seed: int = 11) -> LineModel | None:
    """A model from pages as lists of lines that hold text; None if no page has a clear body.

    The line right above the body may be its heading and teaches nothing.
    """
    model = None
    for attempt in range(2):
        lines: list[str] = []
        outside: list[int] = []
        for page in pages:
            odds = np.zeros(len(page)) if model is None else model.odds(page)
            body = places([0 if z >= PLAIN else mass(s) for s, z in zip(page, odds)])
            if body is None:
                continue
            for j, s in enumerate(page):
                inside = body[0] <= j <= body[1]
                if j == body[0] - 1:
                    continue
                lines.append(s)
                outside.append(int(odds[j] >= PLAIN if inside else odds[j] > -PLAIN))
        if not lines or len(set(outside)) < 2:
            return model
        model = _fit(lines, np.array(outside), seed + attempt)
    return model


def sample(texts: DataFrame, text: str = "text") -> list[str]:
    """At most twice SAMPLE_PAGES distinct texts of LEAST_CHARS to MOST_CHARS, about SAMPLE_PAGES by hash."""
    some = texts.where((F.length(text) >= LEAST_CHARS) & (F.length(text) <= MOST_CHARS)).select(text)
    every = max(1, some.count() // SAMPLE_PAGES)
    picked = some.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0).distinct().orderBy(F.xxhash64(text), text).limit(2 * SAMPLE_PAGES)
    return [r[0] for r in picked.collect()]
