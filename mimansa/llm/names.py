"""Which words are names of persons: a linear model over letter n-grams, fitted to the corpus at hand.

Titles and name labels ("Dr.", "my name is", "Patient name:") tell names for certain. The words behind them in all
documents, with a short list of common names, teach a softmax over the classes given name, family name and other; words
in lower case, and capitalised ones that stand alone or before the word of a place or firm, teach "other". Every word of
the corpus is then scored by its letters, and a candidate of two or three words by the sum of its parts. A title or label
lets names through that the model does not know, and what one document so reveals holds in all of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mimansa.plans.support import checkpointed

#: A word that this many texts, and this share of them, have outside names is none in small letters.
COMMON, COMMON_SHARE = 20, 1 / 300
#: Letters of a word that are looked at.
WORD_CHARS = 24
#: All words of a class together weigh as so many at most.
CLASS_WORDS = 12_000
#: Words that one task fits, states that one task or the driver adds up, words that a task counts before it hands them on.
PART_WORDS, STATES, HELD_WORDS = 200_000, 32, 200_000
#: Passes over the words: of a fit in one part, and of one in parts, whose states are averaged after each.
EPOCHS, ROUNDS = 6, 3
BUCKETS, ORDERS = 1 << 16, (1, 2, 3, 4)
#: Least sum of log odds of a capitalised pair, of an initial with a family name, of a pair in small letters, of a pair
#: behind a title or label; and the least of each word.
PAIR, INITIAL, SMALL, TITLED, LEAST = 1.0, -1.5, 2.5, -8.0, -2.5

# Common given names of women and men, and family names, of the languages of the corpus.
WOMEN = "aarti anita anjali asha deepa divya fatima geeta kavita lakshmi leela mary meena nisha pooja priya radha rekha rani sarah savita shanti sita sunita sushma swati usha elizabeth jennifer linda".split()
MEN = "abdul ajay amit anil arjun ashok david deepak ganesh hari imran james john krishna mahesh manoj michael mohan mohammed rahul raj rajesh ram ramesh ravi robert sanjay suresh surya thomas vijay vikram vinod".split()
FAMILY = "agarwal ahmed banerjee bhat bose chatterjee chauhan choudhary das desai deshmukh dutta gandhi ghosh gill goswami gupta iyer iyengar jain joshi kapoor kaur khan kulkarni kumar malhotra mehta menon mishra mukherjee naidu nair nayak pandey patel patil pillai rao rathore reddy roy saxena sen shah sharma singh sinha subramanian thakur tiwari trivedi varma verma yadav smith johnson williams brown jones miller davis wilson taylor".split()
SEEDS = {**{w: 1 for w in [*WOMEN, *MEN]}, **{w: 2 for w in FAMILY}}
# Titles, and labels before a name.
TITLES = "dr mr mrs ms miss smt shri sri shriman kumari prof professor sister".split()
LABELS = r"name is|name of (?:the )?(?:patient|applicant|member|father|mother|husband|wife)|naam|नाम|নাম|பெயர்|(?:\b[Nn]ame|NAME|[Ss]igned|[Pp]atient|[Aa]pplicant|[Ww]itness)\s*[:,–-]"
# Verbs of getting in touch, after which a capitalised pair is a person.
CONTACTS = {"call", "contact", "meet", "phone", "ask"}
# Words behind a name that make it the name of a place, firm, clinic or scheme.
NOT_PERSON = set(
    """relief care sehat swasthya arogya health trust district medical clinic hospital fund card nidhi yojana street road marg gali lane path avenue cross sadak temple welfare medicine citizen
    college school university bank company limited ltd pvt laboratories pharmacy pharma foundation mission centre center society scheme ministry department office market station nagar colony village town""".split()
)
# Titles in other scripts, and words that end the name behind them.
OTHER_TITLES = "श्रीमती|श्री|डॉ\\.?|कुमारी|শ্রীমতী|শ্রী|ডাঃ|ডা\\.|திருமதி|திரு|டாக்டர்"
ENDS_NAME = set("है हैं का की के को से में और ने जी पर तक लिए यह वह आहे आणि ला चे ची चा এর কে ও থেকে என்ற மற்றும் ஒரு".split())
NOT_PERSON_OTHER = set("मंदिर अस्पताल कार्यालय योजना केंद्र स्कूल रुग्णालय মন্দির হাসপাতাল கோயில் மருத்துவமனை".split())

# Words of dates and directions, which are capitalised too.
CALENDAR = "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december morning evening new north south east west".split()

_WORD = re.compile("[A-Za-z]+")
_W, _SP = r"(?:[A-Z][a-z]+|[A-Z]{2,})", r"[^\S\n]"
_TITLE = rf"(?<![\w.-])(?:{'|'.join(t.capitalize() for t in TITLES)})\.?{_SP}+"
_LABEL = rf"(?:{LABELS}){_SP}*(?::{_SP}*)?"
_SHAPES = rf"(?P<g1>{_W})(?:{_SP}+[A-Z]\.)?{_SP}+(?P<f1>{_W})|(?P<f2>{_W}),{_SP}*(?P<g2>{_W})|[A-Z]\.{_SP}?(?P<f3>{_W})"
_LABELLED = re.compile(_LABEL)
TITLED_NAME = re.compile(rf"(?:{_TITLE}|{_LABEL})(?:{_SHAPES})(?!\w)(?P<next>{_SP}+\w+)?")
#: Words that labels begin with, by letters that all of them hold; and those of other scripts.
_LABEL_WORDS = {b"ame": (b"name", b"Name"), b"NAME": (b"NAME",), b"naam": (b"naam",), b"igned": (b"signed", b"Signed"), b"atient": (b"patient", b"Patient"), b"pplicant": (b"applicant", b"Applicant"), b"itness": (b"witness", b"Witness")}
_LABEL_STEM = re.compile(b"|".join(_LABEL_WORDS))
_OTHER_LABELS = ("नाम", "নাম", "பெயர்")
_TITLE_WORDS = {t.capitalize().encode() for t in TITLES}
_TITLE_RUNS = _TITLE_WORDS | {t + b"." for t in _TITLE_WORDS}
#: A capitalised word that stands alone among words in small letters, or before the word of a place or firm.
_ALONE = re.compile(rf"[A-Z](?:(?<=[a-z,]{_SP}[A-Z])[a-z]++(?={_SP}[a-z])|(?<![\w.][A-Z])[a-z]++(?={_SP}(?:{'|'.join(w.capitalize() for w in sorted(NOT_PERSON))})\b))")
#: Letters, all else as spaces.
_LETTERS = bytes(c if chr(c).isascii() and chr(c).isalpha() else 32 for c in range(256))
#: Runs of letters, "@" and full stops, all else as spaces.
_RUNS = bytes(c if chr(c).isascii() and chr(c).isalpha() or c in b"@." else 32 for c in range(256))
#: What titles in other scripts begin with.
_OTHER_STEMS = ("श्री", "डॉ", "कुमारी", "শ্রী", "ডা", "திரு", "டாக்டர்")
OTHER_NAME = re.compile(rf"(?<!\S)(?:{OTHER_TITLES}){_SP}+([^\W\d_][^\s,.;:!?()।|]*)(?:{_SP}+([^\W\d_][^\s,.;:!?()।|]*))?(?:{_SP}+([^\s,.;:!?()।|]+))?")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word index of every letter n-gram of lower-case words with their bounds marked, and of whole words."""
    text = "".join(f"^{w[:WORD_CHARS]}$" for w in words).encode("ascii", "replace")
    codes = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    which = np.cumsum(codes == ord("^")) - 1
    grams, owners = [], []
    rolled = np.zeros(len(codes) + 1, dtype=np.uint64)
    for n in ORDERS:
        # the hash of n letters from that of n - 1
        rolled = rolled[:-1] * np.uint64(131) + codes[n - 1 :]
        inside = which[: len(rolled)] == which[n - 1 :]
        mixed = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        grams.append((mixed[inside] >> np.uint64(48)).astype(np.int64))
        owners.append(which[: len(rolled)][inside])
    whole = np.array([crc32(w[:WORD_CHARS].encode()) % BUCKETS for w in words], dtype=np.int64)
    return np.concatenate([*grams, whole]), np.concatenate([*owners, np.arange(len(words))])


@dataclass
class NameModel:
    """Log odds of each bucket, and at the end alone, against "other": of a given and of a family name."""

    weights: np.ndarray
    seeds: dict[str, int]
    common: frozenset[str] = frozenset()

    def odds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds against "other" of every lower-case word as a given and as a family name."""
        out = np.zeros((2, len(words)))
        for at in range(0, len(words), 1024):
            mine = words[at : at + 1024]
            grams, owners = features(mine)
            scale = np.sqrt(np.bincount(owners, minlength=len(mine)))
            for k in range(2):
                out[k, at : at + len(mine)] = np.bincount(owners, weights=self.weights[k][grams], minlength=len(mine)) / scale + self.weights[k, BUCKETS]
        for i, w in enumerate(words):
            if w in self.seeds:
                out[self.seeds[w] - 1, i] = max(out[self.seeds[w] - 1, i], 5.0)
        return out[0], out[1]


def costs(per_class: list[int]) -> np.ndarray:
    """What a word of each class weighs in the fit: rare classes more, and no class more than CLASS_WORDS words in all."""
    n = np.maximum(per_class, 1)
    held = np.minimum(n, CLASS_WORDS)
    return np.minimum(np.sqrt(held.max() / held), 8) * held / n


def learn(words: list[str], labels: np.ndarray, cost: np.ndarray, epochs: int, state: np.ndarray | None = None, seed: int = 3) -> np.ndarray:
    """Passes of AdaGrad over some words. A state has a row of weights for each class, its last column their biases, and one of squared steps."""
    if state is None:
        state = np.zeros((4, BUCKETS + 1))
        state[3] = 1e-2
    else:
        state = state.astype(np.float64)
    weights, bias, seen = state[:3, :BUCKETS], state[:3, BUCKETS], state[3, :BUCKETS]
    rng = np.random.default_rng(seed)
    batch = max(64, len(words) // 100)
    for _ in range(epochs):
        shuffled = rng.permutation(len(words))
        for at in range(0, len(shuffled), batch):
            mine = shuffled[at : at + batch]
            grams, owners = features([words[i] for i in mine])
            scale = 1 / np.sqrt(np.bincount(owners, minlength=len(mine)))
            z = np.stack([np.bincount(owners, weights=w[grams], minlength=len(mine)) * scale for w in weights], axis=1) + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(mine)), labels[mine]] -= 1
            p *= cost[mine][:, None]
            # the buckets of the batch
            back = p * scale[:, None]
            if len(grams) < BUCKETS // 4:
                some, where = np.unique(grams, return_inverse=True)
                step = np.stack([np.bincount(where, weights=back[:, k][owners], minlength=len(some)) for k in range(3)])
            else:
                some = np.flatnonzero(np.bincount(grams, minlength=BUCKETS))
                step = np.stack([np.bincount(grams, weights=np.take(back[:, k], owners), minlength=BUCKETS)[some] for k in range(3)])
            seen[some] += (step**2).sum(axis=0)
            weights[:, some] -= 0.5 * step / np.sqrt(seen[some])
            bias -= 0.02 * p.sum(axis=0) / cost[mine].sum()
    return state.astype(np.float32)


def model_of(state: np.ndarray, common: Iterable[str] = ()) -> NameModel:
    return NameModel(state[1:3] - state[0], SEEDS, frozenset(common))


def fit(words: dict[str, int], common: Iterable[str] = (), seed: int = 3) -> NameModel:
    """A model from a few words in small letters with their class, and the common names."""
    known = {**{w: 0 for w in CALENDAR}, **words, **SEEDS}
    if not words:
        known |= {w: 0 for w in ("about", "after", "before", "between", "clinic", "doctor", "family", "given", "health", "hospital", "medicine", "number", "patient", "people", "please", "scheme", "should", "treatment", "village", "water", "which", "without", "yesterday")}
    names = sorted(known)
    labels = np.array([known[w] for w in names])
    return model_of(learn(names, labels, costs(np.bincount(labels, minlength=3))[labels], EPOCHS, seed=seed), common)


_SEEDED: list[NameModel] = []


def seeded() -> NameModel:
    """The model of the common names alone."""
    if not _SEEDED:
        _SEEDED.append(fit({}))
    return _SEEDED[0]


def flattened(text: str) -> bytes:
    """A byte for each character, with "?" for all that is not ASCII."""
    return text.encode("ascii", "replace")


def words_of(flat: bytes) -> set[bytes]:
    """The words in Latin letters of a flattened text."""
    return set(flat.translate(_LETTERS).split())


def places(text: str | bytes, word: str | bytes) -> Iterator[int]:
    """Where a word stands, also inside others."""
    k = text.find(word)
    while k >= 0:
        yield k
        k = text.find(word, k + 1)


def matches(pattern: re.Pattern, text: str, at: Iterable[int]) -> Iterator[re.Match]:
    """What finditer gives, if a match can begin only at some places."""
    end = 0
    for k in sorted(at):
        if k >= end and (m := pattern.match(text, k)):
            end = m.end()
            yield m


def _labelled(words: Iterable[bytes]) -> set[bytes]:
    """Words that can hold one that a label begins with."""
    all_ = b" ".join([b"", *words, b""])
    return {all_[all_.rfind(b" ", 0, m.start()) + 1 : all_.find(b" ", m.end())] for m in _LABEL_STEM.finditer(all_)}


def _label_places(text: str, flat: bytes, latin: bool) -> list[int]:
    """Where the words that labels begin with stand; `latin` tells whether one in Latin letters can."""
    at = [k for stem, some in _LABEL_WORDS.items() if stem in flat for x in some for k in places(flat, x)] if latin else []
    if not text.isascii():
        at += [k for x in _OTHER_LABELS for k in places(text, x)]
    return at


def _titled(text: str, flat: bytes, runs: set[bytes], latin: bool) -> Iterator[re.Match]:
    """Matches of TITLED_NAME, tried only where a title or label word stands; a title is a run of its own or follows "@"."""
    titles = _TITLE_WORDS if b"@" in flat else {r.rstrip(b".") for r in runs & _TITLE_RUNS}
    return matches(TITLED_NAME, text, [*(k for t in titles for k in places(flat, t)), *_label_places(text, flat, latin)])


def evidence(texts: Iterable[str], counts: dict[str, list[int]]) -> None:
    """Adds what some texts say for certain: how often a word is other, a given and a family name; in small letters once a text."""
    small: Counter[bytes] = Counter()
    alone: Counter[str] = Counter()
    seen: set[bytes] = set()
    labelled: set[bytes] = set()

    def add(word: str, kind: int, n: int = 1) -> None:
        counts.setdefault(word[:WORD_CHARS], [0, 0, 0])[kind] += n

    for text in texts:
        flat, named = flattened(text), set()
        runs = set(flat.translate(_RUNS).split())
        if new := runs - seen:
            seen |= new
            labelled |= _labelled(new)
        for m in _titled(text, flat, runs, not runs.isdisjoint(labelled)):
            if (m["next"] or "").strip().lower() in NOT_PERSON:
                continue
            for k, group in ((1, "g1"), (1, "g2"), (2, "f1"), (2, "f2"), (2, "f3")):
                if m[group] and len(m[group]) > 2:
                    named.add(m[group].lower())
                    add(m[group].lower(), k)
        others = _ALONE.findall(text)
        if named:
            alone.update(w for w in others if w.lower() not in named)
            runs -= {w.encode() for w in named}
        else:
            alone.update(others)
        small.update(runs)
    for word, n in alone.items():
        add(word.lower(), 0, n)
    for run, n in small.items():
        if len(run) > 2 and run.isalpha() and run.islower():
            add(run.decode(), 0, n)


_COUNTS = "word string, n0 long, n1 long, n2 long"


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n0, n1, n2: how often all texts show a word as other, given and family name.

    The empty word has the number of texts; words of the calendar count as other once more, and listed names are there.
    """

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(w, *n) for w, n in counts.items()], columns=["word", "n0", "n1", "n2"])

        for frame in frames:
            counts.setdefault("", [0, 0, 0])[0] += len(frame)
            evidence(frame["text"], counts)
            if len(counts) > HELD_WORDS:
                yield rows()
                counts.clear()
        yield rows()

    known = docs.sparkSession.createDataFrame([(w, 1, 0, 0) for w in CALENDAR] + [(w, 0, 0, 0) for w in SEEDS], _COUNTS).coalesce(1)
    parts = docs.where(F.length(text) > 0).select(F.col(text).alias("text")).mapInPandas(count, _COUNTS)
    return parts.unionByName(known).groupBy("word").agg(*[F.sum(n).alias(n) for n in ("n0", "n1", "n2")])


def trained(docs: DataFrame, text: str = "text") -> NameModel:
    """A model fitted to the evidence of all documents and all words of any corpus.

    A word is a name if titles and labels show it at least a third as often as it stands among others. Other words weigh
    by the root of their texts. Words are fitted in parts, each by a task, whose states are averaged; only states, totals and common words come to
    the driver, and of those there are no more than texts have words, times 1 / COMMON_SHARE.
    """
    spark = docs.sparkSession
    kind = F.when(F.col("word").isin([w for w, k in SEEDS.items() if k == 1]), 1).when(F.col("word").isin([w for w, k in SEEDS.items() if k == 2]), 2)
    kind = kind.when(3 * (F.col("n1") + F.col("n2")) < F.col("n0"), 0).when(F.col("n1") >= F.col("n2"), 1).otherwise(2)
    words = checkpointed(counted(docs, text).withColumn("kind", F.when(F.col("word") == "", -1).otherwise(kind)))
    totals = {r["kind"]: r for r in words.groupBy("kind").agg(F.count("*").alias("words"), F.sum(F.col("n0") + F.col("n1") + F.col("n2")).alias("n"), F.sum(F.sqrt("n0")).alias("roots")).collect()}
    if sum(r["n"] for k, r in totals.items() if k >= 0) == len(CALENDAR):
        return seeded()
    cost = costs([totals[k]["words"] if k in totals else 0 for k in range(3)])
    root = totals[0]["roots"] / totals[0]["words"]
    least = max(COMMON, COMMON_SHARE * totals[-1]["n"])
    common = [r["word"] for r in words.where((F.col("kind") == 0) & (F.col("n0") >= least)).select("word").collect()]

    n = -(-sum(r["words"] for k, r in totals.items() if k >= 0) // PART_WORDS)
    # names stay rare where other words grow, so a word stands in as many parts as give each part CLASS_WORDS words of its class, or all
    copies = [min(n, -(-n * CLASS_WORDS // max(1, totals[k]["words"]))) if k in totals else 1 for k in range(3)]
    cost = cost / copies
    each = words.where("kind >= 0").select("word", "kind", "n0", F.explode(F.sequence(F.lit(1), F.get(F.array(*map(F.lit, copies)), F.col("kind")))).alias("copy"))
    parts = each.withColumn("part", F.pmod(F.pmod(F.xxhash64("word"), F.lit(n)) + F.col("copy"), F.lit(n)).cast("int")).repartition(n, "part")
    state = None
    for round_ in range(1 if n == 1 else ROUNDS):
        learned = _learner(spark.sparkContext.broadcast(state), cost, root, EPOCHS if n == 1 else 1, 3 + round_)
        state = _averaged(parts.groupBy("part").applyInPandas(learned, _STATE), n)
    return model_of(state, common)


_STATE = "part int, times long, state binary"


def _learner(before: Broadcast, cost: np.ndarray, root: float, epochs: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def learned(frame: pd.DataFrame) -> pd.DataFrame:
        # as bytes, which are sorted faster and in the same order
        frame = frame.iloc[np.argsort(frame["word"].to_numpy(dtype=f"S{WORD_CHARS}"), kind="stable")]
        labels = frame["kind"].to_numpy()
        weighs = cost[labels] * np.where(labels == 0, np.sqrt(frame["n0"].to_numpy()) / root, 1.0)
        state = learn(frame["word"].tolist(), labels, weighs, epochs, before.value, seed)
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "times": [1], "state": [state.tobytes()]})

    return learned


def _averaged(states: DataFrame, n: int) -> np.ndarray:
    """The mean of the states of up to n parts, added up in groups until there are few."""

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        total = sum(np.frombuffer(s, dtype=np.float32).astype(np.float64) for s in frame["state"])
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "times": [frame["times"].sum()], "state": [total.astype(np.float32).tobytes()]})

    while n > STATES:
        n = -(-n // STATES)
        states = states.groupBy(F.pmod("part", F.lit(n))).applyInPandas(added, _STATE).withColumn("part", F.pmod("part", F.lit(n)).cast("int"))
    rows = sorted(states.collect(), key=lambda r: r["part"])
    total = sum(np.frombuffer(r["state"], dtype=np.float32).astype(np.float64) for r in rows) / sum(r["times"] for r in rows)
    return total.reshape(4, BUCKETS + 1).astype(np.float32)


class Scores:
    """The odds of the words of some texts, and of more that are added."""

    def __init__(self, model: NameModel, texts: Iterable[str] = ()):
        self.model, self.common, self.small = model, model.common, {w.encode() for w in model.common}
        self.clear()
        self.add(set().union(*(words_of(flattened(t)) for t in texts)))

    def clear(self) -> None:
        self.seen: set[bytes] = set()
        self.given: dict[str, float] = {}
        self.family: dict[str, float] = {}
        #: Words in small letters that can be a family name, and that are likely names.
        self.able: set[bytes] = set()
        self.likely: set[bytes] = set()
        #: Words that can be the family name of a mention; in small letters they need more.
        self.hot: set[str] = set()
        #: Words of which every pair that passes has one, in small letters or not.
        self.strong: set[bytes] = set()
        #: Words that can hold one that a label begins with.
        self.labelled: set[bytes] = set()

    def add(self, words: set[bytes]) -> None:
        """Scores the words that are new; where too many are held, all others are dropped first."""
        if len(self.seen) > HELD_WORDS:
            self.clear()
        new = [w for w in words - self.seen if len(w) > 2]
        self.seen.update(new)
        lower = [w.lower() for w in new]
        low = [w for w in (w.decode() for w in set(lower)) if w not in self.family]
        given, family = self.model.odds(low)
        self.given.update(zip(low, given.tolist()))
        self.family.update(zip(low, family.tolist()))
        self.able.update(low[i].encode() for i in np.flatnonzero(family >= LEAST))
        self.likely.update(low[i].encode() for i in np.flatnonzero(np.maximum(given, family) >= PAIR / 2) if low[i] not in NOT_PERSON)
        self.hot.update(w.decode() for w, x in zip(new, lower) if x in self.able and (w[:1].isupper() or w not in self.small and self.family.get(w.decode(), -9.0) >= -1.5))
        self.strong.update(w for w, x in zip(new, lower) if x in self.likely and not (w == x and w in self.small))
        self.labelled |= _labelled(new)

    def of(self, word: str, given: int) -> float:
        return (self.given if given else self.family).get(word.lower(), -9.0)


_JOINED = re.compile(r"[^\S\n]+(?:and|or|aur|ya|&)[^\S\n]+(?=[A-Z])")
_TITLE_SET = {x for t in TITLES for x in (t.capitalize(), t.upper())}
_CONTACT_SET = {x for c in CONTACTS for x in (c, c.capitalize())}
_LEADS = {x.encode() for x in _TITLE_SET | _CONTACT_SET}
#: What is right behind a title or verb that begins a name, and an initial with the word behind it.
_LED = re.compile(r"[ \t]*\.?[ \t]*(?:for[^A-Za-z]+)?[A-Z]")
_INITIAL = re.compile(r"[A-Z]\.[ \t]*([A-Za-z]+)")


def _case(word: str) -> int:
    return 0 if word[0].isupper() and word[1:].islower() else 1 if word.isupper() else 2 if word.islower() else 3


def mentions(text: str, scores: Scores, flat: bytes | None = None, words: set[bytes] | None = None) -> list[tuple[int, int]]:
    """Spans of the names of persons in a text, without overlaps. `flat` and `words` are those of the text, if they are there."""
    out = _other_scripts(text) if not text.isascii() else []
    # only the surroundings of likely names, of initials, and of titles and labels before a capital are looked at
    flat = flattened(text) if flat is None else flat
    words = words_of(flat) if words is None else words
    at, labels = _spots(flat, words & scores.strong), set()
    for a, b in _spots(flat, words & _LEADS):
        if _LED.match(text, b):
            at.append((a, b))
    for m in matches(_LABELLED, text, _label_places(text, flat, not words.isdisjoint(scores.labelled))):
        at.append(m.span())
        labels.add(m.end())
    for m in matches(_INITIAL, text, [k - 1 for k in places(flat, b".") if flat[max(0, k - 1) : k].isupper()]):
        if m[1] in scores.hot:
            at.append(m.span())
    if not at:
        return out
    tokens = [(m.start(), m.end(), m[0]) for a, b in _windows(text, at) for m in _WORD.finditer(text, a, b)]
    known: dict[str, float] = {}
    found: dict[int, tuple[float, int]] = {}
    sure = _sure_places(text, tokens, labels)
    starts = {t[0]: i for i, t in enumerate(tokens)}
    hot = {i for i, t in enumerate(tokens) if t[2] in scores.hot}
    for _ in range(2):
        before = len(known), len(sure)
        for i in sorted(hot | sure.keys()):
            for a, b, least, parts in _candidates(text, tokens, i, sure, scores):
                each = [max(known.get(w.lower(), -99.0), scores.of(w, role)) for w, role in parts]
                if sum(each) >= least and (min(each) >= LEAST or least == TITLED) and sum(each) > found.get(a, (-99.0, 0))[0]:
                    found[a] = (sum(each), b)
                    if least == TITLED:
                        known |= {w.lower(): 6.0 for w, _ in parts}
        for _, b in found.values():
            # what is joined to a name by "and" or "or" is one too
            if (m := _JOINED.match(text, b)) and m.end() in starts:
                sure[starts[m.end()]] = True
        if (len(known), len(sure)) == before:
            break
        # what titles told holds in the rest of the text too
        more = {w for w in words if w.lower().decode() in known} - scores.strong if known else None
        if more:
            at += _spots(flat, more)
            tokens = [(m.start(), m.end(), m[0]) for a, b in _windows(text, at) for m in _WORD.finditer(text, a, b)]
            moved = {t[0]: i for i, t in enumerate(tokens)}
            sure = {moved[a]: True for a, i in starts.items() if i in sure}
            starts = moved
        hot = {i for i, t in enumerate(tokens) if t[2] in scores.hot or t[2].lower() in known}
    for a, (_, b) in sorted(found.items(), key=lambda x: (-x[1][0], x[0])):
        if all(b <= x or a >= y for x, y in out):
            out.append((a, b))
    return sorted(out)


def _spots(flat: bytes, words: set[bytes]) -> list[tuple[int, int]]:
    """Where some words stand, also inside others."""
    at = []
    for w in words:
        k = flat.find(w)
        while k >= 0:
            at.append((k, k + len(w)))
            k = flat.find(w, k + len(w))
    return at


def _windows(text: str, at: list[tuple[int, int]], reach: int = 60) -> list[tuple[int, int]]:
    """The surroundings of some places, widened to white space and merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(at):
        a, b = max(0, a - reach), min(len(text), b + reach)
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _sure_places(text: str, tokens: list[tuple[int, int, str]], labels: set[int]) -> dict[int, bool]:
    """Indexes of tokens that begin a name by a title, label or verb right before them."""
    sure: dict[int, bool] = {}
    for i, (start, end, word) in enumerate(tokens):
        if start in labels:
            sure[i] = True
        if i + 1 == len(tokens) or word not in _TITLE_SET and word not in _CONTACT_SET:
            continue
        gap = text[end : tokens[i + 1][0]]
        if word in _TITLE_SET and gap.strip(" \t") in ("", ".") or word in _CONTACT_SET and gap.strip(" \t") == "" and gap:
            # "ask for" and "call for" have one word more
            sure[i + 2 if tokens[i + 1][2] == "for" and i + 2 < len(tokens) else i + 1] = True
    return sure


def _candidates(text: str, tokens: list, i: int, sure: dict[int, bool], scores: Scores) -> Iterator[tuple[int, int, float, list[tuple[str, int]]]]:
    """(start, end, least, words with 1 for a given and 0 for a family name) of the shapes around a token."""
    n = len(tokens)
    start, end, word = tokens[i]
    case = _case(word)
    if case == 3 or len(word) < 3:
        return

    def gap(j: int) -> str:
        return text[tokens[j][1] : tokens[j + 1][0]]

    def spaces(j: int) -> bool:
        g = gap(j)
        return bool(g) and g.strip(" \t ") == ""

    def clear(a: int, b: int, last: int) -> bool:
        """Not inside an address or word, and not before the word of a place or firm."""
        if a and (text[a - 1] in "@.+-_" or text[a - 1].isalnum()) or b < len(text) and (text[b] in "@-_" or text[b].isalnum()):
            return False
        return not (last + 1 < n and spaces(last) and tokens[last + 1][2].lower() in NOT_PERSON)

    def least(first: int, usual: float) -> float:
        return usual if first not in sure else TITLED if case != 2 else min(usual, PAIR)

    usual = SMALL if case == 2 else PAIR
    firm = word.lower() in NOT_PERSON
    # the token as a family name behind a given name or an initial
    p = i - 1
    pair = i and not firm and len(tokens[p][2]) > 2 and _case(tokens[p][2]) == case and spaces(p)
    initial = i and not firm and len(tokens[p][2]) == 1 and gap(p).rstrip(" \t") == "."
    if (pair or initial) and clear(start, end, i) and not (i + 1 < n and gap(i).strip(" \t") == "," and i in sure):
        if pair and clear(tokens[p][0], end, i):
            if tokens[p][2].lower() not in NOT_PERSON and tokens[p][2] not in _TITLE_SET and tokens[p][2] not in scores.common:
                yield tokens[p][0], end, least(p, usual), [(tokens[p][2], 1), (word, 0)]
        elif initial:
            q = p - 1
            if q >= 0 and spaces(q) and _case(tokens[q][2]) == case and len(tokens[q][2]) > 2 and clear(tokens[q][0], end, i) and tokens[q][2] not in _TITLE_SET:
                yield tokens[q][0], end, least(q, usual), [(tokens[q][2], 1), (word, 0)]
            if tokens[p][2].isupper() and case != 2 and clear(tokens[p][0], end, i):
                yield tokens[p][0], end, least(p, INITIAL), [(word, 0)]
    # the family name first, then a comma and the given name; in a list of names the comma parts two of them
    comma = i + 1 < n and text[end : end + 1] == "," and not firm and gap(i)[1:].strip(" \t") == "" and tokens[i + 1][2].lower() not in NOT_PERSON and _case(tokens[i + 1][2]) == case and len(tokens[i + 1][2]) > 2 and tokens[i + 1][2] not in scores.common
    behind = comma and i and (gap(i - 1).rstrip(" \t") == "." and len(tokens[i - 1][2]) == 1 or spaces(i - 1) and _case(tokens[i - 1][2]) == case and tokens[i - 1][2] not in _TITLE_SET and scores.of(tokens[i - 1][2], 1) >= 0)
    ahead = comma and i + 2 < n and spaces(i + 1) and _case(tokens[i + 2][2]) == case and tokens[i + 2][2] in scores.hot
    if comma and not behind and not ahead:
        stop, last = tokens[i + 1][1], i + 1
        if i + 2 < n and len(tokens[i + 2][2]) == 1 and spaces(i + 1) and text[tokens[i + 2][1] : tokens[i + 2][1] + 1] == ".":
            stop, last = tokens[i + 2][1] + 1, i + 2
        if clear(start, stop, last):
            yield start, stop, least(i, usual + (0 if case != 2 else 1)), [(word, 0), (tokens[i + 1][2], 1)]
    # a name that a title begins: its given name is this token
    if i in sure and i + 1 < n and case != 2:
        j = i + 1
        if len(tokens[j][2]) == 1 and spaces(i) and gap(j).rstrip(" \t") == "." and j + 1 < n:
            j += 1
        if j < n and (j > i + 1 or spaces(i)) and _case(tokens[j][2]) == case and len(tokens[j][2]) > 2 and tokens[j][2].lower() not in NOT_PERSON and clear(start, tokens[j][1], j):
            yield start, tokens[j][1], TITLED, [(word, 1), (tokens[j][2], 0)]


def _other_scripts(text: str) -> list[tuple[int, int]]:
    """Names in other scripts behind a title: one or two words, up to a function word."""
    out = []
    for m in matches(OTHER_NAME, text, [k for x in _OTHER_STEMS for k in places(text, x)]):
        if _WORD.match(m[1]) or m[1] in ENDS_NAME or m[1] in NOT_PERSON_OTHER or m[2] in NOT_PERSON_OTHER:
            continue
        two = m[2] is not None and m[2] not in ENDS_NAME and not _WORD.match(m[2])
        if two and m[3] in NOT_PERSON_OTHER:
            continue
        out.append((m.start(1), m.end(2) if two else m.end(1)))
    return out
