"""Languages of documents, titles and lines: averaged hashed subword embeddings under a linear softmax.

The model is trained here, by stochastic gradient descent in numpy, on a bounded sample of labelled documents: the first
DOCS_PER_LANGUAGE of each language by hash of the id and of those SEGMENTS_PER_LANGUAGE segments. Labels are noisy and
pages carry the same foreign lines under every label, so a sentence counts for a label only if it does not stand word
for word in several documents, its frame (the sentence without names and numbers) stands mostly under that label, and
function words do not vote for another language. A first model then drops the segments that plainly contradict their
label, names the language of frames that stand under many labels, where it is sure, and a second is trained on both.
Names carry no language, so capitalised words are left out where enough others stand beside them. A language whose
labelled documents are in one script is only ever given to segments in that script.

Confidence is the softmax with a temperature fitted on held-out documents; a segment below MIN_CONFIDENCE is rejected
and has no say. A text is cut into sentences, and where a sentence mixes scripts, into stretches of one. Every segment
adds its letters to its language, and a line, a title or a text has the language with the most letters, whole texts
being read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ["bn", "en", "hi", "hi-Latn", "mr", "ta"]
#: Bounds of the training sample.
DOCS_PER_LANGUAGE, SEGMENTS_PER_LANGUAGE = 400, 1500
#: Texts of more characters than this are not taken as training samples, which bounds what comes to the driver.
TEXT_CHARS = 20_000
#: Hash buckets, embedding size, longest subword, rounds of training.
BUCKETS, SIZE, ORDER, EPOCHS = 1 << 17, 16, 5, 4
MIN_CONFIDENCE = 0.5
#: Letters a line needs to be reported.
MIN_LETTERS = 20
#: A sentence frame teaches a language under whose labels it has this share.
OWN_SHARE = 0.7
#: A sentence in this many documents of the sample teaches no language.
FURNITURE_DOCS = 3
CHUNK_CHARS = 400_000

# Label spellings by language.
SPELLINGS = {
    "en": "en|eng|english", "hi": "hi|hin|hindi", "hi-Latn": "hi-latn|hin-latn|hindi (latin)|hinglish|romanized hindi|hindi-latn",
    "mr": "mr|mar|marathi", "bn": "bn|ben|bengali|bangla", "ta": "ta|tam|tamil",
}
UNLABELLED = ["", "und"]
# Common function words of the languages that share a script with another one.
SEEDS = {
    "en": "the of and a to in is it you that was for on are with as they be at one have this from or had by not but what some we can out other were all there when up use your how said an each which do their time if will way about many then them would these so make see two has look more day could go come did no most people my over know than first been who its now find any new work part take get place made where after back only also may page site rights reserved last by us read print send search home contact help accepts decisions basis number visitor owned content revision form general does without notice cookies remember language improve these services policy staying agree accept reject keep session files visits count pages load faster schemes english careers tenders downloads gallery skip main hospitals medicines feedback login archive statement map news about privacy terms share follow daily updates friends website information copyright powered hosted designed viewed browser comments related previous next trending quick links",
    "hi-Latn": "hai hain ka ki ke ko se mein aur nahi nahin kya yeh woh bhi toh par tak liye kar karo karna karein wala wale wali apna apni apne mera meri hum hamare aap aapke tum raha rahi rahe tha thi ho hoga hogi gaya gayi gaye kuch sab sabhi bahut abhi jab tab agar lekin phir jaise kaise kahan kyun koi kisi unka uska iska isliye sirf pehle baad saath paas wahan yahan dena lena jaana aana milega milta hota hoti",
    "hi": "है हैं का की के को से में और नहीं क्या यह वह भी तो पर तक लिए कर करें करना वाला वाले वाली अपने अपना अपनी हम हमारा हमारी आप रहा रही रहे था थी हो होगा गया गई इस उस कुछ सभी बिना ने एक साथ पहले बाद कोई किसी जब तब अगर लेकिन फिर जैसे कैसे कहाँ क्यों ज़रूर अच्छा लगा पूरी इसका उपयोग न",
    "mr": "आहे आहेत आणि चा ची चे च्या ला ने मध्ये साठी नाही नाहीत हे हा ही ते तो ती येथे येथील मधील करा करावा करावे केले केली झाली झाले होते होता असे असा पण किंवा त्यांना आपल्या आपले पासून पर्यंत सर्व काही कोणतेही देऊ नका घेऊन या मिळते मिळतील कसे तर पूर्वी तसेच म्हणून आम्ही तुम्ही त्यांच्या वाचा",
}
SEED_SENTENCES = 400
_SENTENCE = re.compile(r"(?<=[.?!।॥])[\"'”’)]*\s+")
_LATIN = re.compile("[A-Za-z]")
_SCRIPTS = [(0x0980, 0x09FF), (0x0B80, 0x0BFF), (0x0900, 0x097F)]


def label_language(label: str | Column) -> Column:
    """The language a label names: a code of LANGS, "?" for any other, null where it is missing."""
    low = F.lower(F.trim(F.regexp_replace(label, "_", "-")))
    out = F.when(low.isNull() | low.isin(UNLABELLED), None)
    for lang, names in SPELLINGS.items():
        out = out.when(low.isin(names.split("|")), lang)
    return out.otherwise("?")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point, whether it is a letter, whether it stays in the features (letters and marks), its script."""
    cats = [unicodedata.category(chr(i))[0] for i in range(0x3000)]
    letter = np.zeros(0x110000, dtype=bool)
    keep = np.zeros(0x110000, dtype=bool)
    letter[:0x3000] = [c == "L" for c in cats]
    keep[:0x3000] = [c in "LM" for c in cats]
    for i in [*range(0x3000, 0x20000)]:
        letter[i] = keep[i] = unicodedata.category(chr(i))[0] == "L"
    script = np.where(letter, 5, 0).astype(np.int64)
    script[:0x250][letter[:0x250]] = 4
    for k, (a, b) in enumerate(_SCRIPTS):
        script[a : b + 1][letter[a : b + 1]] = k + 1
    return letter, keep, script


_TABLES: list = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.extend(_tables())
    return _TABLES[0], _TABLES[1], _TABLES[2]


def letters(text: str) -> int:
    return int(tables()[0][_points(text)].sum())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _script(word: str) -> int:
    for c in word:
        p = ord(c)
        for k, (a, b) in enumerate(_SCRIPTS):
            if a <= p <= b:
                return k + 1
        if c.isalpha():
            return 4 if p < 0x250 else 5
    return 0


def segments(line: str) -> list[str]:
    """Sentences; one that mixes scripts is cut into stretches of words in one script."""
    out = []
    for sentence in _SENTENCE.split(line):
        if not sentence:
            continue
        if sentence.isascii() or not _LATIN.search(sentence):
            out.append(sentence)
            continue
        stretch, script = [], 0
        for word in sentence.split():
            s = _script(word)
            if s and script and s != script:
                out.append(" ".join(stretch))
                stretch = []
            script = s or script
            stretch.append(word)
        out.append(" ".join(stretch))
    return out


def scripts_of(texts: list[str]) -> np.ndarray:
    """The script of most letters of each text: Bengali, Tamil, Devanagari, Latin, other (1 to 5); 0 without letters."""
    if not texts:
        return np.zeros(0, dtype=np.int64)
    points = _points("\n".join(texts) + "\n")
    which = np.cumsum(points == 10) - (points == 10)
    counts = np.bincount(which.astype(np.int64) * 6 + tables()[2][points], minlength=6 * len(texts)).reshape(-1, 6)[: len(texts)]
    counts[:, 0] = 0
    return np.where(counts.any(axis=1), counts.argmax(axis=1), 0)


def bare(text: str) -> str:
    """Without capitalised words if two others of three letters or more remain."""
    if not any("A" <= c <= "Z" for c in text):
        return text
    words = re.findall(r"[^\W\d_][^\W_]*[^\s\d]*", text)
    plain = [w for w in words if not w[0].isupper()]
    return " ".join(plain) if sum(len(w) > 2 for w in plain) >= 2 else text


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of every subword of 1 to ORDER characters; words are bounded by spaces."""
    points = _points("\n".join(f" {bare(t).lower()} " for t in texts) + "\n")
    which = np.cumsum(points == 10) - (points == 10)
    codes = np.where(tables()[1][points], points, 32).astype(np.uint64)
    # runs of spaces count once
    same = np.concatenate(([False], (codes[1:] == 32) & (codes[:-1] == 32) & (which[1:] == which[:-1])))
    codes, which = codes[~same], which[~same]
    grams, owners = [], []
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, ORDER + 1):
        rolled = (rolled[: len(codes) - n + 1] if n > 1 else rolled) * np.uint64(1_000_003) + codes[n - 1 :]
        inside = which[: len(rolled)] == which[n - 1 :]
        mixed = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        grams.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS))[inside].astype(np.int64))
        owners.append(which[n - 1 :][inside])
    return np.concatenate(grams), np.concatenate(owners)


@dataclass
class Model:
    """Scores of every bucket for every language (embedding times weights), the bias and the temperature."""

    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Which language may be given to which script (row).
    scripts: np.ndarray
    held_out_accuracy: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(LANGS)))
        grams, owners = features(texts)
        counts = np.maximum(np.bincount(owners, minlength=len(texts)), 1)
        picked = self.scores[grams]
        sums = np.stack([np.bincount(owners, weights=picked[:, k], minlength=len(texts)) for k in range(len(LANGS))], axis=1)
        z = sums / counts[:, None] + self.bias
        return np.where(self.scripts[scripts_of(texts)], z, -60.0)

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its calibrated confidence."""
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        p /= p.sum(axis=1, keepdims=True) if len(z) else 1
        return p.argmax(axis=1), p.max(axis=1)


def _same(segment: str) -> str:
    return re.sub(r"[\W\d_]+", " ", segment).strip().lower()


def frame(segment: str) -> str:
    """A sentence without capitalised words, digits and punctuation."""
    words = [w for w in re.split(r"[\W\d_]+", segment) if w and not ("A" <= w[0] <= "Z")] or re.split(r"[\W\d_]+", segment)
    long = [w for w in words if not any(ord(c) > 0x900 for c in w)] if segment.isascii() else re.findall(r"[^\s\d]+", segment)
    if not segment.isascii():
        # scripts without capitals: the words that carry a sentence are its shorter ones
        long = sorted(long, key=len)[: max(2, len(long) * 2 // 3)]
    return " ".join(long).lower()


def seed_sentences(seed: int) -> list[tuple[int, str]]:
    """Short runs of function words, drawn by a fixed seed."""
    rng = np.random.default_rng(seed)
    return [(LANGS.index(lang), " ".join(rng.choice(words.split(), rng.integers(3, 9)))) for lang, words in SEEDS.items() for _ in range(SEED_SENTENCES)]


_SEED_WORDS = {lang: set(words.split()) for lang, words in SEEDS.items()}


def vote(segment: str) -> str | None:
    """The language with the most function words in a segment, if one has more than all others."""
    words = re.findall(r"[^\s\d.,;:!?|/()\"]+", segment.lower())
    counts = sorted(((sum(w in own for w in words), lang) for lang, own in _SEED_WORDS.items()), reverse=True)
    return counts[0][1] if counts[0][0] > counts[1][0] else None


def _fit(texts: list[str], labels: np.ndarray, scripts: np.ndarray, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    weights = rng.normal(0, 0.1, (SIZE, len(LANGS))).astype(np.float32)
    bias = np.zeros(len(LANGS), dtype=np.float32)
    # subwords of every text, once; a text without any has the bucket of nothing
    grams, owners = features(texts)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(texts))
    parts = [g if len(g) else np.zeros(1, dtype=np.int64) for g in np.split(grams[order], np.cumsum(counts)[:-1])]
    batch, steps = 32, EPOCHS * max(1, -(-len(texts) // 32))
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(texts))
        for at in range(0, len(shuffled), batch):
            rate = 0.6 * (1 - step / steps)
            mine = shuffled[at : at + batch]
            sizes = np.array([len(parts[i]) for i in mine])
            used = np.concatenate([parts[i] for i in mine])
            mean = np.add.reduceat(emb[used], np.cumsum(sizes) - sizes) / sizes[:, None].astype(np.float32)
            z = mean @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(mine)), labels[mine]] -= 1
            back = (-rate * 8 * (p @ weights.T) / sizes[:, None]).astype(np.float32)
            weights -= rate / 4 * (mean.T @ p)
            bias -= rate / 16 * p.sum(axis=0)
            # a bucket's changes are summed before they are added
            by = np.argsort(used, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], used[by][1:] != used[by][:-1])))
            emb[used[by][first]] += np.add.reduceat(np.repeat(back, sizes, axis=0)[by], first)
            step += 1
    return Model(emb @ weights, bias, 1.0, scripts)


def train(sample: list[tuple[str, str, str]], seed: int = 7) -> Model:
    """A model from (id, language, text) rows; every fifth document is held out for the temperature and the accuracy."""
    rows = sorted(sample)
    cut = [(n, lang, [s for line in text.split("\n") for s in segments(line) if letters(s) >= 8]) for n, (_, lang, text) in enumerate(rows)]
    docs = Counter(lang for _, lang, _ in cut)
    # what stands word for word in several documents is site furniture, of whatever language
    repeated = Counter(k for _, _, parts in cut for k in {_same(p) for p in parts})
    under: dict[str, Counter] = defaultdict(Counter)
    for _, lang, parts in cut:
        for f in {frame(s) for s in parts}:
            under[f][lang] += 1 / docs[lang]
    by_script = np.zeros((6, len(LANGS)))
    all_parts = list(dict.fromkeys(p for _, _, parts in cut for p in parts))
    script = dict(zip(all_parts, scripts_of(all_parts).tolist()))
    for _, lang, parts in cut:
        for p in parts:
            by_script[script[p], LANGS.index(lang)] += len(p)
    scripts = by_script == by_script.max(axis=0, keepdims=True)
    scripts[0] = True
    scripts[5] |= ~scripts[5].any()
    fits = lambda s, lang: scripts[script[s], LANGS.index(lang)]
    own = lambda s, lang: fits(s, lang) and vote(s) in (None, lang) and repeated[_same(s)] < FURNITURE_DOCS and under[frame(s)][lang] >= OWN_SHARE * sum(v for k, v in under[frame(s)].items() if fits(s, k))
    fit: dict[str, list[str]] = {lang: [] for lang in LANGS}
    held: dict[str, list[str]] = {lang: [] for lang in LANGS}
    shared: dict[str, str] = {}
    for n, lang, parts in cut:
        side = held if n % 5 == 0 else fit
        for p in dict.fromkeys(parts):
            if own(p, lang):
                if len(side[lang]) < SEGMENTS_PER_LANGUAGE:
                    side[lang].append(p)
            elif len(shared) < 2 * SEGMENTS_PER_LANGUAGE:
                shared.setdefault(frame(p), p)
    taught = {lang for lang in LANGS if fit[lang]}
    for n, lang, parts in cut:  # a language whose every sentence repeats is taught by those
        if n % 5 and lang not in taught and len(fit[lang]) < SEGMENTS_PER_LANGUAGE:
            fit[lang] += [p for p in parts if fits(p, lang)]
    seeds = seed_sentences(seed)
    texts = [s for lang in LANGS for s in fit[lang]] + [s for _, s in seeds]
    labels = np.array([k for k, lang in enumerate(LANGS) for _ in fit[lang]] + [k for k, _ in seeds], dtype=np.int64)
    if not any(fit.values()):
        return Model(np.zeros((BUCKETS, len(LANGS)), dtype=np.float32), np.zeros(len(LANGS), dtype=np.float32), 1.0, np.ones((6, len(LANGS)), dtype=bool))
    first = _fit(texts, labels, scripts, seed)
    top, _ = first.classify(texts)
    clean = np.flatnonzero(top == labels)
    more, sure = first.classify(list(shared.values()))
    extra = np.flatnonzero(sure >= 0.8)
    again = [texts[i] for i in clean] + [list(shared.values())[i] for i in extra]
    model = _fit(again, np.concatenate([labels[clean], more[extra]]), scripts, seed + 1) if again else first
    hold = [s for lang in LANGS for s in held[lang][:500]]
    truth = np.array([k for k, lang in enumerate(LANGS) for _ in held[lang][:500]], dtype=np.int64)
    if len(hold):
        agreed = first.classify(hold)[0] == truth  # the same cleaning for the held-out labels
        z = model.logits(hold)
        model.held_out_accuracy = float((z.argmax(axis=1) == truth)[agreed].mean()) if agreed.any() else 0.0

        def loss(t: float) -> float:
            y = z[agreed] / t
            y = y - y.max(axis=1, keepdims=True)
            return float(-(y[np.arange(len(y)), truth[agreed]] - np.log(np.exp(y).sum(axis=1))).mean())

        if agreed.any():
            model.temperature = min((0.1 * 1.15**k for k in range(40)), key=loss)
    return model


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded training sample: id, lang, text of at most TEXT_CHARS.

    Ids are ranked in the label table alone; texts are then read for the ranked ids, a table of fixed size. Longer texts
    teach nothing and so do ids without a document, so twice as many ids are ranked as are taken.
    """
    named = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("lang").alias("_l")).select("doc_id", label_language("_l").alias("lang")).where(F.col("lang").isin(LANGS))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = named.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2 * DOCS_PER_LANGUAGE)
    rows = docs.where((F.length("text") > 0) & (F.length("text") <= TEXT_CHARS)).select("doc_id", "text", "crawled_at").join(F.broadcast(ids), "doc_id")
    newest = rows.groupBy("lang", "_r", "doc_id").agg(F.max_by("text", F.struct("crawled_at", "text")).alias("text"))
    taken = Window.partitionBy("lang").orderBy("_r", "doc_id")
    return newest.withColumn("_r", F.row_number().over(taken)).where(F.col("_r") <= DOCS_PER_LANGUAGE).select("doc_id", "lang", "text")


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The sample has at most DOCS_PER_LANGUAGE documents of TEXT_CHARS for each of the six languages, whatever the corpus has."""
    return train([(r["doc_id"], r["lang"], r["text"]) for r in labelled(docs, labels).collect()])


PARTS = "doc_id string, line_no int, lang string, confidence double, letters int, text_lang string"


def _majority(tally: np.ndarray, sure: np.ndarray) -> tuple[str, float]:
    if not tally.any():
        return "und", 0.0
    k = int(tally.argmax())
    return LANGS[k], float(sure[k] / tally[k])


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line_no, lang, confidence, letters, text_lang: -1 is the whole text, 0 the title, 1 and up its lines.

    Lines and titles without a letter have no row; text_lang is the language of the whole text again.
    Null and empty texts are of language "und" with confidence 0, and so is what the model rejects throughout. The
    confidence is the mean over the letters of the winning language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(ids: list, texts: list, titles: list, model: Model) -> list[tuple]:
        units: list[tuple[int, int]] = []  # (document, line) of each segment
        parts: list[str] = []
        for d, (text, title) in enumerate(zip(texts, titles)):
            for no, line in [(0, title or ""), *enumerate((text or "").split("\n"), 1)]:
                for s in segments(line):
                    units.append((d, no))
                    parts.append(s)
        top, sure = model.classify(parts)
        joined = _points("\n".join(parts) + "\n") if parts else np.zeros(0, dtype=np.uint32)
        size = np.bincount((np.cumsum(joined == 10) - (joined == 10))[tables()[0][joined]], minlength=len(parts)) if parts else []
        tallies: dict[tuple[int, int], list[np.ndarray]] = {}
        for k, unit in enumerate(units):
            if not size[k]:
                continue
            for key in (unit, (unit[0], -1)) if unit[1] else (unit,):
                t = tallies.setdefault(key, [np.zeros(len(LANGS)), np.zeros(len(LANGS)), np.zeros(1)])
                t[2][0] += size[k]
                if sure[k] >= MIN_CONFIDENCE:
                    t[0][top[k]] += size[k]
                    t[1][top[k]] += size[k] * sure[k]
        for d in range(len(ids)):
            tallies.setdefault((d, -1), [np.zeros(len(LANGS)), np.zeros(len(LANGS)), np.zeros(1)])
        best = {key: _majority(t[0], t[1]) for key, t in tallies.items()}
        return [(ids[d], no, *best[d, no], int(t[2][0]), best[d, -1][0]) for (d, no), t in tallies.items()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for frame in frames:
            at = size = 0
            ids, texts, titles = frame["doc_id"].tolist(), frame["text"].tolist(), frame["title"].tolist()
            for i in range(len(ids)):
                size += len(texts[i] or "") + 1
                if size >= CHUNK_CHARS or i + 1 == len(ids):
                    yield pd.DataFrame(rows(ids[at : i + 1], texts[at : i + 1], titles[at : i + 1], model), columns=["doc_id", "line_no", "lang", "confidence", "letters", "text_lang"])
                    at, size = i + 1, 0

    return docs.select("doc_id", "text", "title").mapInPandas(run, PARTS)


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, line_no, lang: -1 for missing or wrong labels, 0 for titles and 1 and up for lines in another language."""
    rows = docs.where(F.col("doc_id").isNotNull())
    parts = detect(rows, trained(rows, labels)).where((F.col("lang") != "und") & (F.col("text_lang") != "und"))
    other = F.col("lang") != F.col("text_lang")
    cases = parts.where((F.col("line_no") == -1) | (F.col("line_no") == 0) & other | (F.col("line_no") > 0) & other & (F.col("letters") >= MIN_LETTERS))
    named = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("lang").alias("_label"))
    joined = cases.join(named, "doc_id", "left").withColumn("_named", label_language("_label"))
    wrong = F.col("_named").isNull() | (F.col("_named") != F.col("lang"))
    return joined.where((F.col("line_no") >= 0) | wrong).select("doc_id", "line_no", "lang").distinct()
