"""Scoring texts for abusive, hateful or sexual language by cumulative-link ordinal regression.

Texts are cut into sentences, which are undisguised (letters set apart, digits for letters, stretched letters, masked
words), and long sentences into overlapping windows; a document scores as its worst window. A window's features are its
words, pairs of neighbouring words and letter groups within words, all sparse. One weight vector serves all grades:
with thresholds b1 < b2 < b3, P(grade >= k) = logistic(w.x - bk), and the score is the expected grade, from 0 to 3.

The model is trained when it is used, on graded sentences composed from the seed lists of `severity_seeds` and, as
grade 0, on windows of a bounded sample of the corpus, each as itself and mistyped: of about `sample_docs` documents
chosen by hash at most `sample_windows` each. As the sample is not clean, it is cut in two and each half judged by a model
that has seen only the other: what that takes for abuse is left out, more readily if few documents hold it. A round of
self-training follows: of about `mined_docs` documents chosen by hash the `mined_windows` worst windows each that reach
the threshold are fitted as what they were scored, so that the model learns the surroundings of what it knows. What is
common in the sample weighs little, so that words of abuse aren't outweighed by the words around them. All documents are
scored whole, in Arrow batches: each distinct sentence of a batch is cut into words once, and all windows of the batch
are summed at once as products of a sparse matrix with the weights.

Defined results: null and empty texts score 0; a text of any length is read to its end; copies score alike; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import severity_seeds as seeds

#: Documents with a window of at least this expected grade, the middle between the grades 0 and 1, are reported.
THRESHOLD = 0.5
#: Corpus windows of at least this grade, times the root of the number of sampled documents that hold them, but at most the
#: second, aren't taken for ordinary ones when the model is fitted.
UNSURE, SURE = 0.3, 0.9
#: Weights of an ordinary row, times the root of the number of documents up to `OFTEN`, and of a mined row of the corpus,
#: where all abusive seeds together weigh 1.5 and all harmless ones 1; the mistyped copies of a row weigh as much as it does.
ORDINARY_ROW, MINED_ROW = 1 / 36_000, 1 / 650
OFTEN, COPIES = 30, 2
#: Parts of the sample, each judged by a model fitted without it.
PARTS = 2
WINDOW, STEP = 16, 8
#: Characters written for letters.
STAND_INS = str.maketrans("0134578@$+!|", "oieastbastil")
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвАВЕКМНОРСТУХІЅαοερυι", "aeopcyxijsdhkmtbABEKMHOPCTYXISaoepui")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-_·]){2,}[^\W\d_]?(?![^\W_])[.]*")
_GAPPED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_][\w@$+!|*]*(?:['’-][\w@$+!|*]+)*|[@$+!|*]+[^\W_][\w@$+!|*]*")
_END = re.compile(r"[.!?;:\n]+(?=\s|$|[\"'“”»])|\n+|\s//\s|\s--\s")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
MASK = "<mask>"


def sentences(text: str) -> list[str]:
    """The pieces of a text that are looked at on their own."""
    return [x for x in _END.split(text) if x]


@lru_cache(maxsize=300_000)
def _plain(token: str) -> tuple[str, ...]:
    """The words of a lower-case token, none if it is a number or a code."""
    if token.isalpha():
        return (_LONG.sub(r"\1", token),)
    t = token.rstrip("!|+$@")
    if t and not t.isalpha() and "*" not in t and any(c.isalpha() for c in t) and any(c.isdigit() or c in "@$+!|" for c in t):
        t = t.translate(STAND_INS)
    t = _LONG.sub(r"\1", t)
    if not t or any(c.isdigit() for c in t):
        return ()
    return tuple(p for p in re.split(r"['’-]", t) if p) if "-" in t and "*" not in t else (t,)


def words_of(sentence: str) -> list[str]:
    """The undisguised lower-case words of a sentence; masked words keep their asterisks."""
    if not sentence.isascii():
        sentence = sentence.translate(LOOKALIKES)
    sentence = _SPACED.sub(lambda m: re.sub(r"[.\-_·]", "", m.group()) + " ", sentence)
    sentence = _GAPPED.sub(lambda m: m.group().replace(" ", ""), sentence).lower()
    return [w for t in _TOKEN.findall(sentence) for w in _plain(t)]


def plain_words(text: str) -> list[list[str]]:
    """The words of each sentence that has any."""
    return [w for x in sentences(text) if (w := words_of(x))]


def windows(sentences: list[list[str]]) -> Iterator[list[str]]:
    for s in sentences:
        if len(s) <= WINDOW:
            yield s
        else:
            for a in range(0, len(s) - STEP, STEP):
                yield s[a : a + WINDOW]


def letters(word: str) -> list[str]:
    w = f"^{word}$"
    return ["#" + w[i : i + 4] for i in range(len(w) - 3)] if len(word) >= 4 else []


def word_features(word: str) -> list[str]:
    if "*" in word:
        return [MASK]
    return [word, *letters(word)]


def pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])] + [f"{a} _ {b}" for a, b in zip(words, words[2:])]


class Masks:
    """The likeliest of the seeds' words for a masked one, by its first letter, length and last letter; seeds' words cut in two are joined."""

    def __init__(self, rows: list[tuple[list[str], int]]):
        n = Counter(w for words, grade in rows if grade for w in words if w.isalpha() and len(w) > 3)
        self.words: dict[tuple, str] = {}
        self.long = {w for w in n if len(w) > 4}
        self.whole = {w for words, _ in rows for w in words}
        for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0])):
            self.words.setdefault((w[0], len(w), w[-1]), w)
            self.words.setdefault((w[0], len(w), "*"), w)

    def join(self, words: list[str]) -> list[str]:
        """Words with neighbours joined that make a seed word together and aren't both words themselves."""
        out: list[str] = []
        for w in words:
            if out and out[-1] + w in self.long and not (w in self.whole and out[-1] in self.whole):
                out[-1] += w
            else:
                out.append(w)
        return out

    def open(self, words: list[str]) -> list[str]:
        return [x for w in self.join(words) for x in ([self.words.get((w[0], len(w), w[-1]), MASK), MASK] if "*" in w else [w])]


def _blurred(words: list[str], rng: random.Random, masked: bool) -> list[str]:
    """A copy with one word mistyped or, of abuse, masked."""
    long = [i for i, w in enumerate(words) if len(w) > 3 and w.isalpha()]
    if not long:
        return words
    i = rng.choice(long)
    w, k = words[i], rng.randrange(1, len(words[i]) - 1)
    new = rng.choice([w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[: k - 1] + w[k] + w[k - 1] + w[k + 1 :], *([w[0] + "*" * (len(w) - 2) + w[-1], w[0] + "*" * (len(w) - 1)] if masked else [])])
    return [*words[:i], new, *words[i + 1 :]]


class Ordinal:
    """Cumulative-link regression with shared weights; features by name."""

    def __init__(self, grades: int = 3, scale: Callable[[str], float] = lambda f: 1.0):
        self.index: dict[str, int] = {}
        self.scale = scale
        self.cuts = np.arange(grades) * 1.0

    def fit(self, rows: list[list[str]], grades: np.ndarray, weight: np.ndarray, epochs: int = 200, rate: float = 0.5, decay: float = 2e-5) -> None:
        """Fit, from where an earlier fit ended."""
        start, count = dict(getattr(self, "weights", {})), Counter(f for r in rows for f in set(r))
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 2))}
        held = [[i for f in set(r) if (i := self.index.get(f)) is not None] for r in rows]
        row = np.repeat(np.arange(len(rows)), [len(x) for x in held])
        col = np.fromiter((i for x in held for i in x), np.int64, len(row))
        del held
        scale = np.array([self.scale(f) for f in self.index])
        val = scale[col]
        w, hw, hb = np.array([start.get(f, 0.0) for f in self.index]) / scale, np.full(len(self.index), 1e-8), np.full(len(self.cuts), 1e-8)
        b = self.cuts if start else np.array([1.0, 2.0, 3.0])[: len(self.cuts)]
        above = grades[:, None] > np.arange(len(self.cuts))[None, :]
        total = weight.sum()
        for _ in range(epochs):
            z = np.bincount(row, w[col] * val, len(rows))
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - b[None, :], -30, 30)))
            err = (p - above) * weight[:, None] / total
            gw = np.bincount(col, err.sum(1)[row] * val, len(w)) + decay * w
            gb = -err.sum(0)
            hw += gw**2
            hb += gb**2
            w -= rate * gw / np.sqrt(hw)
            b = np.sort(b - rate * gb / np.sqrt(hb))
        self.cuts = b
        self.weights = {f: float(w[i] * scale[i]) for f, i in self.index.items() if abs(w[i] * scale[i]) > 1e-4}


class Scorer:
    """The fitted model as lookup tables; words are weighed once and remembered."""

    #: Words and sentences that a worker remembers at most; beyond that it begins anew, with the same results.
    WORDS, SENTENCES = 500_000, 200_000

    def __init__(self, weights: dict[str, float], cuts: list[float], masks: Masks):
        self.weights, self.cuts, self.masks = weights, np.array(cuts), masks
        pair = {f: v for f, v in weights.items() if " " in f}
        ends = sorted({x for f in pair for x in (f.split(" ")[0], f.split(" ")[-1])})
        self.place = {w: i + 1 for i, w in enumerate(ends)}  # 0: a word of no pair
        self.n = len(ends) + 1
        self.near, self.far = (self._table({f: v for f, v in pair.items() if (" _ " in f) == far}) for far in (False, True))
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.places: list[int] = []
        self.known: dict[str, float] = {}

    def _table(self, pairs: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([self.place[f.split(" ")[0]] * self.n + self.place[f.split(" ")[-1]] for f in pairs], np.int64)
        order = np.argsort(keys)
        return np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(list(pairs.values()))[order], 0.0)

    def _id(self, w: str) -> int:
        i = self.ids[w] = len(self.scores)
        self.scores.append(sum(self.weights.get(f, 0.0) for f in word_features(w)))
        self.places.append(self.place.get(w, 0))
        return i

    def _worst(self, texts: list[str]) -> np.ndarray:
        """w.x of the worst window of each sentence, -inf without words; features of words count once a window, as in training."""
        flat, sizes, ids = [], [], self.ids
        for t in texts:
            words = self.masks.open(words_of(t))
            sizes.append(len(words))
            for w in words:
                i = ids.get(w)
                flat.append(self._id(w) if i is None else i)
        out = np.full(len(texts), -np.inf)
        if not flat:
            return out
        word, size = np.array(flat, np.int64), np.array(sizes, np.int64)
        score, place = np.array(self.scores)[word], np.array(self.places, np.int64)[word]
        begin = np.cumsum(size) - size
        # Where the same word stood before.
        order = np.lexsort([np.arange(len(word)), word])
        before = np.full(len(word), -1, np.int64)
        same = word[order][1:] == word[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        sums = [score]
        for gap, (keys, values) in ((1, self.near), (2, self.far)):
            key = place[:-gap] * self.n + place[gap:] if len(place) > gap else place[:0]
            at = np.searchsorted(keys, key)
            hit = np.where((keys[at] == key) & (place[:-gap] > 0) & (place[gap:] > 0), values[at], 0.0) if len(key) else np.zeros(0)
            sums.append(np.concatenate([hit, np.zeros(len(place) - len(hit))]))
        # All windows as rows of (window, position).
        many = np.where(size <= WINDOW, (size > 0).astype(np.int64), -(-(size - STEP) // STEP))
        of = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        start = begin[of] + nth * STEP
        stop = np.minimum(start + WINDOW, begin[of] + size[of])
        length = stop - start
        row = np.repeat(np.arange(len(of)), length)
        pos = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + start[row]
        value = np.where(before[pos] < start[row], sums[0][pos], 0.0) + np.where(pos + 1 < stop[row], sums[1][pos], 0.0) + np.where(pos + 2 < stop[row], sums[2][pos], 0.0)
        np.maximum.at(out, of, np.bincount(row, value, len(of)))
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Expected grade of the worst window of each text."""
        if len(self.scores) > self.WORDS or len(self.known) > self.SENTENCES:
            self._forget()
        pieces = [sentences(t) if t else [] for t in texts]
        new = list(dict.fromkeys(x for p in pieces for x in p if x not in self.known))
        fresh = dict(zip(new, self._worst(new).tolist()))
        known = self.known
        worst = np.array([max((fresh[x] if x in fresh else known[x] for x in p), default=-np.inf) for p in pieces])
        known.update((x, z) for x, z in fresh.items() if len(x) <= 300)
        return (1 / (1 + np.exp(-(np.clip(worst, -50, 50)[:, None] - self.cuts)))).sum(1) * (worst > -np.inf)

    def window(self, words: list[str]) -> float:
        """Expected grade of a window of words."""
        return self.text(" ".join(words))

    def text(self, text: str | None) -> float:
        """Expected grade of one text."""
        return float(self.texts([text])[0])


def seed_rows(seed: int = 11, per_template: int = 14, templates: list[tuple[int, str]] | None = None) -> list[tuple[list[str], int]]:
    """Graded sentences composed from the seed lists, with mistyped and masked copies."""
    rng = random.Random(seed)
    rows = []
    for grade, text in seeds.sentences(rng, per_template, templates):
        for words in windows(plain_words(text)):
            rows += [(words, grade), (_blurred(words, rng, grade > 0), grade)]
    return rows


def _features(words: list[str], masks: Masks) -> list[str]:
    words = masks.open(words)
    return [sys.intern(f) for f in [f for w in set(words) for f in word_features(w)] + pairs(words)]


def _scale(rows: list[list[str]]) -> Callable[[str], float]:
    """How far a feature can reach: letter groups less than words, and all the less, the more corpus rows hold it."""
    held, most = Counter(f for r in rows for f in set(r)), np.log1p(max(len(rows), 5000))
    return lambda f: (0.4 if f[0] == "#" else 1.0) * max(0.05, 1 - np.log1p(held[f]) / most)


def train(sample: list[list[str]], templates: list[tuple[int, str]] | None = None, mine: Callable[[Scorer], list[tuple[str, float]]] | None = None) -> Scorer:
    """Fit on the seeds and on corpus windows, given once for each document that holds them, as grade 0, without those taken for abuse, and with what `mine` finds."""
    graded = seed_rows(templates=templates)
    masks = Masks(graded)
    own = [(_features(w, masks), g) for w, g in graded]
    n_bad, n_good = sum(g > 0 for _, g in own), sum(g == 0 for _, g in own)
    held = Counter(map(tuple, sample))
    texts, times, rng = [" ".join(w) for w in held], np.array(list(held.values()), float), random.Random(5)
    rest = [[_features(list(w), masks), *(_features(_blurred(list(w), rng, False), masks) for _ in range(COPIES))] for w in held]
    part = np.array([zlib.crc32(t.encode()) % PARTS for t in texts], int)
    share = ORDINARY_ROW * np.sqrt(np.minimum(times, OFTEN))
    limit = np.minimum(UNSURE * np.sqrt(times), SURE)

    def fit(m: Ordinal, keep: np.ndarray, found: list[tuple[str, float]], first: bool) -> Scorer:
        kept = [(f, share[i] / (COPIES if j else 1)) for i in np.flatnonzero(keep) for j, f in enumerate(rest[i])]
        # A row without features stands for what the model doesn't know: it is harmless until something speaks against it.
        rows = [f for f, _ in own] + [f for f, _ in kept] + [_features(w.split(" "), masks) for w, _ in found] + [[]]
        grades = np.array([g for _, g in own] + [0] * len(kept) + [min(3, max(1, round(e))) for _, e in found] + [0])
        # Abusive and harmless seeds have the same say whatever their number; each row of the corpus has a fixed one.
        weight = np.array([1.5 / n_bad if g else 1 / n_good for _, g in own] + [w * (0.6 if first else 1) for _, w in kept] + [MINED_ROW] * len(found) + [0.5]) * len(rows)
        m.fit(rows, grades, weight, epochs=150 if first else 60)
        return Scorer(m.weights, m.cuts.tolist(), masks)

    keep, scale = np.ones(len(texts), bool), _scale([r[0] for r in rest])
    models = [Ordinal(scale=scale) for _ in range(PARTS if texts else 1)]
    for first in (True, False):
        judged = keep.copy()
        for k, m in enumerate(models):
            s, those = fit(m, keep & (part != k), [], first), np.flatnonzero(part == k)
            judged[those] = s.texts([texts[i] for i in those]) < limit[those]
        keep = judged
    s = fit(models[0], keep, [], False)
    return fit(models[0], keep, mine(s), False) if mine else s


def _chosen(docs: DataFrame, doc_id: str, text: str, about: int) -> DataFrame:
    """The texts of about so many documents, chosen by the hash of their ids alone."""
    share = min(1.0, about / max(docs.count(), 1))
    return docs.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < round(share * 1_000_000))).select(F.col(text).alias("text"))


def corpus_sample(docs: DataFrame, doc_id: str, text: str, sample_docs: int, sample_windows: int) -> list[list[str]]:
    """Windows of a bounded number of documents, spread over each text, once for each document that holds them."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                w = list(windows(plain_words(t)))
                out += {" ".join(x) for x in w[:: max(1, -(-len(w) // sample_windows))]}
            yield pd.DataFrame({"words": out}, dtype="string")

    held = _chosen(docs, doc_id, text, sample_docs).mapInPandas(cut_up, "words string").groupBy("words").count().orderBy("words").collect()
    return [words for r in held for words in [r["words"].split(" ")] * r["count"]]


def mined(docs: DataFrame, doc_id: str, text: str, scorer: Scorer, mined_docs: int, mined_windows: int) -> list[tuple[str, float]]:
    """Distinct windows of a bounded number of documents that reach the threshold, with their expected grades."""
    model = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.cuts.tolist(), scorer.masks))

    def worst(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(*model.value)
        for pdf in batches:
            out: dict[str, float] = {}
            texts = pdf["text"].tolist()
            for t, e in zip(texts, s.texts(texts)):
                if e >= THRESHOLD:
                    w = [" ".join(x) for x in windows(plain_words(t))]
                    order = sorted(zip(s.texts(w).tolist(), w), reverse=True)[:mined_windows]
                    out.update((x, z) for z, x in order if z >= THRESHOLD)
            yield pd.DataFrame({"words": list(out), "grade": list(out.values())}).astype({"words": "string", "grade": "float64"})

    found = _chosen(docs, doc_id, text, mined_docs).mapInPandas(worst, "words string, grade double").groupBy("words").agg(F.max("grade").alias("grade")).orderBy("words").collect()
    return [(r.words, r.grade) for r in found]


def score_documents(docs: DataFrame, doc_id: str, text: str, *keep: str, sample_docs: int = 3000, sample_windows: int = 12, mined_docs: int = 20_000, mined_windows: int = 3) -> DataFrame:
    """(doc_id, keep..., severity) of every document; see the module's docstring for the bounds of the training sample."""
    scorer = train(corpus_sample(docs, doc_id, text, sample_docs, sample_windows), mine=lambda s: mined(docs, doc_id, text, s, mined_docs, mined_windows))
    model = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.cuts.tolist(), scorer.masks))
    kept = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(*model.value)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(severity=np.round(s.texts([t if isinstance(t, str) else None for t in pdf["text"]]), 4))

    return kept.mapInPandas(score, ", ".join(f"`{c}` {types[c]}" for c in ("doc_id", *keep)) + ", severity double")
