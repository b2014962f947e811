"""Language of whole texts, and of the spans of mixed-language texts.

Training counts hashed character n-grams of words per language, and which scripts
a language's letters come from. A word's score for a language is the log
probability of its n-grams; the script of its letters, told by code point ranges,
narrows the languages that score at all. A Viterbi pass over a text's words with a
penalty for every switch labels spans; the prediction is the language that most
letters of the text are labelled with.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, evaluated_once
from .units import UnitEncoder, as_texts, slices

#: First code points of script ranges, in order.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_STARTS = np.array([x for x, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])
GRAMS = (1, 2, 3)
BUCKETS = 1 << 16
#: Words scored at a time: few enough that the arrays stay in a processor's cache.
LOT = 4096


@cache
def _kinds() -> np.ndarray:
    """The script of every code point, -1 where it is no letter."""
    points = range(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in points), dtype=bool, count=len(points))
    script = _SCRIPT[np.searchsorted(_STARTS, np.arange(len(points)), side="right") - 1]
    return np.where(letter, script, -1).astype(np.int8)


def _flat(words: list):
    """Code points of ^word$ for all words, the words' numbers, letter counts and
    the script of most letters (-1: no letter)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    points = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(words)), lengths)
    kind = _kinds()[points]
    at = np.flatnonzero(kind >= 0)
    mine, kind = owner[at], kind[at]
    letters = np.bincount(mine, minlength=len(words))
    seen = np.flatnonzero(np.bincount(kind, minlength=len(SCRIPTS)))
    if len(seen) < 2:
        return points, owner, letters, np.where(letters > 0, seen[0] if len(seen) else -1, -1)
    votes = np.bincount(mine * len(seen) + np.searchsorted(seen, kind), minlength=len(words) * len(seen))
    votes = votes.reshape(len(words), len(seen))
    return points, owner, letters, np.where(letters > 0, seen[votes.argmax(axis=1)], -1)


def _grams(points: np.ndarray, owner: np.ndarray):
    """(word number, bucket) of every n-gram within a word."""
    for n in GRAMS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
        for i in range(n):
            h ^= points[i : i + size]
            h *= np.uint64(0x2545F4914F6CDD1D)
            h ^= h >> np.uint64(29)
        inside = owner[:size] == owner[n - 1 :]
        yield owner[:size][inside], (h[inside] >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


@dataclass
class LanguageModel:
    """``score[language, bucket]``: log probabilities; ``scripts[language, script]``:
    whether the language is written in it."""

    languages: list
    score: np.ndarray
    scripts: np.ndarray
    switch_penalty: float = 12.0

    def words(self, words: list):
        """Scores per word and language, letter counts, and whether some language is
        written in the word's script. The script narrows the languages that score at
        all; the others stand far below the worst of them."""
        lots = [self._lot(words[i : i + LOT]) for i in range(0, len(words), LOT)] or [self._lot([])]
        return tuple(np.concatenate(x) for x in zip(*lots))

    def _lot(self, words: list):
        points, owner, letters, script = _flat(words)
        allowed = np.where(script >= 0, self.scripts[:, np.maximum(script, 0)], False)
        known = allowed.any(axis=0)
        some = allowed.any(axis=1)
        every = (allowed | ~known).all(axis=1)  # words of no known script are set to 0 below
        out = np.full((len(self.languages), len(words)), np.inf)
        out[allowed] = 0.0
        for word, bucket in _grams(points, owner):
            for k in np.flatnonzero(some):
                at, found = word, bucket
                if not every[k]:
                    mine = allowed[k, word]
                    at, found = word[mine], bucket[mine]
                out[k] += np.bincount(at, weights=self.score[k].take(found), minlength=len(words))
        out /= len(GRAMS)
        worst = np.where(known, out.min(axis=0), 0.0) - 20.0
        out = np.where(allowed, out, worst)
        out[:, ~known] = 0.0
        return out.T, letters, known


def train(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    max_documents: int = 20_000,
) -> LanguageModel | None:
    """Fit on whole texts of at most about ``max_documents`` labelled rows, those
    with the least hash of the id; all of them where there are fewer. Rows with
    null text or label are passed over; None where no row is left."""
    rows = bounded_batches(docs).select(
        F.xxhash64(F.col(id_column).cast("long")).alias("h"),
        F.col(text_column).cast("string").alias("text"),
        F.col(lang_column).cast("string").alias("lang"),
    ).where("text is not null and lang is not null")
    shares = {x["lang"]: x["n"] for x in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    languages, total = sorted(shares), sum(shares.values())
    if total > max_documents:
        rows = rows.where(F.shiftrightunsigned("h", 1) < int(max_documents / total * (1 << 63)))

    def count(batches):
        grams = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS)), dtype=np.int64)
        number = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                words = " ".join(group["text"]).lower().split()
                found, times = np.unique(np.array(words, dtype=object), return_counts=True) if words else ([], [])
                if not len(found):
                    continue
                points, owner, letters, script = _flat(list(found))
                for word, bucket in _grams(points, owner):
                    keep = letters[word] > 0
                    grams[number[lang]] += np.bincount(
                        bucket[keep], weights=times[word[keep]], minlength=BUCKETS
                    ).astype(np.int64)
                seen = script >= 0
                scripts[number[lang]] += np.bincount(
                    script[seen], weights=times[seen], minlength=len(SCRIPTS)
                ).astype(np.int64)
        for k in range(len(languages)):
            full = np.concatenate([grams[k], scripts[k]])
            at = np.flatnonzero(full)
            yield pd.DataFrame({"lang": k, "bucket": at, "n": full[at]}).astype("int64")

    counted = rows.mapInPandas(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most languages x (buckets + scripts) rows
    got = counted.toPandas()
    full = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    full[got["lang"], got["bucket"]] = got["n"]
    grams, scripts = full[:, :BUCKETS] + 0.5, full[:, BUCKETS:]
    score = np.log(grams / grams.sum(axis=1, keepdims=True))
    used = scripts > 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return LanguageModel(languages, score.astype(np.float32), used)


def viterbi(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, scores: np.ndarray, penalty: float, left=None, right=None) -> np.ndarray:
    """Labels of all words of all texts. ``words``: rows of ``scores``, text by text.
    ``left``, ``right``: the labels before and behind each text, below 0 where there is none.

    The texts advance together, longest first, so that a step is one array
    operation over the texts that still have a word.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    kinds = scores.shape[1]
    value = np.zeros((len(order), kinds))
    if left is not None:
        value -= _edges(left[order], kinds, penalty)
    switched = np.zeros((len(words), kinds), dtype=bool)
    source = np.zeros(len(words), dtype=np.int16)
    for t in range(longest):
        a = active[t]
        at = starts[:a] + t
        v = value[:a]
        if t:
            best = v.argmax(axis=1)
            top = v[np.arange(a), best][:, None] - penalty
            move = top > v
            switched[at] = move
            source[at] = best
            v = np.where(move, top, v)
        value[:a] = v + scores[words[at]]
    labels = np.zeros(len(words), dtype=np.int16)
    if right is not None:
        value -= _edges(right[order], kinds, penalty)
    state = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        now = state[:a]
        labels[at] = now
        if t:
            state[:a] = np.where(switched[at, now], source[at], now)
    return labels


def _edges(neighbour: np.ndarray, kinds: int, penalty: float) -> np.ndarray:
    """What each label costs beside a neighbour, per text; nothing where that is none."""
    return np.where((neighbour[:, None] >= 0) & (neighbour[:, None] != np.arange(kinds)), penalty, 0.0)


#: Neighbours that are no label: a text's edge, and one that is not known yet.
EDGE, UNKNOWN = -1, -2
#: Words of a piece whose neighbours are not known.
BLOCK = 128


def _settled(own: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, penalty: float):
    """(label per piece, whether each word has it on every best path) of pieces of texts
    between neighbours. ``own``: scores by language and word, written over.

    The label is the best one for a whole piece. A run of others on a best path gains no
    less than the switches that the label in its place would save: one at each end, none
    at a text's edge; beside another label, or one not known, it may need one more. A word
    all of whose runs gain less, each word in its best other label, is settled.
    """
    first = np.cumsum(size) - size
    last = first + size - 1
    piece = np.repeat(np.arange(len(size)), size)
    at, kinds = np.arange(len(piece)), len(own)
    whole = np.add.reduceat(own, first, axis=1).T - _edges(left, kinds, penalty) - _edges(right, kinds, penalty)
    label = whole.argmax(axis=1)
    mine = label[piece]
    base = own[mine, at]
    own[mine, at] = -np.inf
    total = np.cumsum(own.max(axis=0) - base)
    before = np.concatenate([[0.0], total[:-1]])
    start = before[first][piece]  # sums of a piece alone
    total, before = total - start, before - start
    # later pieces are put below all earlier ones
    apart = (max(total.max(), 0.0) - min(total.min(), 0.0) + 1.0) * piece
    low = np.minimum.accumulate(before - apart) + apart
    high = np.maximum.accumulate((total - apart)[::-1])[::-1] + apart
    saved = [np.where(x == EDGE, 0.0, np.where(x == label, penalty, -penalty)) for x in (left, right)]
    # another label throughout is no better, unless by neighbours not known; a mixture switches
    within = np.where((left == UNKNOWN) | (right == UNKNOWN), 0.0, penalty)
    end, slack = total[last], 1e-6 * (1.0 + penalty) + 1e-15 * apart[-1]  # what rounding may take
    sure = high - low <= 2 * penalty - slack
    sure &= high <= (penalty + saved[0] - slack)[piece]
    sure &= end[piece] - low <= (penalty + saved[1] - slack)[piece]
    sure &= (end <= within + saved[0] + saved[1] - slack)[piece]
    return label, sure


def labels_of(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, scores: np.ndarray, penalty: float) -> np.ndarray:
    """The Viterbi labels of all words of all texts, which stand text by text.

    Most words' labels follow from the words around them, see ``_settled``. They are found
    at once for all words, first in blocks, then in the pieces left between the settled
    ones. The rest goes through the steps, between its neighbours' labels: their number is
    the longest such passage's, not the longest text's."""
    labels = np.zeros(len(words), dtype=np.int16)
    if not len(words) or scores.shape[1] < 2:
        return labels
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(words)) - starts[text]

    def unsettled(rows, size, left, right):
        label, sure = _settled(np.ascontiguousarray(scores[words[rows]].T, dtype=np.float64), size, left, right, penalty)
        labels[rows[sure]] = np.repeat(label, size)[sure]
        return rows[~sure]

    first = np.flatnonzero(place % BLOCK == 0)
    size = np.diff(first, append=len(words))
    ends = first + size - 1
    left = np.where(place[first] == 0, EDGE, UNKNOWN)
    right = np.where(place[ends] == lengths[text[ends]] - 1, EDGE, UNKNOWN)
    rows = unsettled(np.arange(len(words)), size, left, right)
    if len(rows):
        rows = unsettled(rows, *_pieces(rows, place, text, labels))
    if len(rows):
        size, left, right = _pieces(rows, place, text, labels)
        labels[rows] = viterbi(words[rows], np.cumsum(size) - size, size, scores, penalty, left, right)
    return labels


def _pieces(rows: np.ndarray, place: np.ndarray, text: np.ndarray, labels: np.ndarray):
    """(size, labels before and behind) of runs of words of a text, whose neighbours have
    their labels. ``rows``: the words' numbers, ascending."""
    first = np.flatnonzero((np.diff(rows, prepend=-2) > 1) | (place[rows] == 0))
    size = np.diff(first, append=len(rows))
    head, behind = rows[first], rows[first + size - 1] + 1
    left = np.where(place[head] == 0, EDGE, labels[head - 1])
    inside = np.minimum(behind, len(text) - 1)
    right = np.where((behind < len(text)) & (text[inside] == text[head]), labels[inside], EDGE)
    return size, left, right


class _Labeller:
    """Word scores cached over batches."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.units = UnitEncoder(self._encode, False, str.split)
        self.units.cleared = self._clear
        self._clear()

    def _clear(self):
        self.size = 0
        self.scores = np.zeros((1024, len(self.model.languages)), dtype=np.float32)
        self.letters = np.zeros((1024, 2), dtype=np.int64)  # in all, and in scripts that a language uses

    def _encode(self, words: list) -> list:
        scores, letters, known = self.model.words([w.lower() for w in words])
        end = self.size + len(words)
        if end > len(self.letters):
            room = max(end, 2 * len(self.letters))
            grow = room - len(self.letters)
            self.scores = np.concatenate([self.scores, np.zeros((grow, self.scores.shape[1]), dtype=np.float32)])
            self.letters = np.concatenate([self.letters, np.zeros((grow, 2), dtype=np.int64)])
        self.scores[self.size : end] = scores
        self.letters[self.size : end] = np.stack([letters, letters * known], axis=1)
        self.size, first = end, self.size
        return list(range(first, end))

    def label(self, texts: list):
        """(words' rows, labels) per text, for texts of one slice."""
        words, lengths = self.units.places(texts)
        starts = np.cumsum(lengths) - lengths
        labels = labels_of(words, starts, lengths, self.scores, self.model.switch_penalty)
        return words, labels, starts, lengths

    def predict(self, texts: list, with_spans: bool) -> list:
        """(language, score, spans) of every text."""
        languages, out = self.model.languages, []
        kinds = len(languages)
        for lo, hi in slices(texts):
            words, labels, starts, lengths = self.label(texts[lo:hi])
            letters = self.letters[words]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            votes = np.bincount(owner * kinds + labels, weights=letters[:, 1], minlength=len(lengths) * kinds)
            votes = votes.reshape(len(lengths), kinds)
            total = np.bincount(owner, weights=letters[:, 0], minlength=len(lengths))
            best = votes.argmax(axis=1)
            spans: list = [[] for _ in lengths]
            if with_spans:
                breaks = np.flatnonzero((np.diff(labels, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
                for first, last in zip(breaks, [*breaks[1:], len(words)]):
                    d = owner[first]
                    spans[d].append({"first": int(first - starts[d]), "last": int(last - starts[d]), "lang": languages[labels[first]]})
            for d in range(len(lengths)):
                if total[d]:
                    out.append((languages[best[d]], float(votes[d, best[d]] / total[d]), spans[d]))
                else:
                    out.append(("und", 0.0, []))
        return out


def predicted_column(spark: SparkSession, model: LanguageModel | None, text, with_spans: bool = True):
    """struct(lang_pred, score, spans) of a column of texts, see ``predict``; without
    ``with_spans`` the spans are empty."""
    shared = spark.sparkContext.broadcast(model)
    labellers: dict = {}

    @F.pandas_udf("lang_pred string, score double, spans array<struct<first: int, last: int, lang: string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        fitted = shared.value
        if fitted is None:
            return pd.DataFrame({"lang_pred": "und", "score": 0.0, "spans": [[]] * len(texts)}, index=range(len(texts)))
        if not labellers:
            labellers[0] = _Labeller(fitted)
        return pd.DataFrame(labellers[0].predict(as_texts(texts), with_spans), columns=["lang_pred", "score", "spans"])

    return evaluated_once(run)(text.cast("string"))


def predict(
    docs: DataFrame, model: LanguageModel | None, id_column: str = "doc_id", text_column: str = "text", with_spans: bool = True
) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of whole texts.

    ``score``: share of the text's letters in spans of the predicted language; letters
    of words in a script that no learned language uses are in no one's share.
    ``spans``: runs of words (number of the first, one past the last; white space
    separates words) with their language. Null text, and text without a letter, is
    ``und`` with score 0 and no spans, as is every text without a model. Ties go to
    the language that comes first in the alphabet. A null id stays null; repeated rows
    are predicted each; other columns are not read; an empty table gives none.
    """
    bounded_batches(docs)
    found = predicted_column(docs.sparkSession, model, F.col(f"`{text_column}`"), with_spans)
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), found.alias("p"))
    return rows.select("doc_id", "p.lang_pred", "p.score", "p.spans")
