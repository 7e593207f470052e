"""Language identification of whole texts, by words, with spans of mixed languages.

A language is a table of letter-trigram probabilities inside words, learned from labelled documents
by counting hashed trigrams in Spark. A text's words are scored under every language. The script of
a word narrows the languages to those that use that script in training; Viterbi then labels the
words, paying a penalty for every switch. The text's language is that of most of its letters and
the score is its share of them.

Defined results: ``und`` with score 0 for null text, for text without a letter, and where nothing
could be learned. Documents with a null language or id are not learned from; a null ``doc_id``
counts as not held out. Repeated rows are predicted alike. An empty table gives no rows. Every label
is learned: the model has 2**BITS numbers for each different one and no more, however many documents
there are. Texts are scored in slices of bounded length that end between words, and as many texts at
once as the number of languages allows, so memory follows the number of words of one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import settle

BITS = 16
#: Languages whose counts a task holds at a time while learning.
HELD = 256
#: Cost of changing the language between two words, in nats.
SWITCH = 12.0
#: A language uses a script if so much of its training letters is in it.
USES = 0.01
SLICE = 1_000_000
#: Characters times languages that are scored at once, beyond a first text.
CELLS = 16_000_000
#: First code points of script ranges and the script's number; 0 is none, 1 Latin.
SCRIPTS = (
    (0x0000, 0), (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6),
    (0x0700, 0), (0x0750, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0),
    (0x0B80, 11), (0x0C00, 12), (0x0C80, 13), (0x0D00, 14), (0x0D80, 15), (0x0E00, 16), (0x0E80, 17), (0x0F00, 18),
    (0x1000, 19), (0x10A0, 20), (0x1100, 21), (0x1200, 22), (0x13A0, 0), (0x1780, 23), (0x1800, 24), (0x18B0, 0),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 25), (0x3100, 0), (0x3130, 21), (0x3190, 0), (0x3400, 26),
    (0xA000, 0), (0xAC00, 21), (0xD7B0, 0), (0xF900, 26), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0),
    (0x20000, 26), (0x32000, 0),
)
N_SCRIPTS = 27


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, and its script."""
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    firsts, numbers = zip(*SCRIPTS)
    return letters, np.array(numbers, np.uint8)[np.searchsorted(firsts, np.arange(0x110000), "right") - 1]


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        cut = text.rfind(" ", at, at + SLICE) + 1
        if cut <= at:
            cut = at + SLICE
        yield text[at:cut]
        at = cut
    yield text[at:]


def _codes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of every letter, its script, and where words start among the letters."""
    letters, scripts = _tables()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters[codes]
    padded = np.zeros(len(codes) + 2, np.uint32)
    padded[1:-1] = np.where(is_letter, codes, 0)
    at = np.flatnonzero(is_letter)
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x27D4EB2F)
    return mixed >> np.uint32(32 - BITS), scripts[codes[at]], np.flatnonzero(a == 0)


def _counting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram and script counts of each language, summed over the task while it meets no more than ``HELD``."""
    size = (1 << BITS) + N_SCRIPTS
    sums: dict[str, np.ndarray] = {}

    def emit() -> Iterator[pd.DataFrame]:
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(total[at], 1)})
        sums.clear()

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            if lang not in sums and len(sums) == HELD:
                yield from emit()
            total = sums.setdefault(lang, np.zeros(size, np.int64))
            for part in _slices(text):
                buckets, scripts, _ = _codes(part)
                total += np.bincount(buckets, minlength=size)
                total[1 << BITS :] += np.bincount(scripts, minlength=N_SCRIPTS)
    yield from emit()


def _labels_type(languages: int) -> type:
    return np.uint8 if languages <= 1 << 8 else np.uint16 if languages <= 1 << 16 else np.uint32


class Model:
    """Languages, their log-probabilities of trigrams, and which of them use each script."""

    def __init__(self, languages: list[str], logs: np.ndarray, uses: np.ndarray):
        self.languages, self.logs, self.uses = languages, logs, uses

    def word_scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A row per word with its score in each language, and its letters."""
        scores, sizes = [], []
        for part in _slices(text):
            buckets, scripts, starts = _codes(part)
            if len(starts):
                own = np.add.reduceat(self.logs[buckets], starts, axis=0)
                out = ~self.uses[scripts[starts]]
                own[out] = -1e6
                scores.append(own)
                sizes.append(np.diff(np.append(starts, len(buckets))))
        if not scores:
            return np.empty((0, len(self.languages)), np.float32), np.empty(0, np.int64)
        return np.concatenate(scores), np.concatenate(sizes)

    def labels(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The language of every word of every text by Viterbi, all texts a step at a time; and letters."""
        found = [self.word_scores(t) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(found[i][0]))
        lengths = np.array([len(found[i][0]) for i in order])
        out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(texts)
        if len(texts) and lengths[0]:
            scores = np.concatenate([found[i][0] for i in order]).astype(np.float64)
            first = np.cumsum(lengths) - lengths
            active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
            n = len(self.languages)
            kind = _labels_type(n)
            own = np.arange(n, dtype=kind)
            back = np.empty((len(scores), n), kind)
            value = np.zeros((active[0], n))
            for t, a in enumerate(active):
                value = value[:a]
                best = value.argmax(1)
                switched = value[np.arange(a), best] - SWITCH
                stays = value >= switched[:, None]
                at = first[:a] + t
                back[at] = np.where(stays, own, best[:, None])
                value = np.where(stays, value, switched[:, None]) + scores[at]
                if t + 1 == len(active) or active[t + 1] < a:
                    ended = range(active[t + 1] if t + 1 < len(active) else 0, a)
                    for k in ended:
                        out[order[k]] = self._path(back[first[k] : first[k] + lengths[k]], int(value[k].argmax()))
        return out, [sizes for _, sizes in found]

    @staticmethod
    def _path(back: np.ndarray, state: int) -> np.ndarray:
        """Labels from the last word to the first; runs without a switch are skipped in one step."""
        path = np.empty(len(back), back.dtype)
        end = len(back)
        moves = back != np.arange(back.shape[1], dtype=back.dtype)
        columns = [np.flatnonzero(moves[:, k]) for k in range(back.shape[1])]
        while end > 0:
            at = np.searchsorted(columns[state], end, "left") - 1
            start = columns[state][at] if at >= 0 else 0
            path[start:end] = state
            if at < 0:
                break
            state, end = int(back[start, state]), start
        return path


def learn(docs: DataFrame) -> Model:
    """A model of ``docs`` (``text, lang``); at most ``2**BITS`` counts of each language come to the driver."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInPandas(_counting, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = settle(counts, "language-counts")
    names = sorted(r["lang"] for r in counts.where("bucket = -1").collect())
    index = {x: i for i, x in enumerate(names)}
    total = np.zeros(((1 << BITS) + N_SCRIPTS, len(names)))
    found = counts.where("bucket >= 0").toPandas() if names else pd.DataFrame({"lang": [], "bucket": [], "n": []})
    total[found["bucket"].astype(int), found["lang"].map(index).astype(int)] = found["n"]
    grams, scripts = total[: 1 << BITS], total[1 << BITS :]
    smooth = 0.1
    logs = np.log((grams + smooth) / (grams.sum(0) + smooth * len(grams))) if names else grams
    uses = scripts >= USES * np.maximum(1, scripts.sum(0))
    uses[~uses.any(1)] = True
    return Model(names, logs.astype(np.float32), uses)


def predicted(model: Model, text: Column, spark) -> Column:
    """``struct<lang_pred, score, spans>`` of a text; spans are runs of words of one language, counted in words."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, spans array<struct<lang: string, first_word: int, words: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows, at = [], 0
            texts = [x or "" for x in batch]
            while at < len(texts):
                upto, held = at, 0
                while upto < len(texts) and (upto == at or (held + len(texts[upto])) * len(own.languages) <= CELLS):
                    held, upto = held + len(texts[upto]), upto + 1
                rows += _judged(own, texts[at:upto])
                at = upto
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])

    return run(text)


def _judged(model: Model, texts: list[str]) -> list[tuple]:
    rows = []
    for labels, sizes in zip(*(model.labels(texts) if model.languages else ([np.empty(0)] * len(texts),) * 2)):
        if not len(labels):
            rows.append(("und", 0.0, []))
            continue
        share = np.bincount(labels, sizes, len(model.languages))
        best = int(share.argmax())
        starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        runs = np.diff(np.append(starts, len(labels)))
        spans = [{"lang": model.languages[labels[s]], "first_word": int(s), "words": int(n)} for s, n in zip(starts, runs)]
        rows.append((model.languages[best], float(share[best] / share.sum()), spans))
    return rows


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans``; learned from the documents that are not held out."""
    model = learn(docs.where(~is_held_out() & F.col("doc_id").isNotNull()))
    return docs.select("doc_id", is_held_out().alias("held_out"), predicted(model, F.col("text"), docs.sparkSession).alias("p")).select("doc_id", "held_out", "p.*")


def keep_known(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """Documents with a language that holds at least ``share`` of their letters; columns as they are."""
    model = learn(docs.where(~is_held_out() & F.col("doc_id").isNotNull()))
    judged = docs.withColumn("_language", predicted(model, F.col("text"), docs.sparkSession))
    return judged.where((F.col("_language.lang_pred") != "und") & (F.col("_language.score") >= share)).drop("_language")
