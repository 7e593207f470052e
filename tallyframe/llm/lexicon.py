"""BPE ids by a lexicon of frequent words, a minimal acyclic transducer, with exact merges for the rest; and back.

*Count.* Words are what the tokenizer merges on its own: runs of letters, single digits, runs of other
signs, after normalising. All texts are counted in tasks that fold words before they are shuffled.

*Compile.* The lexicon takes the words whose count reaches a power of two, the lowest one at which at
most ``MOST_WORDS`` do (a histogram of 64 rows decides). One task sorts those, bounded in number and
length, into an automaton that shares prefixes and suffixes: a state is looked up by its right
language before it is kept. Each transition carries the number of words before it; their sum along a
word is the word's own number, and that finds its ids. The file is a handful of flat arrays.

*Encode.* Spark hands the file to every executor (``SparkContext.addFile``), where workers map it, so
that all workers of a machine share its pages. A batch looks its different words up together, one byte
of all of them at a time. A word that the lexicon lacks is merged by the ranks of the tokenizer's
file. So no word is ever left out, and the size of the lexicon changes speed alone.

*Decode.* Ids become the tokenizer's signs, a blank between them, as the file has no decoder.

Text of common Latin signs is split here; any other part of a text is normalised and split by the
library, which gives the same words. Parts end at spaces and line feeds, which no word spans. Strings
of special tokens are their ids wherever they stand.

Defined results: null or empty text has no ids and decodes to the empty string; equal rows give equal
rows; a null ``doc_id`` is kept; an empty table compiles an empty lexicon and gives no rows. Other
columns are ignored. Memory of a worker is bounded by one batch of rows, ``CHUNK`` letters or one text,
and the tables of the tokenizer.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import settle, shared_folder

TOKENIZER = "word_bpe_49k.json"
#: Words in the lexicon, and bytes of one of them, at most: more are merged wherever they come.
MOST_WORDS = 1 << 18
LONG = 32
#: Letters of text that a worker encodes at a time, or one text.
CHUNK = 4_000_000
#: Different words a worker counts before it hands their counts on.
COUNTED = 400_000
#: Symbols up to which a scan for the next merge beats a heap.
SHORT = 48

_LETTERS = "a-zß-öø-ÿĀ-įĲ-ſ"
_PLAIN = re.compile(f"[\t\n\r -~À-ÖØ-öø-įĲ-ſ–—‘’“”…]*")
# Fixed value: the split pattern of the tokenizer's file, for the signs of _PLAIN in lower case.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\t\n\r 0-9{_LETTERS}]+")
_PART = re.compile("[ \n]")


class Merger:
    """Words of texts, and ids of words, by one tokenizer file."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        path = public_tokenizers.path(file)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # the library shows bytes as signs; a byte alone is seen best inside a character that has it
        signs: dict[int, str] = {}
        for char in (*map(chr, range(0x80)), *(chr(0x80 + i) for i in range(64)), *(bytes((lead, *rest)).decode() for lead, rest in _leads())):
            signs.update(zip(char.encode(), level.pre_tokenize_str(char)[0][0]))
        self.byte = {sign: b for b, sign in signs.items()}
        self.inner = [ids.get(signs.get(b, "")) for b in range(256)]
        self.last = [ids.get(signs.get(b, "") + end) for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a], ids[b]] = rank, ids[a + b]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        tokens = {i: token for token, i in (ids | self.special).items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]

    def words(self, text: str) -> list[str]:
        """Words in order; a special token is its own string, which no split of text can give."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _WORDS.findall(text.lower())
        found: list[str] = []
        for part in _PART.split(text):
            if not _PLAIN.fullmatch(part):
                found += self._odd(part)
            elif "<|" in part:
                for piece in self.at_special.split(part):
                    found += [piece] if piece in self.special else _WORDS.findall(piece.lower())
            else:
                found += _WORDS.findall(part.lower())
        return found

    def _odd(self, part: str) -> list[str]:
        """Words of any part, split by the library."""
        found = []
        for piece in self.at_special.split(part):
            if piece in self.special:
                found.append(piece)
            elif piece:
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
                found += [bytes(map(self.byte.__getitem__, signs)).decode() for signs, _ in cut]
        return found

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the pair of lowest rank merges, the leftmost of equals, until none is left."""
        if word in self.special:
            return [self.special[word]]
        data = word.encode()
        if not data:
            return []
        ids = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        return self._scan(ids) if len(ids) <= SHORT else self._queue(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        rank, none = self.ranks.get, (len(self.ranks), 0)
        # rank and result of each pair of neighbours; only those beside a merge change
        pairs = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) is not none:
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _queue(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(*ranks[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        gone = -1
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i] if ids[i] != gone else n
            if j >= n or ranks.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], ids[j], after[i] = new, gone, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (found := ranks.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, found[1]))
        return [x for x in ids if x != gone]


def _leads() -> Iterator[tuple[int, tuple[int, ...]]]:
    """One character for each lead byte of two to four bytes."""
    yield from ((lead, (0x80,)) for lead in range(0xC2, 0xE0))
    yield from ((lead, (0xA0 if lead == 0xE0 else 0x80, 0x80)) for lead in range(0xE0, 0xF0))
    yield from ((lead, (0x90 if lead == 0xF0 else 0x80, 0x80, 0x80)) for lead in range(0xF0, 0xF5))


@lru_cache(maxsize=2)
def merger(file: str) -> Merger:
    """One per worker process and file."""
    return Merger(file)


# --- the automaton ---


def minimal(words: Iterable[bytes]) -> list[tuple[bool, list[tuple[int, int]]]]:
    """States of the smallest automaton of sorted, different words; the start is the last one.

    A state is ``(ends a word, [(byte, state)])``, and no two have the same right language.
    """
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    known: dict[tuple, int] = {}
    # the path of the last word, still open: [ends, {byte: state}, byte to the next]
    path: list[list] = [[False, [], None]]

    def close(depth: int) -> None:
        while len(path) > depth:
            ends, edges, _ = path.pop()
            state = (ends, tuple(edges))
            if state not in known:
                known[state] = len(states)
                states.append((ends, edges))
            path[-1][1].append((path[-1][2], known[state]))

    last = b""
    for word in words:
        shared = len(os.path.commonprefix((last, word)))
        close(shared + 1)
        for byte in word[shared:]:
            path[-1][2] = byte
            path.append([False, [], None])
        path[-1][0] = True
        last = word
    close(1)
    states.append((path[0][0], path[0][1]))
    return states


#: Arrays of the file, in order, each of unsigned 32-bit integers behind a head with their lengths.
ARRAYS = ("keys", "targets", "before", "ends", "offsets", "ids")


def compiled(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The file of a lexicon: sorted words and what they give.

    ``keys`` are ``state * 256 + byte`` in order, with the ``targets`` of those transitions and the
    number of words ``before`` what lies behind them; states from the start on, ``ends`` per state.
    """
    states = minimal(words)
    counts: list[int] = []
    for ends, edges in states:  # targets come before their sources
        counts.append(ends + sum(counts[t] for _, t in edges))
    keys, targets, before = [], [], []
    top = len(states) - 1
    for number in range(top, -1, -1):
        ends, edges = states[number]
        smaller = int(ends)
        for byte, target in edges:
            keys.append((top - number) << 8 | byte)
            targets.append(top - target)
            before.append(smaller)
            smaller += counts[target]
    flat = {
        "keys": keys, "targets": targets, "before": before, "ends": [int(ends) for ends, _ in reversed(states)],
        "offsets": np.cumsum([0, *map(len, ids)]), "ids": [i for x in ids for i in x],
    }
    arrays = [np.asarray(flat[name], "<u4") for name in ARRAYS]
    return np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A mapped file: numbers and ids of the words it knows; without a file, none."""

    def __init__(self, path: str | None):
        flat = np.memmap(path, "<u4", mode="r") if path else np.zeros(len(ARRAYS), "<u4")
        at = len(ARRAYS)
        for name, n in zip(ARRAYS, flat[:at].tolist()):
            setattr(self, name, flat[at : at + n])
            at += n

    def numbers(self, words: Sequence[str]) -> np.ndarray:
        """The number of each word, -1 where the lexicon lacks it: one byte of all words at a time."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(data), np.uint8)
        state, total = np.zeros(len(data), np.uint32), np.zeros(len(data), np.int64)
        known = (size > 0) & (size <= LONG)
        for step in range(int(size[known].max(initial=0)) if len(self.keys) else 0):
            live = np.flatnonzero(known & (size > step))
            key = state[live] << np.uint32(8) | flat[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            known[live[~hit]] = False
            live, at = live[hit], at[hit]
            total[live] += self.before[at]
            state[live] = self.targets[at]
        known[known] = self.ends[state[known]] > 0 if len(self.keys) else False
        return np.where(known, total, -1)


@lru_cache(maxsize=2)
def lexicon(name: str) -> Lexicon:
    """One per worker process and file; ``name`` is that of a file Spark has handed out, or empty."""
    from pyspark import SparkFiles

    return Lexicon(SparkFiles.get(name) if name else None)


# --- jobs ---


def _counting(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = merger(file).words, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                counts.update(words(text.as_py() or ""))
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    return run


def word_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``word, n`` of all words that stand in ``docs`` twice or more and are short enough for a lexicon."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counting(tokenizer), "word string, n long")
    return counted.where(F.octet_length("word") <= LONG).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


def _compiling(file: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyframe.llm.sequences import _store

        merge = merger(file).merge
        words = [w for batch in batches for w in batch.column("word").to_pylist()]
        data = compiled([w.encode() for w in words], [merge(w) for w in words])
        # a task that runs again writes another file; the one that Spark keeps is the one that is read
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name = f"lexicon-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{base}/{name}") as f:
            f.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(words)], pa.int64())], ["name", "words"])

    return run


def compile_lexicon(docs: DataFrame, tokenizer: str = TOKENIZER, most: int = MOST_WORDS) -> str:
    """Compile the frequent words of ``docs``.

    Returns the name of the file, which Spark hands to every executor, or an empty one if no word is frequent.
    """
    spark = docs.sparkSession
    counts = settle(word_counts(docs, tokenizer), "words")
    power = F.floor(F.log2("n")).cast("int")
    left, least = most, 64
    for row in sorted(counts.groupBy(power.alias("power")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        least = row["power"]
    folder = shared_folder(spark, "lexicon")
    # at most `most` words of `LONG` bytes, one task
    chosen = counts.where(power >= least).select("word").repartition(1).sortWithinPartitions("word")
    written = chosen.mapInArrow(_compiling(tokenizer, folder), "name string, words long").first()
    if written is None:
        return ""
    spark.sparkContext.addFile(f"{folder}/{written['name']}")
    return written["name"]


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of batches with the values of one column, ``CHUNK`` letters or one row at a time."""
    for batch in batches:
        values = batch.column(column)
        size = (np.asarray(pc.fill_null(pc.binary_length(values), 0)).cumsum() // CHUNK).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a), values.slice(a, b - a).to_pylist()


class _Numbers(dict):
    """Different words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _encoding(file: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known = merger(file), lexicon(name)
        for batch, texts in _chunks(batches, "text"):
            numbers = _Numbers()
            docs = [np.fromiter(map(numbers.__getitem__, tool.words(t or "")), np.int64) for t in texts]
            words = list(numbers)
            found = known.numbers(words)
            rest = np.flatnonzero(found < 0)
            merged = [tool.merge(words[i]) for i in rest.tolist()]
            # ids of this chunk's words: those of the lexicon, then those merged here
            flat = np.concatenate([known.ids, np.fromiter((i for x in merged for i in x), "<u4")])
            first, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            hit = found >= 0
            first[hit], size[hit] = known.offsets[found[hit]], np.diff(known.offsets)[found[hit]]
            lengths = np.fromiter(map(len, merged), np.int64, len(merged))
            first[rest], size[rest] = len(known.ids) + np.cumsum(lengths) - lengths, lengths
            ids = []
            for doc in docs:
                n = size[doc]
                # positions in `flat`: each word's first place, counted on for its length
                at = np.arange(n.sum()) + np.repeat(first[doc] - (np.cumsum(n) - n), n)
                ids.append(flat[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, name: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids``: little-endian unsigned 32-bit integers."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_encoding(tokenizer, name), "doc_id long, ids binary")


def _decoding(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = merger(file).tokens.__getitem__
        for batch, ids in _chunks(batches, "ids"):
            texts = [" ".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids`` with the ``text`` they stand for, special tokens included."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(tokenizer), "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, most: int = MOST_WORDS) -> DataFrame:
    """Every document's ids and what they decode to, by a lexicon of these documents."""
    return decode(encode(docs, compile_lexicon(docs, tokenizer, most), tokenizer), tokenizer)
