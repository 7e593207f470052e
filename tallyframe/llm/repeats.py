"""Removal of passages that an earlier document holds, by suffix sorting with a difference cover.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a document of smaller id.
Suffixes need to be ordered only by their first ``LENGTH`` bytes and only where a string can repeat:

1. Every string of ``LENGTH`` bytes has an anchor, the ``GRAM``-byte piece in it with the smallest
   hash. Equal strings have equal anchors with equal surroundings: of the bytes beside the anchor at
   least half lie on one side. So strings can repeat elsewhere only if the anchor with that many bytes
   before it, or with as many after it, occurs in another document too. Both are counted by hash, in
   packed arrays. Of an anchor that several texts read together hold, only the first and last places
   go to the count; the others are known to repeat and go straight to their texts.
2. Strings with a common anchor that touch are one segment. Equal segments are folded to one with the
   smallest id of their documents.
3. Segments are dealt by anchor. In each part suffixes are sorted by the difference cover modulo 3:
   triples at sampled places are sorted and named, the names are sorted the same way until they are
   all different or reach over ``LENGTH`` bytes, the places between are sorted by one byte and the
   rank after it, and both orders are merged. Neighbours that agree on ``LENGTH`` bytes are a group,
   and its smallest document id goes to each of its strings. An anchor whose different segments are
   more than a part is not dealt whole: its strings become rows, equal ones are folded to their
   smallest id, and rows and folds are joined by string, in as many tasks as there are partitions.
4. Each occurrence of a segment loses the strings whose smallest id is below its own.

Before all, equal texts are folded: of copies with different ids only the smallest goes on, and the
others lose everything, as each of their strings starts in it.

Defined results: null text is empty; texts shorter than ``LENGTH`` lose nothing. A null id is larger
than any other. Rows of equal id don't take from each other; equal rows have equal results. An empty
table gives no rows. Other columns are ignored by :func:`repeats` and kept by :func:`without_repeats`.
Texts are read in slices, so memory follows the longest text a few times over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import parts_for, settle

LENGTH, GRAM = 50, 16
#: Bytes looked at together, and bytes of segments in one part of the suffix sort.
SLICE, PART = 1 << 20, 1 << 20
#: Bytes of text whose anchors are counted together, and that are cut together: at most, and at least if partitions would stay empty.
MOST, FEWEST = 32 << 20, 4 << 20
LAST = (1 << 63) - 1

_BYTES = np.random.default_rng(10).integers(0, 2**64, 256, dtype=np.uint64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (b >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)


def _grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every place on; runs double in length."""
    out, width = _BYTES[codes], 1
    while width < GRAM:
        out, width = _joined(out[:-width], out[width:]), 2 * width
    return out ^ (out >> np.uint64(32))


#: Bytes beside the anchor of which a string has at least so many on one side; two grams cover them.
HALF = (LENGTH - GRAM) // 2
assert GRAM <= HALF <= 2 * GRAM


def _runs(data: bytes, at: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings, anchor, and hashes with what is before and after it, of every run of strings with one anchor.

    For the strings that start in a slice of a text from ``at``.
    """
    codes = np.frombuffer(data, np.uint8)[at : at + SLICE + length - 1]
    grams = _grams(codes)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    least = low
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(low) - span + 1], least[span - width :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    places = anchor[first]
    own = grams[places]
    before = _joined(_joined(grams[np.maximum(0, places - HALF)], grams[np.maximum(0, places - GRAM)]), own)
    last = len(grams) - 1
    after = _joined(own, _joined(grams[np.minimum(last, places + GRAM)], grams[np.minimum(last, places + HALF)]) + np.uint64(1))
    # where a side is too short no string leans on it; the anchor alone then stands for it
    before = np.where(places >= HALF, before, own)
    after = np.where(places + HALF <= last, after, own)
    return first + at, np.diff(np.append(first, len(anchor))), own, before, after


def _all_runs(data: bytes) -> tuple[np.ndarray, ...]:
    parts = [_runs(data, at) for at in range(0, len(data) - LENGTH + 1, SLICE)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def _anchoring(buckets: int):
    """Anchors of many texts at once, packed by bucket: hashes, and for each text how many it has there and which.

    Buckets from ``buckets`` on hold groups of texts, with anchors that are known to repeat.
    """

    def pack(held: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        rows = np.array([r for r, *_ in held], np.int64)
        hashes = np.concatenate([h for _, *both in held for h in both])
        of = np.repeat(np.arange(len(held)), [2 * len(h) for _, h, _ in held])
        number = np.concatenate([np.arange(len(h)) for _, *both in held for h in both]).astype(np.uint32)
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((rows[of], hashes))
        new = np.flatnonzero(np.r_[True, hashes[by][1:] != hashes[by][:-1]])
        ends = np.append(new[1:], len(by)) - 1
        middle = np.repeat(rows[of[by[new]]] != rows[of[by[ends]]], ends - new + 1)
        middle[new] = middle[ends] = False
        known = by[middle]
        bucket[known] = buckets + (rows[of[known]] & LAST) % buckets
        hashes >>= np.uint64(16)  # with the bucket more than enough to tell anchors apart; chance hits are sorted out later
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        out = []
        for part in np.split(order, cuts):
            texts, counts = np.unique(of[part], return_counts=True)
            short = hashes[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            out.append((int(bucket[part[0]]), short.tobytes(), rows[texts].tobytes(), counts.astype(np.uint32).tobytes(), number[part].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "hashes", "texts", "counts", "numbers"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"]):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) >= LENGTH:
                    held.append((row, *_all_runs(data)[3:]))
                    size += len(data)
                    if size >= 4 * SLICE:
                        yield pack(held)
                        held, size = [], 0
        if held:
            yield pack(held)

    return run


def _counting(groups: int):
    """Anchors of a bucket that occur in more than one text, by as many groups of texts as there are buckets."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        short, texts, counts, numbers = (np.frombuffer(b"".join(bucket[c]), t) for c, t in (("hashes", np.uint8), ("texts", np.int64), ("counts", np.uint32), ("numbers", np.uint32)))
        hashes = np.pad(short.reshape(-1, 6), ((0, 0), (0, 2))).view("<u8").ravel()
        own = np.repeat(texts, counts)
        if bucket["bucket"].iloc[0] >= groups:
            keep = np.arange(len(own))
        else:
            order = np.lexsort((own, hashes))
            h, t = hashes[order], own[order]
            new = np.r_[True, h[1:] != h[:-1]]
            start = np.flatnonzero(new)
            several = t[start] != t[np.append(start[1:], len(t)) - 1]
            keep = order[several[np.cumsum(new) - 1]]
        group = (own[keep] & LAST) % groups
        by = np.argsort(group, kind="stable")
        keep, group = keep[by], group[by]
        parts = np.split(np.arange(len(keep)), np.flatnonzero(np.diff(group)) + 1) if len(keep) else []
        rows = [(int(group[p[0]]), own[keep[p]].tobytes(), numbers[keep[p]].tobytes()) for p in parts]
        return pd.DataFrame(rows, columns=["group", "texts", "numbers"])

    return run


def _cutting(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The segments of each text whose anchors occur elsewhere."""
    rows = np.frombuffer(b"".join(found["texts"]), np.int64)
    numbers = np.frombuffer(b"".join(found["numbers"]), np.uint32)
    order = np.argsort(rows, kind="stable")
    rows, numbers = rows[order], numbers[order]
    out = []
    for row, own, text in zip(texts["row"], texts["own"], texts["text"]):
        a, b = np.searchsorted(rows, row, "left"), np.searchsorted(rows, row, "right")
        if a < b:
            data = text.encode("utf-8", "surrogatepass")
            first, size, anchor, _, _ = _all_runs(data)
            for i in np.unique(numbers[a:b]).tolist():
                piece = data[first[i] : first[i] + size[i] + LENGTH - 1]
                out.append((xxhash.xxh3_128_digest(piece), int(anchor[i].astype(np.int64)), row, own, int(first[i]), piece))
    return pd.DataFrame(out, columns=["segment", "anchor", "row", "own", "at", "piece"])


def _packed(*columns: np.ndarray) -> np.ndarray:
    """Keys that order like the columns together."""
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        if int(out.max(initial=0) + 1) * int(c.max(initial=0) + 1) >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
        out = out * (int(c.max(initial=0)) + 1) + c
    return out


def suffix_order(symbols: np.ndarray, reach: int, length: int) -> np.ndarray:
    """Places of ``symbols`` (all above 0) in the order of the suffixes there.

    A symbol stands for ``reach`` bytes; suffixes that agree on ``length`` bytes may stand in any order.
    """
    n = len(symbols)
    s = np.zeros(n + 4, np.int64)
    s[:n] = symbols
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    triples = _packed(s[sampled], s[sampled + 1], s[sampled + 2])
    names = np.unique(triples, return_inverse=True)[1].astype(np.int64) + 1
    if len(names) and names.max() < len(names) and 3 * reach < length:
        order = suffix_order(names, 3 * reach, length)
        names = np.empty(len(names), np.int64)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = names
    # where names stop early they tie; finer keys then order each third in itself, so that counts of smaller ones only grow
    between, one = np.arange(0, n, 3), one[one < n]
    between = between[np.argsort(_packed(s[between], rank[between + 1], s[between + 1], rank[between + 2]), kind="stable")]
    before = np.zeros(len(between), np.int64)
    thirds = []
    for third, columns in ((one, ((s, 0), (rank, 1))), (two, ((s, 0), (s, 1), (rank, 2)))):
        key = _packed(*(np.concatenate([x[between + d], x[third + d]]) for x, d in columns))
        order = np.argsort(key[len(between) :], kind="stable")
        thirds.append(third[order])
        # of suffixes that agree on all that counts, one may have got the lower name by chance
        before += np.maximum.accumulate(np.searchsorted(key[len(between) :][order], key[: len(between)], "left"))
    sorted_ = np.concatenate(thirds)
    sorted_ = sorted_[np.argsort(rank[sorted_], kind="stable")]
    out = np.empty(n, np.int64)
    places = np.arange(len(between)) + before
    out[places] = between
    free = np.ones(n, bool)
    free[places] = False
    out[free] = sorted_
    return out


def _sorting(part: pd.DataFrame) -> pd.DataFrame:
    """For each segment its runs of strings that occur in another segment or document, with their smallest id."""
    pieces, own = part["piece"].tolist(), part["own"].to_numpy()
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    text = np.zeros(ends[-1], np.int64)
    body = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:] = body.astype(np.int64) + 2
    text[ends - 1] = 1
    order = suffix_order(text, 1, LENGTH)
    of = np.repeat(np.arange(len(pieces)), sizes + 1)
    whole = (np.arange(len(text)) + LENGTH <= (ends - 1)[of])[order]
    places = order[whole]
    wide = np.zeros(len(text) + LENGTH, np.uint64)
    wide[: len(body)] = body
    for width in (1, 2, 4):  # eight bytes from every place on
        wide[:-width] = (wide[:-width] << np.uint64(8 * width)) | wide[width:]
    same = np.ones(max(0, len(places) - 1), bool)
    for d in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same &= wide[places[1:] + d] == wide[places[:-1] + d]
    group = np.cumsum(np.r_[True, ~same]) - 1
    least = np.minimum.reduceat(own[of[places]], np.flatnonzero(np.r_[True, ~same]))
    smallest = np.full(len(text), LAST, np.int64)
    smallest[places] = least[group]
    # neighbouring strings of one segment with the same smallest id are one run
    valid = np.flatnonzero(np.arange(len(text)) + LENGTH <= (ends - 1)[of])
    breaks = np.r_[True, (smallest[valid][1:] != smallest[valid][:-1]) | (np.diff(valid) > 1)]
    first = valid[breaks]
    n = np.diff(np.append(np.flatnonzero(breaks), len(valid)))
    return pd.DataFrame({"segment": part["segment"].to_numpy()[of[first]], "from": (first - starts[of[first]]).astype(np.int32), "strings": n.astype(np.int32), "least": smallest[first]})


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("own"), text.alias("text"))


def _folded(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every different text once, with its smallest id, and ``row, at, upto`` of the whole of its copies with larger ids."""
    same = F.unhex(F.md5("text"))
    firsts = texts.select("own", same.alias("same")).groupBy("same").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = settle(firsts.where("n > 1").select("same", "first"), "repeat-copies")
    marked = texts.withColumn("same", same).join(firsts, "same", "left")
    alone = marked.where("first is null").select("row", "own", "text")
    kept = marked.where("own = first").select("row", "own", "text").dropDuplicates(["row"])
    copies = marked.where("own > first").select("row", F.lit(0).cast("long").alias("at"), F.octet_length("text").cast("long").alias("upto"))
    return alone.unionByName(kept), copies


def _groups_for(texts: DataFrame) -> int:
    """Buckets of anchors and groups of texts, of ``MOST`` bytes of text on average and for every partition as far as each has ``FEWEST``."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, -(-size // MOST), min(parts_for(texts.sparkSession), -(-size // FEWEST)))


def _segments(texts: DataFrame, groups: int) -> DataFrame:
    """``segment, anchor, row, own, at, piece``: every run of strings that may occur in another document."""
    found = _repeated_anchors(texts, groups)
    grouped = texts.withColumn("group", (F.col("row").bitwiseAND(F.lit(LAST)) % groups).cast("int"))
    cut = grouped.groupBy("group").cogroup(found.groupBy("group")).applyInPandas(_cutting, "segment binary, anchor long, row long, own long, at long, piece binary")
    return settle(cut, "repeat-segments")


def _repeated_anchors(texts: DataFrame, groups: int) -> DataFrame:
    packed = texts.select("row", "text").mapInPandas(_anchoring(groups), "bucket int, hashes binary, texts binary, counts binary, numbers binary")
    return settle(packed.groupBy("bucket").applyInPandas(_counting(groups), "group int, texts binary, numbers binary"), "repeat-anchors")


def _distinct(segments: DataFrame) -> DataFrame:
    """Every different segment once, with the smallest id of its documents."""
    folded = segments.groupBy("segment").agg(F.min("own").alias("own"), F.first("anchor").alias("anchor"), F.first("piece").alias("piece"))
    return settle(folded, "repeat-distinct")


def _hot_anchors(distinct: DataFrame, parts: int) -> DataFrame:
    """``anchor`` of those with more than ``PART`` bytes of segments; cells of anchors are weighed first, as most hold none."""
    weighed = distinct.select("anchor", F.pmod("anchor", F.lit(64 * parts)).alias("cell"), (F.octet_length("piece") + 1).alias("bytes"))
    cells = settle(weighed.groupBy("cell").agg(F.sum("bytes").alias("total")).where(F.col("total") > PART).select("cell"), "repeat-cells")
    hot = weighed.join(cells, "cell", "left_semi").groupBy("anchor").agg(F.sum("bytes").alias("total"))
    return settle(hot.where(F.col("total") > PART).select("anchor"), "repeat-hot")


RUNS = "segment binary, from int, strings int, least long"


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every string of every segment as a digest."""
    for batch in batches:
        counts = [len(p) - LENGTH + 1 for p in batch["piece"]]
        digests = [xxhash.xxh3_128_digest(p[k : k + LENGTH]) for p, n in zip(batch["piece"], counts) for k in range(n)]
        of = np.repeat(np.arange(len(batch)), counts)
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in counts]) if counts else np.empty(0, np.int32)
        yield pd.DataFrame({"segment": batch["segment"].to_numpy()[of], "from": at, "own": batch["own"].to_numpy()[of], "string": digests})


def _joined_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbouring strings of one segment with the same smallest id as one run."""
    for batch in batches:
        out = []
        for segment, strings in zip(batch["segment"], batch["strings"]):
            for s in strings:
                if out and out[-1][0] is segment and out[-1][3] == s["least"]:
                    out[-1][2] += 1
                else:
                    out.append([segment, s["from"], 1, s["least"]])
        yield pd.DataFrame(out, columns=["segment", "from", "strings", "least"])


def _hot_runs(distinct: DataFrame) -> DataFrame:
    """What :func:`_sorting` gives, with strings folded by their digests: equal strings only meet as partial minima."""
    strings = settle(distinct.select("segment", "own", "piece").mapInPandas(_strings, "segment binary, from int, own long, string binary"), "repeat-strings")
    folded = strings.groupBy("string").agg(F.min("own").alias("smallest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("string", "smallest")
    named = strings.join(settle(folded, "repeat-folded"), "string", "left").select("segment", F.struct("from", F.coalesce("smallest", "own").alias("least")).alias("s"))
    # a segment has one anchor, so no more strings than fit around it
    return named.groupBy("segment").agg(F.sort_array(F.collect_list("s")).alias("strings")).mapInPandas(_joined_runs, RUNS)


def removed_strings(docs: DataFrame) -> DataFrame:
    """``row, at, upto``: byte ranges to remove, which may overlap; ``row`` hashes id and text."""
    texts, copies = _folded(_keyed(docs).where(F.octet_length("text") >= LENGTH))
    segments = _segments(texts, _groups_for(texts))
    distinct = _distinct(segments)
    size = distinct.agg(F.sum(F.octet_length("piece") + 1)).first()[0] or 0
    parts = max(1, -(-size // PART))
    hot = _hot_anchors(distinct, parts)
    dealt = distinct.join(hot, "anchor", "left_anti").withColumn("part", F.pmod("anchor", F.lit(parts)))
    runs = dealt.groupBy("part").applyInPandas(_sorting, RUNS)
    runs = settle(runs.unionByName(_hot_runs(distinct.join(hot, "anchor", "left_semi"))), "repeat-runs")
    del distinct, dealt
    hit = segments.select("segment", "row", "own", "at").join(runs, "segment").where("least < own")
    start = F.col("at") + F.col("from")
    ranges = hit.select("row", start.alias("at"), (start + F.col("strings") + LENGTH - 1).alias("upto"))
    return settle(ranges.unionByName(copies), "repeat-ranges")


def _covered(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted((r["at"], r["upto"]) for r in ranges) if ranges is not None else ():
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return out


def _kept(data: bytes, covered: list) -> bytes:
    edges = [0, *[x for pair in covered for x in pair], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    gathered = ranges.groupBy(F.col("row").alias("_of")).agg(F.collect_set(F.struct("at", "upto")).alias("_ranges"))
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))))
    return keyed.join(gathered, F.col("_row") == F.col("_of"), "left").drop("_of", "_row")


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, ranges in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["_ranges"]):
                data, covered = (text or "").encode("utf-8", "surrogatepass"), _covered(ranges)
                rows.append((doc_id, len(data), sum(b - a for a, b in covered), len(covered), hashlib.sha256(_kept(data, covered)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    rows = _with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), removed_strings(docs))
    return rows.mapInPandas(judge, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``; a character cut in half goes whole, null text stays null."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, ranges in batches:
            yield pd.Series([None if t is None else _kept(t.encode(), _covered(r)).decode(errors="ignore") for t, r in zip(text, ranges)], dtype=object)

    rows = _with_ranges(docs, removed_strings(docs))
    return rows.withColumn("text", cut("text", "_ranges")).drop("_ranges")
