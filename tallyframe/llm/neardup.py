"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. Its sketch has ``REGISTERS`` registers; each is
an exponentially spaced, truncated minimum of hashed shingles, so sketches of parts merge by maximum
and two registers agree with about the probability of the sets' Jaccard similarity. Documents with
equal sets are one class. Classes that agree on all registers of a band share a bucket. Inside a
bucket the joint likelihood of the registers that are equal, larger and smaller, with both set sizes
known, gives an estimate of the similarity; pairs that are surely too different drop out, and the
rest are confirmed on their full sets. Links become components by minimum labels with jumps.

No task emits pairs: a bucket is dealt into blocks of ``BLOCK`` members, a task compares two blocks
and emits at most one link per member, enough to join what it has confirmed. A pair is looked at only
in the first band it shares. A member of a bucket of n is therefore copied n / ``BLOCK`` times.

Defined results: null, empty or blank text has no shingles and is linked with nothing; fewer words
than a shingle are one shingle. A null ``doc_id`` is linked with nothing. Rows of one ``doc_id`` are
one document for linking and a row each in the result. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import parts_for, settle

WORDS = 5
#: Similarity in hundredths from which documents are linked, unless the caller asks for another.
PERCENT = 80
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.1, 20.0, 254
BLOCK = 200
#: Standard errors below the asked similarity at which an estimate rules a pair out.
MARGIN = 6.0
#: Bytes of text that are hashed at once.
SLICE = 4_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word, in order; words longer than the power table go by a digest."""
    codes = np.frombuffer(data, np.uint8)
    gaps = _SPACE[codes]
    edges = np.flatnonzero(np.diff(np.r_[True, gaps, True].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    inside = np.arange(len(codes)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(codes)]))
    terms = np.where(gaps, np.uint64(0), (codes.astype(np.uint64) + np.uint64(1)) * _POWERS[inside % len(_POWERS)])
    out = _mix(np.add.reduceat(terms, starts) + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > len(_POWERS)):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    parts, at = [], 0
    while len(data) - at > SLICE:
        cut = max(data.rfind(s, at, at + SLICE) for s in (b" ", b"\n"))
        cut = cut + 1 if cut >= at else len(data)
        parts.append(_word_hashes(data[at:cut]))
        at = cut
    parts.append(_word_hashes(data[at:]))
    words = np.concatenate(parts)
    n = len(words)
    if not n:
        return words
    width = min(n, WORDS)
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total = _mix(total * np.uint64(3) + words[k : n - width + 1 + k])
    return np.unique(total + np.uint64(width))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of hashes; 0 for an empty one."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint8)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), 2048):
        x = low[at : at + 2048, None] * _FACTORS + _OFFSETS
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        least = np.minimum(least, x.min(0))
    values = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(values) / np.log(BASE)), 0, TOP + 1).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(above: np.ndarray, below: np.ndarray, na: np.ndarray, nb: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity that makes the register comparison most likely, on a grid of hundredths.

    ``above``: registers larger in a; ``below``: in b. With set sizes known, a register of a is
    larger with probability p(u - vJ), of b with p(v - uJ), where p(x) = -log_base(1 - x (base-1)/base).
    """
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for j in np.arange(0.4, 1.0, 0.01):
        up, down = p(u - v * j), p(v - u * j)
        same = np.maximum(1e-9, 1 - up - down)
        value = above * np.log(up) + below * np.log(down) + (m - above - below) * np.log(same)
        better = value > best
        best, at = np.where(better, value, best), np.where(better, j, at)
    return at


def _fingerprinting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            own = shingles(text)
            rows.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), sketch(own).tobytes()))
        out = pd.DataFrame(rows, columns=["n", "set_id", "sketch"])
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
        yield out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n, set_id, sketch`` of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInPandas(_fingerprinting, "doc_id long, n long, set_id binary, sketch binary")


def _banding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tags = np.arange(BANDS, dtype=np.uint64) << np.uint64(8 * ROWS)
    for batch in batches:
        if len(batch):
            registers = np.frombuffer(b"".join(batch["sketch"]), np.uint8).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = tags + sum(registers[:, :, k] << np.uint64(8 * k) for k in range(ROWS))
            yield pd.DataFrame({"key": keys.astype(np.int64).ravel(), "id": np.repeat(batch["id"].to_numpy(), BANDS)})


def _by_group(keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame]):
    """Runs ``work`` on sorted rows in slices that never part a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            changes = np.flatnonzero((batch[keys].to_numpy()[1:] != batch[keys].to_numpy()[:-1]).any(1)) + 1
            if held and (held[-1][keys].iloc[-1].to_numpy() != batch[keys].iloc[0].to_numpy()).any():
                changes = np.r_[0, changes]
            if not len(changes):
                held.append(batch)
                continue
            cut = changes[-1]
            yield work(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
            held = [batch.iloc[cut:]]
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return run


GROUP = ["key", "i", "j"]


def _close_pairs(rows: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs inside groups that the sketches don't rule out and that belong to this band and block pair."""
    keys = rows[GROUP].to_numpy()
    new = np.r_[True, (keys[1:] != keys[:-1]).any(1)]
    group = np.cumsum(new)
    n, block, ids = rows["n"].to_numpy(), rows["block"].to_numpy(), rows["id"].to_numpy()
    registers = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, REGISTERS)
    band = (rows["key"].to_numpy() >> (8 * ROWS)).astype(int)
    cross = rows["i"].to_numpy() != rows["j"].to_numpy()
    left, right, step = [], [], 1
    alive = np.arange(len(rows))
    while len(alive):
        alive = alive[alive + step < len(rows)]
        alive = alive[group[alive] == group[alive + step]]
        a, b = alive, alive + step
        fits = (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (~cross[a] | (block[a] != block[b])) & (ids[a] != ids[b])
        a, b = a[fits], b[fits]
        for at in range(0, len(a), 20_000):
            x, y = a[at : at + 20_000], b[at : at + 20_000]
            same = registers[x] == registers[y]
            mine = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[x]
            x, y = x[mine], y[mine]
            above, below = (registers[x] > registers[y]).sum(1), (registers[x] < registers[y]).sum(1)
            aim = percent / 100
            sure = aim - MARGIN * np.sqrt(aim * (1 - aim) / REGISTERS)
            near = estimate(above, below, n[x].astype(float), n[y].astype(float)) >= sure
            left.append(x[near])
            right.append(y[near])
        step += 1
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _screen(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Rows with at least one possible partner in their group."""
    a, b = _close_pairs(rows, percent)
    return rows.iloc[np.unique(np.r_[a, b])]


def _confirm(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links, confirmed on full sets, that join whatever is linked in each group."""
    a, b = _close_pairs(rows, percent)
    sets = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            small, large = sorted((sets[x], sets[y]), key=len)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            shared = int((large[at] == small).sum())
            if 100 * shared >= percent * (len(small) + len(large) - shared):
                parent[p] = q
                links.append((x, y))
    ids = rows["id"].to_numpy()
    found = np.array(links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})


def _hashing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "hashes": [shingles(x).tobytes() for x in batch["text"]]})


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links ``a, b`` between classes (``id, n, sketch``) of ``percent`` or more, enough of them for the components."""
    spark = docs.sparkSession
    bands = classes.select("id", "sketch").mapInPandas(_banding, "key long, id long")
    shared = settle(bands.groupBy("key").agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1"), "near-buckets")
    members = bands.join(shared, "key")
    blocks = F.ceil(F.col("in_bucket") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), blocks).cast("int")
    dealt = (
        members.select("key", "id", own.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block")
    )
    kind = "key long, i int, j int, id long, block int, n long, sketch binary"
    grouped = lambda df: df.repartition(parts_for(spark), *GROUP).sortWithinPartitions(*GROUP, "id")
    rows = grouped(dealt.join(classes, "id").select("key", "i", "j", "id", "block", "n", "sketch"))
    near = settle(rows.mapInPandas(_by_group(GROUP, functools.partial(_screen, percent=percent)), kind), "near-candidates")
    wanted = near.select("id").distinct()
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted.hint("merge"), "id", "left_semi")
    sets = settle(texts.mapInPandas(_hashing, "id long, hashes binary"), "near-sets")
    full = grouped(near.join(sets, "id").select(*near.columns, "hashes"))
    return settle(full.mapInPandas(_by_group(GROUP, functools.partial(_confirm, percent=percent)), "a long, b long").distinct(), "near-links")


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable, for every id of ``edges`` (``a, b``).

    Every round takes the smallest label around, then the label of that label, until nothing changes.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around, labels["id"] == around["a"]).select("id", "label", F.least("label", "near").alias("next"))
        lower = settle(lower, "labels")
        jump = lower.select(F.col("id").alias("over"), F.col("next").alias("jump"))
        moved = settle(lower.join(jump, lower["next"] == jump["over"]).select("id", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("label")).alias("moved")), "labels")
        labels = moved.select("id", "label")
        if not moved.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``), linked from ``percent`` hundredths on."""
    prints = settle(fingerprints(docs), "near-prints")
    classes = settle(
        prints.where("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "near-classes",
    )
    found = components(links(docs, classes.select("id", "n", "sketch"), percent))
    named = settle(classes.select("set_id", "id").join(found, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id")), "near-named")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return prints.select("doc_id", "n", "set_id").join(named, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest id of every component; columns as they are."""
    kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
