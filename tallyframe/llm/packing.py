"""Best-fit packing of token pieces into sequences of bounded length, by hierarchical rounds.

A document longer than a sequence is cut into full pieces behind a shorter first one. Full pieces
are sequences already. The others are dealt to groups of bounded size and packed there best fit,
longest first. Bins that are nearly full are done; the rest go on as items, whole, to fewer groups,
and are packed by best fit again, until one group is left or a round no longer merges much. A bin
carries its pieces, at most as many as it has tokens, so nothing has to be joined afterwards.

Defined results: null or empty text is the end id alone. Repeated rows are packed as often as they
occur. A null ``doc_id`` is packed like any other. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import settle
from tallyframe.llm.tokens import encoder

LENGTH = 1024
END = 2
#: Items of one task of a round.
GROUP = 40_000
#: A bin with at most so much room left is done before the last round.
SLACK = 2
PIECE = "struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>"
BIN = f"bin long, size int, pieces array<{PIECE}>"


def _cutting(tokenizer: str, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer), np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids = encode.encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % length or length, n, length), n]
                rows += [(doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return run


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInPandas(_cutting(tokenizer, length), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of every item, longest items first, each into the fullest bin that still takes it."""
    bins = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(length + 1)]
    open_rooms, made = 0, 0  # a bit for every amount of room that some bin has
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            left, chosen, made = length, made, made + 1
        bins[i] = chosen
        left -= size
        if left:
            room[left].append(chosen)
            open_rooms |= 1 << left
    return bins


def _packing(length: int, round_: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = group.sort_values("bin", ignore_index=True)
        bins = best_fit(order["size"].to_numpy(), length)
        by = np.argsort(bins, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(bins[by]) > 0])
        sizes = np.add.reduceat(order["size"].to_numpy()[by], starts)
        held = order["pieces"].to_numpy()[by]
        joined = [[p for one in part for p in one] for part in np.split(held, starts[1:])]
        first = (round_ << 58) | (int(group["part"].iloc[0]) << 32)
        return pd.DataFrame({"bin": first + np.arange(len(starts), dtype=np.int64), "size": sizes, "pieces": joined})

    return run


def pack(items: DataFrame, length: int = LENGTH, group: int = GROUP, slack: int = SLACK) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    spark = items.sparkSession
    held = settle(
        items.select(
            F.monotonically_increasing_id().alias("bin"), F.col("length").cast("int").alias("size"),
            F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("pieces"),
        ),
        "pack-items",
    )
    done, round_ = [held.where(F.col("size") == length)], 0
    rest = held.where(F.col("size") < length)
    n, last = rest.count(), None
    while n and (last is None or (last > 1 and n < 0.95 * before)):
        round_, before, last = round_ + 1, n, -(-n // group)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("bin", F.lit(round_)), F.lit(last)).cast("int"))
        packed = settle(dealt.groupBy("part").applyInPandas(_packing(length, round_), BIN), f"pack-{round_}")
        full = F.col("size") >= length - slack
        done.append(packed.where(full))
        rest = packed.where(~full)
        n = rest.count()
    out = done[0]
    for more in [*done[1:], rest]:
        out = out.unionByName(more.select(*out.columns))
    placed = out.select("bin", F.posexplode("pieces").alias("at", "p"), "pieces")
    offset = F.aggregate(F.slice("pieces", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return placed.select("p.*", F.col("bin").alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH, **how) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``docs``."""
    return pack(pieces(docs, tokenizer, length), length, **how)
