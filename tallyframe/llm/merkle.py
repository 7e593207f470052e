"""Merkle manifest of a table: sibling digests meet by equi-join, level by level.

A row's leaf is the SHA-256 of its columns as text. Leaves of one ``lang`` are numbered by ``doc_id``
over ranges, so that a language that holds most rows is spread over all tasks. A level is a table of
nodes ``(grp, idx, n, digest)``. It is joined with itself: the sibling of node ``idx`` has index
``idx XOR 1`` in a binary tree, and ``idx - idx % arity + slot`` for every other slot otherwise. The
rows in slot zero then emit the parents, with index ``idx // arity``. Each level is settled in the
shared folder before the next, as two things read it: the next level and the proofs. The digests that
remain, one a language, are leaves of the tree above, whose one group is the whole table.

Proofs go the other way: a parent hands its own path to its children, again by equi-join on group and
index, and each child adds its siblings in front. So the path of a leaf costs about two joined rows,
and no join is on a language alone. ``fold`` recomputes a root from a leaf and its path.

Defined results: a null column is ``-`` in a leaf; null languages are a group of their own that comes
first; null ids come before others; rows of one language and id follow each other by their leaf, and
equal rows take neighbouring places in any order; a single row is its own root with an empty path; an
empty table has no rows and no root. Other columns are ignored. Memory is bounded by one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import settle
from tallyframe.operators.ranges import number_in_group

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
#: One in so many ids is tampered with by the query.
TAMPERED = 7
NODE = ("grp", "idx", "n", "digest")
#: Levels of proofs between two cuts of the plan.
CUT_EVERY = 3
#: Siblings of one level, their digests one after the other: those before the node and those after it.
STEP = "struct<before: binary, after: binary>"


def field(value: Column) -> Column:
    """Byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _slot(arity: int) -> Column:
    return F.col("idx") % arity


def _above(arity: int) -> Column:
    """Index of a node's parent."""
    return ((F.col("idx") - _slot(arity)) / arity).cast("long")


def siblings(level: DataFrame, arity: int) -> DataFrame:
    """Each node with the digests of its siblings ``before`` and ``after`` it: one equi-join per sibling."""
    if arity == 2:
        wanted = [F.col("idx").bitwiseXOR(F.lit(1).cast("long"))]
    else:
        # the other slots of the node's run, from the next one on and round again
        wanted = [F.col("idx") - _slot(arity) + (_slot(arity) + step) % arity for step in range(1, arity)]
    found = level
    for i, at in enumerate(wanted):
        other = level.select(F.col("grp").alias(f"_g{i}"), F.col("idx").alias(f"_i{i}"), F.col("digest").alias(f"_d{i}"))
        found = found.join(other, (F.col("grp") == F.col(f"_g{i}")) & (at == F.col(f"_i{i}")), "left")
    met = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_i{i}").isNotNull(), F.struct(F.col(f"_i{i}").alias("i"), F.col(f"_d{i}").alias("d"))) for i in range(len(wanted))])))

    def joined(keep) -> Column:
        return F.aggregate(F.filter(met, keep), F.lit(b""), lambda acc, s: F.concat(acc, s["d"]))

    return found.select(*NODE, joined(lambda s: s["i"] < F.col("idx")).alias("before"), joined(lambda s: s["i"] > F.col("idx")).alias("after"))


def next_level(met: DataFrame, arity: int) -> DataFrame:
    """Parents, emitted by the nodes in slot zero; groups of one node are done and leave."""
    return met.where((F.col("n") > 1) & (_slot(arity) == 0)).select(
        "grp",
        _above(arity).alias("idx"),
        ((F.col("n") + arity - 1 - (F.col("n") + arity - 1) % arity) / arity).cast("long").alias("n"),
        F.unhex(F.sha2(hexed(F.concat("before", "digest", "after")), 256)).alias("digest"),
    )


def levels_of(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """All levels of all groups, leaves first, each with its nodes' siblings, settled."""
    tallest = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    found = [settle(siblings(leaves, arity), "merkle")]
    while tallest > 1:
        found.append(settle(siblings(next_level(found[-1], arity), arity), "merkle"))
        tallest = -(-tallest // arity)
    return found


def tops(levels: Sequence[DataFrame]) -> DataFrame:
    """The one node that remains of each group, with the level on which it does."""
    return reduce(DataFrame.unionByName, [level.where("n = 1").withColumn("height", F.lit(h)) for h, level in enumerate(levels)])


def proofs(levels: Sequence[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """``grp, idx, digest, top, path`` of all leaves: siblings of each level up to the group's top, then the path of ``above``.

    ``above`` has ``grp, height, path`` of the tops.
    """
    step = F.array(F.struct("before", "after").cast(STEP))
    ending = {r["height"] for r in above.select("height").distinct().collect()} | {0}
    down = None
    for height, level in reversed(list(enumerate(levels))):
        found = []
        if height in ending:
            own = level.where("n = 1").join(above.where(F.col("height") == height), "grp")
            found.append(own.select("grp", "idx", "digest", F.col("digest").alias("top"), "path"))
        if down is not None:
            parent = down.select(F.col("grp").alias("_g"), F.col("idx").alias("_i"), "top", "path")
            child = level.where("n > 1").join(parent, (F.col("grp") == F.col("_g")) & (_above(arity) == F.col("_i")))
            found.append(child.select("grp", "idx", "digest", "top", F.concat(step, "path").alias("path")))
        if found:
            down = reduce(DataFrame.unionByName, found)
            # joined levels make a long plan: cut it now and then
            if height and height % CUT_EVERY == 0:
                down = settle(down, "paths")
    return down


def fold(start: Column, path: Column) -> Column:
    """Hex root over a hex digest and its path."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(hexed(s["before"]), acc, hexed(s["after"])), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 over all siblings of a path, level by level, left to right."""
    return F.sha2(hexed(F.aggregate(path, F.lit(b""), lambda acc, s: F.concat(acc, s["before"], s["after"]))), 256)


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``idx`` from 0 inside ``grp`` and ``n``, the group's size; the row itself parts equal rows."""
    rows = settle(nodes.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    placed = number_in_group(rows, ["grp"], [*order, "_row"], name="_at", size="n", cut=lambda df: settle(df, "order"))
    return settle(placed.withColumn("idx", F.col("_at") - 1).drop("_at", "_row"), "placed")


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, claimed`` per row, digests in hex.

    ``claimed`` is the leaf of the row as somebody hands it in: with the columns of ``tampered`` in
    place of the row's own.
    """
    as_given = {c: F.col(c) for c in COLUMNS} | (tampered or {})
    rows = docs.select(
        F.col("doc_id"),
        # null first, then bytewise: the empty string sorts before any that starts with a sign
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        leaf([F.col(c) for c in COLUMNS]).alias("digest"),
        leaf([as_given[c] for c in COLUMNS]).alias("claimed"),
    )
    leaves = numbered(rows, ["doc_id", "digest"])
    forest = levels_of(leaves.select(*NODE), arity)
    subroots = numbered(tops(forest).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", "height"), ["name"])
    upper = levels_of(subroots.select(*NODE), arity)
    top = tops(upper)
    root = top.first()
    start = top.select("grp", "height", F.array().cast(f"array<{STEP}>").alias("path"))
    above = settle(subroots.select("idx", "name", "height").join(proofs(upper, start, arity).select("idx", "path"), "idx").select(F.col("name").alias("grp"), "height", "path"), "above")
    paths = proofs(forest, above, arity).select("grp", "idx", "top", "path")
    return leaves.select("doc_id", "grp", "idx", "digest", "claimed").join(paths, ["grp", "idx"]).select(
        "doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("top")).alias("subroot"),
        hexed(F.lit(bytes(root["digest"]) if root else None).cast("binary")).alias("root"), "path", hexed(F.col("claimed")).alias("claimed"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """A manifest with ``proof_sha256``, ``folded_root`` of the claimed leaf and whether it is the root."""
    return rows.withColumn("proof_sha256", path_digest(F.col("path"))).withColumn("folded_root", fold(F.col("claimed"), F.col("path"))).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def tampered_every(n: int = TAMPERED) -> dict[str, Column]:
    """Where ``n`` divides the CRC-32 of the decimal ``doc_id``, ``n_chars`` is one too many."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == 0
    return {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
