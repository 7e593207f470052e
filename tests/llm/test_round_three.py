"""Lexicon, Merkle manifest and whitening against brute force, with every awkward case and on empty tables."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import document_rows, documents, vector_rows, vectors

from tallyframe.llm import lexicon, merkle, whitening


# --- lexicon ---


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(lexicon.TOKENIZER))


AWKWARD = [
    "the", " ", "\n", "'s", "'", "re", "12", "Ä", "é", "İ", "Σ", "ſ", "ŉ", "漢字", "́", " ", "\t", "\x1c", "<|", "<|startoftext|>", "<|endoftext|>",
    "|>", "…", "“", "x" * 60, "ab" * 40, "🙂", "½", "ª", " ", "\r", "Ж", "!!", "ǅ", "ﬁ", "ẞ", "K", "ا", "१", "\x00", "\x85",
]


def test_words_and_merges_are_those_of_the_library():
    rng, tool, wanted = random.Random(1), lexicon.merger(lexicon.TOKENIZER), library()
    for _ in range(4000):
        text = "".join(rng.choice(AWKWARD) for _ in range(rng.randrange(1, 12)))
        assert [i for w in tool.words(text) for i in tool.merge(w)] == wanted.encode(text, add_special_tokens=False).ids, repr(text)


def test_heap_and_scan_merge_alike():
    rng, tool = random.Random(2), lexicon.merger(lexicon.TOKENIZER)
    for _ in range(300):
        word = "".join(rng.choice("aehinorst") for _ in range(rng.randrange(2, 120)))
        data = word.encode()
        ids = [*(tool.inner[b] for b in data[:-1]), tool.last[data[-1]]]
        assert tool._scan(list(ids)) == tool._queue(list(ids))


def test_automaton_is_minimal_and_numbers_words_in_order(tmp_path):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))).encode() for _ in range(400)})
    # states of the smallest automaton: different sets of endings over all beginnings
    endings = {frozenset(w[len(b) :] for w in words if w.startswith(b)) for b in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(lexicon.minimal(words)) == len(endings)
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.compiled(words, [[i] * (i % 3) for i in range(len(words))]))
    known = lexicon.Lexicon(str(path))
    assert isinstance(known.keys.base, np.memmap) or isinstance(known.keys, np.memmap)
    asked = [w.decode() for w in words] + ["", "zz", "a" * 40, "abcabcabca"]
    assert known.numbers(asked).tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert [known.ids[known.offsets[i] : known.offsets[i + 1]].tolist() for i in range(5)] == [[i] * (i % 3) for i in range(5)]
    path.write_bytes(lexicon.compiled([], []))
    assert lexicon.Lexicon(str(path)).numbers(["a", ""]).tolist() == [-1, -1]


@pytest.mark.parametrize("most", (lexicon.MOST_WORDS, 20, 0))
def test_lexicon_of_any_size_gives_the_ids_of_the_library(spark, most, monkeypatch):
    wanted, want = library(), collections.Counter()
    extra = [(200, "<|startoftext|> und <|endoftext|>", None, None), (201, " ".join(AWKWARD), None, None)]
    for i, text, *_ in document_rows() + extra:
        ids = wanted.encode(text or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), wanted.decode(ids, skip_special_tokens=False)] += 1
    docs = documents(spark).select("doc_id", "text", "id", "row").union(spark.createDataFrame([(i, t, 1, "r") for i, t, *_ in extra], "doc_id long, text string, id long, row string"))
    got = lexicon.round_trip(docs, most=most).collect()
    assert collections.Counter((r["doc_id"], bytes(r["ids"]), r["text"]) for r in got) == want


def test_word_counts_are_of_all_texts(spark):
    tool, want = lexicon.merger(lexicon.TOKENIZER), collections.Counter()
    for _, text, *_ in document_rows():
        want.update(tool.words(text or ""))
    got = {r["word"]: r["n"] for r in lexicon.word_counts(documents(spark)).collect()}
    assert got == {w: n for w, n in want.items() if n > 1 and len(w.encode()) <= lexicon.LONG}


# --- Merkle manifest ---


def h(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row) -> str:
    i, text, lang, source = row[:4]
    n = row[4] if len(row) > 4 else len(text or "")
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree_of(leaves: list[str], arity: int):
    """Root of the leaves and, for each, its path of (siblings before, siblings after)."""
    paths: list[list] = [[] for _ in leaves]
    level, at = leaves, list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i - i % arity
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + arity])))
            at[k] = i // arity
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return (level[0] if level else None), paths


def manifest_by_hand(rows, arity: int) -> collections.Counter:
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf_of(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        below[name] = tree_of([x[1] for x in groups[name]], arity)
    root, above = tree_of([below[name][0] for name in names], arity)
    want = collections.Counter()
    for name, over in zip(names, above):
        subroot, paths = below[name]
        for (i, leaf, row), path in zip(groups[name], paths):
            path = path + over
            hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
            folded = leaf_of((*row[:4], len(row[1] or "") + 1)) if hit else leaf
            for before, after in path:
                folded = h(before, folded, after)
            want[i, leaf, subroot, root, h(*(a + b for a, b in path)), folded, folded == root] += 1
    return want


MERKLE = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("arity", (2, 3, 4))
def test_merkle(spark, arity):
    rows = merkle.verified(merkle.manifest(documents(spark), merkle.tampered_every(), arity)).collect()
    assert collections.Counter(tuple(r[c] for c in MERKLE) for r in rows) == manifest_by_hand(document_rows(), arity)
    assert {r["verified"] for r in rows} == {True, False}


@pytest.mark.parametrize("n", (1, 2, 5))
def test_merkle_of_few_rows(spark, n):
    rows = [(i, f"text {i}", "en" if i % 2 else None, "s", 6) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.verified(merkle.manifest(docs)).collect()
    want = manifest_by_hand(rows, 2)
    assert {(r["doc_id"], r["leaf"], r["root"], r["proof_sha256"]) for r in got} == {(i, leaf, root, proof) for i, leaf, _, root, proof, *_ in want}
    assert all(r["verified"] for r in got)


def test_merkle_has_no_part_in_one_task(spark):
    """A level meets itself by equi-join alone."""
    level = spark.createDataFrame([("=en", i, 5, bytes([i]) * 32) for i in range(5)], "grp string, idx long, n long, digest binary")
    for arity in (2, 3):
        plan = merkle.siblings(level, arity)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan


# --- whitening ---


def fitted_by_hand():
    rows = [(i, v) for i, v in vector_rows() if v and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(np.float64) * 1024).astype(np.int64) + 100_000
    return [i for i, _ in rows], x


def test_whitening(spark):
    ids, x = fitted_by_hand()
    n, total = len(x), x.sum(0)
    values, components = np.linalg.eigh(np.cov(x.T, bias=True))
    values, components = values[::-1], components[:, ::-1]
    want = (x - total / n) @ components / np.sqrt(values)
    got = whitening.whiten(vectors(spark)).collect()
    assert len(got) == 8 * n and max(r["identity_error"] for r in got) < 1e-9 and {r["n"] for r in got} == {n}
    far = collections.Counter((i, int(d)) for i, d in zip(ids, ((n * x - total) ** 2).sum(1)))
    for k in range(8):
        rows = [r for r in got if r["component"] == k + 1]
        assert collections.Counter((r["vec_id"], int(r["deviation"])) for r in rows) == far
        assert {round(r["explained"], 9) for r in rows} == {round(values[k] / values.sum(), 9)}
        sign = np.sign(next(r["whitened"] for r in rows if r["vec_id"] == ids[5]) * want[5, k])
        key = lambda p: (p[0] is not None, p[0] or 0, p[1])
        found = sorted(((r["vec_id"], sign * r["whitened"]) for r in rows), key=key)
        for (a, w), (b, v) in zip(found, sorted(zip(ids, want[:, k]), key=key)):
            assert a == b and abs(w - v) < 1e-6


def test_covariance_is_exact_far_from_zero(spark):
    """Small spread on a large mean, and entries whose squares need more than a long."""
    rng = random.Random(5)
    for far in (2.0**20, 2.0**40):
        rows = [(i, [far + rng.randrange(100) * (1 if far < 2**30 else 2.0**31), -far + i % 7, 3.0]) for i in range(90)]
        x = [[int(np.floor(c * 1024)) + 100_000 for c in v] for _, v in rows]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
        kept, dims = whitening.fit_list(df)
        fitted = whitening.Whitening(kept, dims)
        n = len(x)
        sums = [sum(c) for c in zip(*x)]
        for i in range(3):
            for j in range(3):
                exact = sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / n**3
                assert fitted.covariance[i, j] == pytest.approx(exact, rel=1e-15, abs=0)
        got = fitted.apply(kept).collect()
        assert {r["vec_id"]: int(r["deviation"]) for r in got} == {i: sum((n * c - s) ** 2 for c, s in zip(row, sums)) for i, row in enumerate(x)}
        assert not fitted.real[2] and {r["w"][2] for r in got} == {0.0}


def test_whitening_of_a_single_row(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in got] == [(1, 0.0, 0.0, 0.0, 0), (2, 0.0, 0.0, 0.0, 0)]


def test_empty_tables(spark):
    docs, vecs = documents(spark).limit(0), vectors(spark).limit(0)
    assert lexicon.round_trip(docs).collect() == []
    assert merkle.verified(merkle.manifest(docs, merkle.tampered_every())).collect() == []
    assert whitening.whiten(vecs).collect() == []
    assert whitening.whiten(vectors(spark).where("vec_id in (400, 401, 403)")).collect() == []


# --- fingerprints: planning and likeness ---


def test_fingerprints_plan_with_many_ranges(spark):
    """Nothing in the plan grows with the number of partitions but one array of range ends."""
    from tallyframe.llm import syncmers

    docs = documents(spark)
    want = collections.Counter((r["doc_id"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in syncmers.fingerprints(docs).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1000")
        out = syncmers.fingerprints(docs)
        assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 100_000
        got = collections.Counter((r["doc_id"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in out.collect())
        spark.conf.set("spark.sql.shuffle.partitions", "10000")
        syncmers.fingerprints(docs)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_likeness_is_that_of_the_returned_fingerprints(spark):
    from tallyframe.llm import syncmers

    for r in syncmers.fingerprints(documents(spark)).collect():
        a, b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_edited"] == (1.0 if not a | b else len(a & b) / len(a | b))
