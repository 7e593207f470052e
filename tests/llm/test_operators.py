"""Each numbered operator against a brute-force version on tables with every awkward case, and on empty ones."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from fixtures import document_rows, documents, page_rows, pages, vector_rows, vectors

from tallyframe.llm import common, langid, mixing, mtree, neardup, packing, repeats, sequences, syncmers, urls, warc


def rows_of(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_empty_tables(spark):
    docs, web, vecs = documents(spark).limit(0), pages(spark).limit(0), vectors(spark).limit(0)
    for df in (
        warc.round_trip(web), syncmers.fingerprints(docs), sequences.round_trip(docs), mtree.search(vecs, vecs["vec_id"] % 50 == 0), packing.pack_documents(docs),
        urls.judge(web), neardup.near_duplicates(docs), mixing.mix(docs), mixing.mixed(docs), langid.predict(docs), langid.keep_known(docs), repeats.repeats(docs), repeats.without_repeats(docs),
    ):
        assert df.collect() == []


def test_warc(spark):
    smallest: dict = {}
    for i, _, html in page_rows():
        known = smallest.get(html or "")
        smallest[html or ""] = i if known is None else min(known, i if i is not None else known)
    want = collections.Counter()
    for i, _, html in page_rows():
        data, first = (html or "").encode(), smallest[html or ""]
        kind = "response" if first == i else "revisit"
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, first if kind == "revisit" else None)] += 1
    path = common.shared_folder(spark, "warc-test")
    warc.write(pages(spark), path)
    assert rows_of(warc.read(spark, path), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    texts = {i: html for i, _, html in page_rows()}
    for r in warc.originals(spark, path).collect():
        head, blank, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[length:] == b"\r\n\r\n" and head.count(b"WARC-Type: ") + head.count(b"WARC-Type:%20") == 1 + (r["page_id"] == 97)
        if b"WARC-Type: response\r\n" in head:
            assert rest[:length].partition(b"\r\n\r\n")[2] == (texts[r["page_id"]] or "").encode()
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len(smallest)


def test_warc_notices_a_changed_payload(spark):
    from pyspark.sql import functions as F

    path = common.shared_folder(spark, "warc-test")
    warc.write(pages(spark), path)
    bad = common.shared_folder(spark, "warc-bad")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{bad}/records")
    with pytest.raises(Exception, match="differs from its address"):
        warc.read(spark, bad).collect()


def anchors_of(text: str) -> tuple[str, ...]:
    """Word runs that are anchors do not depend on what is around them; brute force works on the hashes Spark gives."""
    return tuple(w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w)


def test_syncmers(spark):
    from pyspark.sql import functions as F

    got = syncmers.fingerprints(documents(spark)).collect()
    keys = spark.createDataFrame([(i, t or "") for i, t, *_ in document_rows()], "i long, t string").select("i", "t", F.xxhash64("t").alias("h")).collect()
    order = sorted(((r["i"], r["h"], r["t"]) for r in keys), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = collections.Counter()
    for (i, _, text), (_, _, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        want[(i, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    texts = {i: t or "" for i, t, *_ in document_rows()}
    by_words = collections.defaultdict(set)
    for r in got:
        by_words[anchors_of(texts[r["doc_id"]])].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["n_anchors"] > 0) == bool(anchors_of(texts[r["doc_id"]])) and len(r["fingerprint"]) == 8 * r["n_anchors"]
    assert all(len(x) == 1 for x in by_words.values())
    long = [r for r in got if r["doc_id"] == 95][0]
    assert 0.2 < long["near_edited"] < 0.6 and long["n_anchors"] > 500


def test_syncmers_are_context_free(spark):
    """A run of words is an anchor wherever it stands."""
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", "y", "z", *words, "q"]))], "doc_id long, text string")
    found = {r["doc_id"]: r["a"] for r in syncmers._with_anchors(df, "text", "a").collect()}
    assert set(found[1]) <= set(found[2])
    inner = {r["doc_id"]: r["h"] for r in df.selectExpr("doc_id", "transform(split(text, ' '), x -> xxhash64(x)) as h").collect()}[1]
    runs = spark.createDataFrame([(i, inner[i : i + 3]) for i in range(58)], "i long, h array<bigint>").selectExpr("i", "xxhash64(h[0], h[1], h[2]) as s").collect()
    s = [r["s"] for r in sorted(runs)]
    assert len(found[1]) == sum(min(s[i : i + 6]) in (s[i], s[i + 5]) for i in range(53))


def encoded(file: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_sequences(spark):
    encode, at, want = encoded("word_bpe_49k.json"), 0, collections.Counter()
    rows = sorted(document_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text, *_ in rows:
        ids = encode(text)
        want[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    assert rows_of(sequences.round_trip(documents(spark), length=64), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_sequence_files_are_fixed_size(spark):
    import pyarrow as pa

    folder = common.shared_folder(spark, "sequences-test")
    manifest = sequences.write(documents(spark), folder, length=64).collect()
    for m in manifest:
        with pa.memory_map(f"{folder.removeprefix('file://')}/{m['path']}.arrow") as f:
            file = pa.ipc.open_file(f)
            assert file.schema.field("ids").type == pa.list_(pa.uint16(), 64) and file.schema.field("mask").type == pa.list_(pa.bool_(), 64)
            assert sum(file.get_batch(i)["mask"].flatten().true_count for i in range(file.num_record_batches)) == m["n_tokens"]


def test_part_cuts_keep_ids():
    import random

    from tallyframe.llm.tokens import Encoder

    rng = random.Random(3)
    signs = [*"aB'.\n\t1, ", "\x1c", "\x85", "\u00a0", "\u3000", "é", "e\u0301", "Σ", "  ", "\u200b", "'s", "<|endoftext|>", "漢", "\0", "ß", "İ"]
    for file in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encode = Encoder(file)
        for _ in range(1500):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
            assert np.frombuffer(encode.encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(spark):
    encode = encoded("byte_bpe_50k.json")
    got = packing.pack_documents(documents(spark)).collect()
    pieces = collections.Counter()
    total = 0
    for i, text, *_ in document_rows():
        ids = encode(text)
        total += len(ids)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == pieces
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(total / 1024) + 2


def test_packing_in_many_groups_and_rounds(spark):
    rng = np.random.default_rng(5)
    sizes = np.minimum(1024, rng.geometric(1 / 300, 3000))
    items = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(items, group=200).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    used = collections.Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) <= 1.02 * sizes.sum() / 1024


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    found = [(len(r), r, v) for v, r in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(found)[1:] if found else (None, None)


def brute_url_scores(all_urls):
    """The same model by plain counting."""
    def norm(u):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in u or "")
        return "^^^" + re.sub(r"[^a-z0/._?=&%:~+-]", "*", re.sub("[0-9]", "0", text)) + "$"

    counts = {v: collections.Counter() for v in ("allow", "block")}
    for u in all_urls:
        verdict = ruled(*host_path(u))[1]
        s = norm(u)
        if verdict:
            for i in range(3, len(s)):
                for k in range(4):
                    counts[verdict][s[i - k : i + 1]] += 1
    follow = {v: collections.defaultdict(list) for v in counts}
    for v, c in counts.items():
        for gram, n in c.items():
            follow[v][(gram[:-1], len(gram))].append(n)

    def p(v, gram):
        value = 1 / urls.SYMBOLS
        for k in range(4):
            g = gram[3 - k :]
            around = follow[v].get((g[:-1], k + 1))
            if around:
                value = (counts[v][g] + len(around) * value) / (sum(around) + len(around))
        return value

    out = {}
    for u in set(all_urls):
        s = norm(u)
        out[u] = sum(math.log(p("allow", s[i - 3 : i + 1])) - math.log(p("block", s[i - 3 : i + 1])) for i in range(3, len(s))) / (len(s) - 3)
    return out


def test_urls(spark):
    rows = page_rows()
    got = urls.judge(pages(spark)).collect()
    assert collections.Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == collections.Counter((i, *host_path(u), ruled(*host_path(u))[0]) for i, u, _ in rows)
    scores, by_id = brute_url_scores([u for _, u, _ in rows]), {i: u for i, u, _ in rows}
    decided = {r["page_id"]: ruled(r["host"], r["path"])[1] for r in got}
    for r in got:
        assert abs(r["score"] - scores[by_id[r["page_id"]]]) < 1e-9
        assert r["verdict"] == decided[r["page_id"]] or decided[r["page_id"]] is None
    free = [r for r in got if decided[r["page_id"]] is None]
    assert free and max((r["score"] for r in free if r["verdict"] == "block"), default=-99) < min((r["score"] for r in free if r["verdict"] == "allow"), default=99)


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert {(r["verdict"], r["score"]) for r in urls.judge(df).collect()} == {("allow", 0.0)}


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows if i is not None}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sets, label


def test_near_duplicates(spark):
    rows = document_rows()
    sets, label = brute_components(rows)
    want = collections.Counter((i, len(shingle_set(t)), label.get(i), label.get(i) == i) for i, t, *_ in rows)
    assert rows_of(neardup.near_duplicates(documents(spark)), "doc_id", "n_shingles", "component_id", "kept") == want
    assert len(set(label.values())) < len(label) - 8
    kept = collections.Counter(r["doc_id"] for r in neardup.one_of_each(documents(spark)).collect())
    assert kept == collections.Counter(i for i, *_ in rows if label.get(i) == i)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = document_rows()
    _, label = brute_components(rows)
    got = neardup.near_duplicates(documents(spark)).collect()
    assert all(r["component_id"] == label.get(r["doc_id"]) for r in got)


def test_near_duplicates_from_80_on(spark):
    """Pairs between 0.80 and 0.85 are linked by the pipeline's stage and not by op7; one below 0.80 by neither."""
    import corpus_pipeline

    rows = []
    for k in range(12):  # an edited word loses five shingles
        words = [f"p{k}w{j}" for j in range(204)]
        edited = (20, 60, 100, 140) if k < 11 else (20, 60, 100, 140, 180)
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join("x" if j in edited else w for j, w in enumerate(words)))]
    sets = {i: shingle_set(t) for i, t in rows}
    alike = {k: len(sets[10 * k] & sets[10 * k + 1]) / len(sets[10 * k] | sets[10 * k + 1]) for k in range(12)}
    assert all(0.8 < alike[k] < 0.85 for k in range(11)) and alike[11] < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {10 * k for k in range(12)} | {111}
    assert all(r["kept"] for r in neardup.near_duplicates(docs, percent=85).collect())


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    for shared in (300, 900):
        a, b, c = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (shared, 1000 - shared, 1000 - shared))
        x, y = np.concatenate([a, b]), np.concatenate([a, c])
        sx, sy = neardup.sketch(x), neardup.sketch(y)
        assert (neardup.merge(sx, sy) == neardup.sketch(np.concatenate([x, y]))).all()
        found = neardup.estimate(np.array([(sx > sy).sum()]), np.array([(sx < sy).sum()]), np.array([1000.0]), np.array([1000.0]))[0]
        assert abs(found - max(0.4, shared / (2000 - shared))) < 0.12


def test_components_of_a_long_chain(spark):
    import random

    ids = list(range(300))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids[:200], ids[1:200])) + list(zip(ids[200:], ids[201:])), "a long, b long")
    got = {r["id"]: r["component"] for r in neardup.components(edges).collect()}
    assert {got[i] for i in ids[:200]} == {min(ids[:200])} and {got[i] for i in ids[200:]} == {min(ids[200:])}


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, fixed, left = {}, {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        target = fixed | {s: (left - sum(fixed.values())) * weight[s] / total for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    rows = document_rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    targets, got = brute_targets(sizes), mixing.mix(documents(spark)).collect()
    assert len(got) == len(rows) and got != [] and sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(spark)).collect()))
    source = {(i, size(t)): s for i, t, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[(r["doc_id"], r["size"])]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-6 and r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - targets[s]) <= 6000 / 2 + 1 for s in sizes)
    mix = collections.Counter()
    for r in mixing.mixed(documents(spark)).collect():
        mix[r["source"]] += size(r["text"])
    assert mix == +taken


def brute_mix(rows, need):
    """Documents taken once more: ``rows`` of one source as id and size, by certainties one after the other."""
    pool, sure = {i: n for i, n in rows if n}, set()
    while pool and need > 0:
        rate = need / sum(n * n for n in pool.values())
        most = max(pool.values())
        if rate * most < 1:
            break
        over = {i for i, n in pool.items() if n == most}
        sure, need = sure | over, need - most * len(over)
        pool = {i: n for i, n in pool.items() if i not in over}
    if need <= 0 or not pool:
        return sure
    u = {i: (int(hashlib.md5(f"{i}mix".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for i in pool}
    at = 0
    for i in sorted(pool, key=lambda i: u[i] / (1 - u[i]) / (rate * pool[i] / (1 - rate * pool[i]))):
        at += pool[i]
        if at - pool[i] / 2 > need:
            break
        sure.add(i)
    return sure


def test_mix_follows_the_rank(spark):
    """Certain documents and those of smallest random odds over own odds are taken once more, and no others."""
    size = lambda i: 900 if i % 1001 == 5 else 1 + i % 7
    df = spark.createDataFrame([(i, "w " * size(i), "abc"[i % 3]) for i in range(6000)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    partly = 0
    for k in range(3):
        own = {r["doc_id"]: r for r in got if r["doc_id"] % 3 == k}
        one = next(iter(own.values()))
        base = int(one["target"] // one["source_size"])
        taken = brute_mix([(i, size(i)) for i in own], one["target"] - base * one["source_size"])
        assert {i: r["copies"] for i, r in own.items()} == {i: base + (i in taken) for i in own}
        partly += 0 < len(taken) < len(own)
    assert partly


def test_larger_inclusion_odds_are_taken_more_often(spark):
    """Of documents of 1, 2, 4 and 8 words, eight times the size is about eight times the odds."""
    df = spark.createDataFrame([(i, "w " * (1 << i % 4), "ab"[i >= 8000]) for i in range(16000)], "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1, 40), share=0.8, most=1.0).collect()
    own = [r for r in got if r["doc_id"] < 8000]
    share = {n: sum(r["copies"] for r in own if r["size"] == n) / 2000 for n in (1, 2, 4, 8)}
    assert 0 < share[1] < share[2] < share[4] < share[8] < 1 and 6 < share[8] / share[1] < 10.7


def test_mix_of_equal_rows(spark):
    """Rows that nothing tells apart are split where the sample ends: each source is within a document of its target."""
    rows = [(None, "a b c d", "x")] * 3000 + [(7, "a b c", "y")] * 2000 + [(i, "a b", "z") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for size in (2, 3, 4):
        own = [r for r in got if r["size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= size
    again = collections.Counter(r["source"] for r in mixing.mixed(df).collect())
    assert again == {s: sum(r["copies"] for r in got if r["size"] == n) for s, n in (("x", 4), ("y", 3), ("z", 2))}


def test_language(spark):
    got = langid.predict(documents(spark)).collect()
    assert len(got) == len(document_rows())
    right = total = 0
    want = {i: (t, lang) for i, t, lang, _ in document_rows()}
    for r in got:
        text, lang = want[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1
        if r["held_out"] and lang and r["lang_pred"] != "und" and len(text) > 100:
            right, total = right + (r["lang_pred"] == lang), total + 1
    assert total > 5 and right / total >= 0.95
    assert all(r["lang"] for r in langid.keep_known(documents(spark)).select("lang").where("doc_id < 60").collect())


def test_every_label_is_learned(spark):
    """300 languages with an alphabet of their own each: all are learned and told apart."""
    letters = [chr(0x4E00 + 10 * k + j) for k in range(300) for j in range(10)]
    word = lambda k, n: "".join(letters[10 * k + (n * 3 + j) % 10] for j in range(4))
    rows = [(k * 8 + n, " ".join(word(k, n + m) for m in range(12)), f"l{k:03}") for k in range(300) for n in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    want = {i: lang for i, _, lang in rows}
    taught = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    got = langid.predict(df).collect()
    assert len(got) == len(rows) and len(taught) > 295
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in got if want[r["doc_id"]] in taught)


def test_spans_of_mixed_text_equal_exhaustive_viterbi():
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), np.ones((langid.N_SCRIPTS, 3), bool))
    scores = [np.round(rng.normal(0, 8, (n, 3)), 3) for n in (0, 1, 2, 7, 7, 30)]
    model.word_scores = lambda t: (scores[int(t)], np.ones(len(scores[int(t)]), int))
    for labels, s in zip(model.labels([str(i) for i in range(len(scores))])[0], scores):
        value = lambda path: sum(s[i, x] for i, x in enumerate(path)) - langid.SWITCH * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
        best = {(): 0.0}
        for i in range(len(s)):
            step = {}
            for path in best:
                for x in range(3):
                    new = (*path, x)
                    if (x not in step) or value(new) > value(step[x]):
                        step[x] = new
            best = {p: 0 for p in step.values()}
        assert len(labels) == len(s) and abs(value(labels.tolist()) - max(map(value, best))) < 1e-6


def brute_repeats(rows):
    first, want = {}, collections.Counter()
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        cov = bytearray(len(data))
        for k in range(len(data) - 49):
            owner = first.setdefault(data[k : k + 50], i)
            if owner != i:
                cov[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, c in zip(data, cov) if not c)
        spans = sum(1 for k in range(len(data)) if cov[k] and not (k and cov[k - 1]))
        want[(i, len(data), sum(cov), spans, hashlib.sha256(kept).hexdigest())] += 1
    return want


def test_repeats(spark):
    want = brute_repeats(document_rows())
    assert rows_of(repeats.repeats(documents(spark)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(1 for r in want if r[2]) > 10
    cut = repeats.without_repeats(documents(spark))
    assert cut.columns == documents(spark).columns and cut.count() == len(document_rows())


def test_repeats_over_slices_and_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 300)
    monkeypatch.setattr(repeats, "PART", 500)
    assert rows_of(repeats.repeats(documents(spark)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(document_rows())


def hot_rows():
    """A line of 40 bytes in 400 different surroundings, a passage around it in some, and copies of one text."""
    import random

    rng = random.Random(4)
    line, passage = "one very common line of forty bytes, so.", "some words before and " + "one very common line of forty bytes, so." + " and some after"
    noise = lambda: "".join(rng.choice("abcdefghij ") for _ in range(60))
    rows = [(i, noise() + (passage if i % 7 == 0 else line) + noise()) for i in range(400)]
    return rows + [(400 + i, rows[3][1]) for i in range(20)] + [rows[5]] * 5 + [(None, rows[9][1])] * 2


def test_repeats_around_a_hot_anchor(spark, monkeypatch):
    """No group of the suffix sort holds more than the anchors that fit a part, and results stay the same."""
    monkeypatch.setattr(repeats, "PART", 2000)
    monkeypatch.setattr(repeats, "MOST", 20_000)
    rows = hot_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(repeats.repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)
    texts, copies = repeats._folded(repeats._keyed(docs))
    assert texts.count() == len({t for _, t in rows}) and copies.count() == 22 and repeats._groups_for(texts) > 2
    distinct = repeats._distinct(repeats._segments(texts, 4))
    hot = {r["anchor"] for r in repeats._hot_anchors(distinct, 20).collect()}
    weight = collections.Counter()
    for r in distinct.collect():
        weight[r["anchor"]] += len(r["piece"]) + 1
    assert hot == {a for a, n in weight.items() if n > 2000} and hot


def test_anchors_known_to_repeat_pass_the_count():
    """Of an anchor in all texts of a batch two places reach its bucket."""
    import pandas as pd

    rows = [(i, t) for i, t in hot_rows()[:400]]
    packed = pd.concat(repeats._anchoring(1)(iter([pd.DataFrame(rows, columns=["row", "text"])])))
    assert set(packed["bucket"]) == {0, 1}
    counted = packed[packed["bucket"] == 0]
    hashes = np.frombuffer(b"".join(counted["hashes"]), np.uint8).reshape(-1, 6)
    assert np.unique(hashes, axis=0, return_counts=True)[1].max() == 2


def test_suffix_order():
    import random

    rng = random.Random(1)
    for _ in range(500):
        n, kinds = rng.randint(1, 60), rng.choice([1, 2, 3, 20])
        s = np.array([rng.randint(1, kinds) for _ in range(n)])
        assert repeats.suffix_order(s, 1, 10**9).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        short = [s[i : i + 5].tolist() for i in repeats.suffix_order(s, 1, 5).tolist()]
        assert short == sorted(short)


def test_m_tree(spark):
    table = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vector_rows() if i is not None and v and None not in v and all(map(math.isfinite, v))}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = set()
    for q in (i for i in table if i % 50 == 0):
        best = sorted((-dot(table[q], v), i) for i, v in table.items() if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    df = vectors(spark)
    for size in (4096, 100):
        mtree.TREE = size
        got = mtree.search(df, df["vec_id"] % 50 == 0).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    mtree.TREE = 4096
