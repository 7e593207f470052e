"""The pipeline's stages against brute force, each on what the stage before kept."""

from __future__ import annotations

import collections

import corpus_pipeline
from fixtures import document_rows, documents
import __spark_entry__ as entry
import pytest
from oracle import compare, connect
from test_operators import brute_components, brute_repeats

from tallyframe.llm.common import settle


def test_stages(spark, tmp_path):
    docs, kept = documents(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
    rows = document_rows()
    first = collections.Counter(r["doc_id"] for r in kept["identify_language"])
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert first == collections.Counter(r[0] for r in lettered)
    _, label = brute_components(lettered)
    second = [(r["doc_id"], r["text"]) for r in kept["drop_near_duplicates"]]
    assert collections.Counter(i for i, _ in second) == collections.Counter(r[0] for r in lettered if label.get(r[0]) == r[0])
    removed = collections.Counter()
    for (i, size, gone, _, _), n in brute_repeats(second).items():
        removed[(i, size - gone)] += n
    third = collections.Counter((r["doc_id"], len(r["text"].encode())) for r in kept["cut_repeats"])
    assert third == removed
    copies = collections.Counter(r["doc_id"] for r in kept["mix_sources"])
    assert max(copies.values()) <= 2 * max(collections.Counter(i for i, _ in second).values())
    pieces = collections.Counter(r["doc_id"] for r in kept["pack_sequences"] if r["start"] + r["length"] > 0 and r["piece"] == 0)
    assert pieces == copies


@pytest.mark.parametrize("name", ["op1_warc", "op4_nearest", "op7_near_duplicates", "op8_mix"])
def test_queries_equal_their_sql(spark, small_dir, name):
    assert compare(entry.queries()[name](spark, small_dir), connect(small_dir), entry.oracle_sql()[name]) is None


def test_run(spark, small_dir):
    got = corpus_pipeline.run(spark, small_dir)
    assert set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and got.count() > 0
