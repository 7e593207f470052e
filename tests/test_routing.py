"""File routing against a product of all pairs, and what its plan sends to the driver."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.sources import routing

KINDS = "source_id string, position long, category string, document string, subject string, why_needed string, format string"
WORDS = ["amber", "bolt", "cedar", "delta", "ember", "flint", "grove", "harbor", "statement", "invoices"]


def tables(spark, files, sources, seed=3):
    """Names with shared words, names that differ by a sign, and names with nothing in common."""
    draw = random.Random(seed)

    def name(near):
        words = [draw.choice(WORDS) for _ in range(draw.choice([1, 2, 3]))]
        return [w[:-1] + "x" if near and draw.random() < 0.5 else w for w in words]

    paths = ["/".join(["in", draw.choice(["amber", "box", ""]), "".join(w.title() for w in name(True)) + f"_{i}" + draw.choice([".csv", ".PDF", ".png", ""])]) for i in range(files)]
    rows = [
        (f"s{i:04d}", i % 97, draw.choice(["A. Bolt", "B. Other"]), " ".join(name(False)) or None, draw.choice(["", "cedar", None]), "why", draw.choice(["CSV export", "PDF", None]))
        for i in range(sources)
    ]
    return spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(rows, KINDS)


def by_product(files, sources):
    parts = routing.file_parts("path")
    f = files.select("path", parts["extension"].alias("e"), S.tokens(F.concat_ws(" ", *parts.values())).alias("fw"), S.bigrams(routing.normal_text(parts["stem"])).alias("fg"))
    s = sources.select(
        "source_id", "position", S.tokens(F.concat_ws(" ", "document", "category", "subject", "why_needed")).alias("sw"),
        S.bigrams(routing.normal_text(F.col("document"))).alias("sg"), routing.expected_extensions(F.col("format")).alias("x"),
    )
    pairs = [(a, b) for a in f.collect() for b in s.collect()]
    found = {}
    for a, b in pairs:
        both = len(a["fg"]) + len(b["sg"])
        likeness = len(set(a["fg"]) & set(b["sg"])) * 2 / both if both else 0.0
        score = len(set(a["fw"]) & set(b["sw"])) / max(len(b["sw"]), 1) * 0.65 + likeness * 0.35 + (0.15 if a["e"] in b["x"] else 0.0)
        if score >= 0.35:
            found[a["path"], b["source_id"]] = (score, b["position"])
    return found


def test_scores_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(routing, "BLOCK_SOURCES", 5)
    monkeypatch.setattr(routing, "CELL_FILES", 7)
    files, sources = tables(spark, 60, 120)
    want = by_product(files, sources)
    rows = routing.score_files(files, sources).collect()
    assert len(rows) == len(want) and {(r["path"], r["source_id"]): (r["score"], r["position"]) for r in rows} == want

    best = {}
    for (path, _), (score, position) in want.items():
        best[path] = min(best.get(path, (0.0, 0)), (-score, position))
    routed = {r["path"]: r for r in routing.route_files(files, sources).collect()}
    assert len(routed) == 60
    for path, r in routed.items():
        if path in best:
            assert (-r["score"], want[path, r["source_id"]][1]) == best[path]
        else:
            assert r["source_id"] is None and r["score"] is None


def test_no_file_or_source_is_sent_to_the_driver(spark, tmp_path):
    files, sources = tables(spark, 300, 200)
    files.write.parquet(str(tmp_path / "f"))
    sources.write.parquet(str(tmp_path / "s"))
    routed = routing.route_files(spark.read.parquet(str(tmp_path / "f")), spark.read.parquet(str(tmp_path / "s")))
    plan = routed._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert sent
    for columns in sent:
        assert not re.search(r"path#|source_id#|source#|block#|_words#|_fw#", columns), columns


def test_files_alike_are_scored_once(spark, monkeypatch):
    """Files that differ by numbers and dates only meet the sources as one, and each keeps its own row."""
    paths = [f"in/{folder}/AmberBolt{i}_{name}{end}" for i in range(100, 300) for folder, name, end in (("box", "Cedar", ".csv"), ("amber", "zzq", ".PDF"))]
    files = spark.createDataFrame([(p,) for p in [*paths, paths[0], "noname"]], "path string")
    sources = tables(spark, 1, 40)[1]
    shapes, pairs = [], routing._pairs
    monkeypatch.setattr(routing, "_pairs", lambda found, tracked: shapes.append(found) or pairs(found, tracked))
    top = routing.top_matches(files, sources).collect()
    assert shapes[0].count() < 20

    want = {}
    for (path, source), (score, _) in by_product(files.distinct(), sources).items():
        want.setdefault(source, []).extend([(-score, path)] * (2 if path == paths[0] else 1))
    assert {(r["source_id"], r["place"]): (-r["score"], r["path"]) for r in top} == {(s, i + 1): hit for s, hits in want.items() for i, hit in enumerate(sorted(hits)[:3])}
    assert len(top) == sum(min(len(hits), 3) for hits in want.values()) > 3
    assert routing.route_files(files, sources).count() == 402
