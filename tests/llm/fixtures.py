"""Small tables with every awkward case: nulls anywhere, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, size int, row string, key string, k string, own int, label string, bin int"
PAGES = "page_id long, url string, html string, host string, n int, symbols string, address string, payload string"
VECTORS = "vec_id long, embedding array<float>, label int, v int, tree int, score long"

WORDS = {
    "en": "the house stands near a river and people walk there every morning with bread".split(),
    "de": "das haus steht nahe am fluss und leute gehen dort jeden morgen mit brot über die brücke".split(),
    "ru": "дом стоит у реки и люди ходят туда каждое утро с хлебом".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + (rng.choice(".,!") if rng.random() < 0.1 else "") + str(rng.randrange(30)) * (rng.random() < 0.3) for _ in range(n))


def document_rows() -> list[tuple]:
    rng = random.Random(7)
    rows = []
    for i in range(60):
        lang = rng.choice(list(WORDS))
        rows.append((i, prose(rng, lang, rng.choice((1, 3, 40, 120, 300))), lang, f"s{i % 3}"))
    base = prose(rng, "en", 200).split(" ")
    for i in range(60, 75):  # a chain of near copies: the ends are linked only through those between
        for _ in range(2):
            base[rng.randrange(len(base))] = f"edit{i}{rng.randrange(99)}"
        rows.append((i, " ".join(base), "en", "s0"))
    passage = prose(rng, "de", 30)
    rows += [(i, prose(rng, "de", 20) + "\n" + passage + "\n" + prose(rng, "de", 20), "de", "s1") for i in range(75, 80)]
    rows += [(80 + i, rows[i][1], rows[i][2], "s2") for i in range(5)]  # exact copies
    rows += [
        (90, None, "en", None), (91, "", None, None), (92, " \n\t ", "en", "s0"), (93, "...!?12", "de", "s1"),
        (94, "ab" * 3000, "en", "s2"), (95, prose(rng, "en", 6000), "en", "s2"), (None, "a row without an id", "en", "s0"),
        (97, "漢字とかな", None, "s1"), (98, "\u00a0x  y\n\n z\r\n", "en", "s0"),
    ]
    return rows + [rows[3], rows[3], rows[62]]


def documents(spark: SparkSession) -> DataFrame:
    rows = [(i, t, lang, s, len(t or ""), 1, 2, "r", "k", "k", 3, "x", 4) for i, t, lang, s in document_rows()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def page_rows() -> list[tuple]:
    rng = random.Random(9)
    rows = []
    for i in range(80):
        host = f"{rng.choice(('a', 'www', 'blog'))}.site{rng.randrange(9)}.{rng.choice(('com', 'org', 'net'))}"
        rows.append((i, f"HTTP://{host.upper() if i % 4 else host}/{rng.choice(('en', 'es', 'fr'))}/{i}?q={i}", prose(rng, "en", rng.randrange(1, 9))))
    rows += [(80 + i, rows[i][1], rows[i % 2][2]) for i in range(9)]
    rows += [
        (90, None, None), (91, "no scheme", ""), (92, "http://", "x"), (93, "http://www.example.com/en/", None), (94, "http://EXAMPLE.com/en/a", "ü"),
        (95, "x://com/", "x"), (96, "x://notcom/", "x"), (97, "http://a.net/es/x y\r\nWARC-Type: fake", "x"), (None, "http://q.com/", "only here"), (99, "http://u.com?p", "x"),
    ]
    return rows + [rows[5]]


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, "h", 1, "s", "a", "p") for r in page_rows()], PAGES).repartition(3)


def vector_rows() -> list[tuple]:
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(40)]
    return rows + [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8), (406, [2.0]), rows[0]]


def vectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in vector_rows()], VECTORS).repartition(3)
