import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_fixtures import LONG_TEXT, SMALL, TEXTS, edge_docs, table

from cohortloom.llm import personal_data, ranked_search, vector_codes
from cohortloom.llm.queries import QUERIES

# vector codes


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    cells = [[math.floor(256 * x) for x in v] for v in vectors]
    size = len(cells[0]) // parts

    def near(cell, book):
        return min((sum((a - b) ** 2 for a, b in zip(cell, e)), i) for i, e in enumerate(book))

    cut = [[c[p * size : p * size + size] for p in range(parts)] for c in cells]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [
                [sum(x) // len(members[i]) for x in zip(*members[i])] if i in members else e for i, e in enumerate(books[p])
            ]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    codes = ["".join(f"{i:02x}" for _, i in row) for row in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return codes, [sum(d for d, _ in row) for row in found], digest


def test_codes_of_vectors_with_ties_and_repeats(spark):
    rng = random.Random(4)
    vectors = [[rng.choice((-0.5, -0.01, 0.0, 0.004, 0.25, 1.0)) for _ in range(32)] for _ in range(150)]
    vectors[70] = vectors[3]
    rows = [(i, [float(x) for x in v], i % 3 if i % 7 else None) for i, v in enumerate(vectors)]
    bad = [(500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] * 32, 1), (1, vectors[1], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int")
    for name in ("id", "cells", "code", "of", "salt", "to"):
        df = df.withColumn(name, df["vec_id"])
    coded, books = vector_codes.compress(df.drop("id").repartition(5))
    got = {}
    for r in vector_codes.with_label_error(coded).collect():
        got.setdefault(r["id"], []).append((r["code"], r["error"], r["label"], r["label_error"]))
    order = [0, 1, 1, *range(2, 150)]
    codes, errors, digest = plain_codes([vectors[i] for i in order])
    assert vector_codes.codebooks_digest(books) == digest
    labels = [None if i % 7 == 0 else i % 3 for i in order]
    labels[2] = 0
    total = Counter()
    for y, e in zip(labels, errors):
        total[y] += e
    want = {}
    for i, c, e, y in zip(order, codes, errors, labels):
        want.setdefault(i, []).append((c, e, y, total[y]))
    assert {i: sorted(map(str, x)) for i, x in got.items()} == {i: sorted(map(str, x)) for i, x in want.items()}


def test_codes_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label string"
    assert vector_codes.compress(spark.createDataFrame([], schema))[0].count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, "a")], schema))[0].count() == 0
    coded, _ = vector_codes.compress(spark.createDataFrame([(1, [], "a"), (None, [], None)], schema))
    assert {r["code"] for r in coded.collect()} == {"00" * 16}
    # shorter vectors are filled with zeros, very large components are held
    coded, books = vector_codes.compress(spark.createDataFrame([(1, [1.0], "a"), (2, [1.0] * 17, "a"), (None, [3e38] * 20, None)], schema))
    assert books.shape == (16, 3, 2) and books.max() == vector_codes.LARGEST
    rows = vector_codes.with_label_error(coded).collect()
    assert sorted(r["error"] for r in rows) == [0, 0, 0] and len({r["code"] for r in rows}) == 3


@pytest.mark.parametrize("scale", [1, 5, 300])
def test_balls_compute_few_distances_and_miss_none(scale):
    rng = np.random.default_rng(scale)
    points = rng.integers(-scale, scale + 1, (3000, 4))
    balls = vector_codes.Balls(points[:64])
    every = ((points[:, None] - points[None, :64]) ** 2).sum(2)
    code, best, _ = balls.assign(points, balls.guess(points))
    assert (code == every.argmin(1)).all() and (best == every.min(1)).all()
    again, _, computed = balls.assign(points, code)
    assert (again == code).all() and computed < 32 * len(points)
    worst = balls.assign(points, np.zeros(len(points), int))[0]
    assert (worst == code).all()


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_ranks(docs, items, k):
    words = [(i, TERM.findall(t.translate(LOWER))) for i, t in docs if t is not None]
    words = [(i, w, Counter(w)) for i, w in words if w]
    n, total = len(words), sum(len(w) for _, w, _ in words)
    found = []
    for item, text in sorted(set(items), key=str):
        terms = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        df = {t: sum(t in c for _, _, c in words) for t in terms}
        for i, w, c in words:
            m = 50 + (50 * len(w) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        found += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=str)


def ranked(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_ranks_of_odd_texts(spark):
    docs = edge_docs(spark)
    items = [(1, "the quick LAZY dog, fine words"), (1, "lorem fox"), (2, None), (3, "漢字 c É"), (None, "a b two"), (4, "no such"), (4, "no such")]
    frame = spark.createDataFrame(items, "item_id bigint, text string").withColumn("key", F.lit("x"))
    want = plain_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], items, 5)
    assert ranked(ranked_search.rank_documents(docs, frame, 5)) == want
    # the same from blocks of one query, and from many small partitions
    assert ranked(ranked_search.rank_documents(docs.repartition(9), frame, 5, block_queries=1)) == want
    assert ranked_search.rank_documents(docs.where("false"), frame).count() == 0
    assert ranked_search.rank_documents(docs, frame.where("false")).count() == 0


def test_ranks_when_coordinates_collide(spark, monkeypatch):
    """With few coordinates every bound is far too high, and the rows are the same."""
    monkeypatch.setattr(ranked_search, "WIDTH", 7)
    docs, items = table(SMALL, "documents", "doc_id, text"), table(SMALL, "benchmark", "item_id, text")
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    table_rows = ranked_search.sketches(frames[0]).collect()
    words = {r["doc_id"]: ranked_search.unpacked(r["packed"]) for r in table_rows}
    queries = ranked_search.Queries([{t: 5 for t in list(words[docs[0][0]])[:20]}], len(words), 5000)
    bounds = queries.bounds(*([r[c] for r in table_rows] for c in ("n", "coords", "tops")))
    scores = [queries.score(0, words[r["doc_id"]], r["n"]) for r in table_rows]
    assert (bounds[:, 0] >= scores).all()


def test_thresholds_leave_few_documents_to_score(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    stored = ranked_search.sketches(docs)
    block = next(ranked_search.query_blocks(items, "item_id", "text", 10**6, 10**6))
    queries = ranked_search.weigh(spark, stored, block, stored.where("n > 0").count(), stored.agg({"n": "sum"}).first()[0])
    least = ranked_search.thresholds(spark, stored, queries, 5)
    rows = stored.collect()
    bounds = queries.bounds(*([r[c] for r in rows] for c in ("n", "coords", "tops")))
    assert all(least)
    assert (bounds >= np.array(least)).sum() < 0.2 * (bounds > 0).sum()


# personal data

PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([ -]?[0-9])+"),
    re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
)


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            double = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == 2 and 16 <= len(digits) <= 19 and sum(double) % 10 == 0)
                or (kind == 3 and 8 <= len(digits) <= 15)
            ):
                found.append((kind, *m.span()))
    return found


def odd_personal_texts():
    rng = random.Random(8)
    texts = ["".join(rng.choice("a1@.+- (5)0\n4é%") for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["a@b@c.com@d.org x@y..z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004", "4111 1111-1111 1111", "+1 (377) 555-0271-", "é@a.b"]
    return texts + TEXTS


def test_base_spans_are_those_of_the_patterns():
    for text in odd_personal_texts():
        assert personal_data.base_spans(text) == plain_spans(text), text
    assert personal_data.base_spans("x" * 200_000 + "1" * 200_000 + "@") == []
    assert personal_data.base_spans("9" * 5000 + ".1.1.1") == []


def test_query_keeps_base_spans(spark):
    texts = dict(table(SMALL, "documents", "doc_id, text"))
    rows = QUERIES["op13_pii"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(k == i for k, _, _ in base) for i in range(4)]
        listed = personal_data.joined(base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert set(listed.split(",")) - {""} <= set(spans) and len(spans) == len(base) + r["n_added"]


def labelled(seed, count=300):
    """Short texts with numbers that the patterns do not cover."""
    rng = random.Random(seed)
    words = "call write to the my for and on at of with thing other from here".split()

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    rows = []
    for i in range(count):
        before = some(rng.randrange(1, 8)) + " "
        kind, inner = rng.choice([
            (3, f"({digits(3)}) {digits(3)}-{digits(4)}"), (3, f"00{digits(2)} {digits(3)}\n{digits(4)}"),
            (0, f"{rng.choice(words)}{digits(2)} [at] {rng.choice(words)} [dot] com"),
            (1, ". ".join(str(rng.randrange(256)) for _ in range(4))), (None, digits(4)), (None, f"{digits(2)} of {digits(3)}"),
        ])
        text = before + inner + " " + some(rng.randrange(1, 8))
        rows.append((text, [] if kind is None else [(kind, len(before), len(before) + len(inner))]))
    return rows


def test_field_finds_held_out_spans():
    field = personal_data.fit(labelled(1))
    rows = labelled(2)
    found = personal_data.field_spans(field, [t for t, _ in rows])
    right = sum(set(f) == set(s) for f, (_, s) in zip(found, rows))
    assert right >= 0.95 * len(rows)
    assert personal_data.fit([("no spans 12", [])]) is None and personal_data.field_spans(None, ["a 1"]) == [[]]


def test_viterbi_and_gradient_against_enumeration():
    """Best labelling of short runs among all of them; runs of unlike lengths together."""
    rng = np.random.default_rng(3)
    count = len(personal_data.LABELS)
    field = personal_data.Field(rng.normal(size=(personal_data.TABLE_ROWS, count)), rng.normal(size=(count, count)))
    runs = [rng.integers(0, personal_data.TABLE_ROWS, (n, len(personal_data.VIEWS))) for n in (1, 3, 2, 4)]
    for rows, got in zip(runs, field.decode(runs)):
        emit = field.table[rows].sum(1)
        grid = np.indices((count,) * len(rows)).reshape(len(rows), -1).T
        total = sum(emit[t, grid[:, t]] for t in range(len(rows))) + field.steps[0, grid[:, 0]]
        total = total + sum(field.steps[grid[:, t], grid[:, t + 1]] for t in range(len(rows) - 1))
        assert (grid[total.argmax()] == got).all()


def test_personal_data_of_odd_texts(spark):
    docs = edge_docs(spark)
    rows = personal_data.find_personal_data(docs, labelled(1, 60)).collect()
    assert len(rows) == docs.count()
    by_text = [plain_spans(t) for t in [r["text"] for r in docs.select("text").collect()]]
    assert [[(personal_data.KINDS.index(x["kind"]), x["start"], x["end"]) for x in r["found"] if x["base"]] for r in rows] == by_text
    assert personal_data.find_personal_data(docs.where("false")).count() == 0


def test_additions_touch_no_base_span(spark):
    text = "call +1 (377) 555-0271 or (377) 555-0999 here " + LONG_TEXT
    row = personal_data.find_personal_data(spark.createDataFrame([(1, text)], "doc_id int, text string"), labelled(1)).first()
    assert [(x["kind"], x["base"], text[x["start"] : x["end"]]) for x in row["found"]] == [
        ("phone", True, "+1 (377) 555-0271"), ("phone", False, "(377) 555-0999"),
    ]
