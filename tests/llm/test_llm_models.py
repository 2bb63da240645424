import zlib

import numpy as np
import pytest
from llm_fixtures import SMALL, TEN, auc, edge_docs, edge_labels, table

from cohortloom.llm import neighbours, quality, toxicity
from cohortloom.llm.queries import QUERIES

# nearest neighbours


def plain_nearest(rows, every, k):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[i] = np.array(v, float)
    result = {}
    for i, v in kept.items():
        if i % every == 0:
            scores = [
                (-float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), j)
                for j, w in kept.items() if j != i and len(w) == len(v)
            ]
            result[i] = sorted(scores)[:k]
    return result


def test_recall_on_a_table(spark):
    rows = QUERIES["op4_approximate_nearest_neighbours"](spark, TEN).collect()
    wanted = plain_nearest(table(TEN, "embeddings", "vec_id, embedding"), 50, 5)
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(wanted)
    hits = 0
    for i, near in wanted.items():
        assert [r for r, _, _ in sorted(got[i])] == [1, 2, 3, 4, 5]
        hits += len({j for _, j in near} & {j for _, j, _ in got[i]})
        order = sorted(got[i])
        assert order == sorted(order, key=lambda x: (-x[2], x[1]))
    assert hits >= 0.9 * 5 * len(wanted)


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # one vector many times
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, float("nan")]), (204, [None, 1.0]), (205, [float("inf"), 1.0])]
    rows += [(None, rows[1][1]), (20, rows[20][1]), (300, [1e200, 1e200]), (301, [1e-200, 2e-200])]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr(
        "*", "'x' AS id", "'x' AS vector", "'x' AS score"
    )
    for block in (16_384, 3):
        found = neighbours.nearest_neighbours(docs, every=20, k=5, block=block).collect()
        got = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        wanted = plain_nearest([r for r in rows if r[0] not in (300, 301)], 20, 5)
        # 300 and 301 only have each other; their plain norms leave the double range
        assert got.pop(300) == [301]
        assert {i: v for i, v in got.items()} == {i: [j for _, j in v] for i, v in wanted.items()}
    assert neighbours.nearest_neighbours(docs.where("false")).count() == 0


def test_repeated_rows_count_once(spark):
    vector, other = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(i, vector) for i in range(7, 15)] + [(20, vector), (1, other), (2, other)]
    docs = spark.createDataFrame([r for r in rows for _ in range(6)], "vec_id bigint, embedding array<double>")
    found = sorted(tuple(r)[:3] for r in neighbours.nearest_neighbours(docs, every=20, k=5).collect())
    assert found == [(20, n, i) for n, i in enumerate(range(7, 12), 1)]
    found = sorted(tuple(r)[:3] for r in neighbours.nearest_neighbours(docs, every=7, k=5).collect())
    assert found == [(q, n, i) for q, near in ((7, (8, 9, 10, 11, 12)), (14, (7, 8, 9, 10, 11))) for n, i in enumerate(near, 1)]


def test_longest_prefix_ranges():
    forest = neighbours.Forest(np.eye(8))
    strings = neighbours.hash_strings(np.eye(8)[:2])
    first, last = forest.ranges(strings, np.array([0, neighbours.DEPTH]))
    assert (first[:, 0] == 0).all() and (last[:, 0] == 8).all()
    assert (last[:, 1] - first[:, 1] >= 1).all()


# classifiers

SCORERS = {
    "quality": (quality.score_quality, "op10_quality_classifier", 0.9),
    "toxic": (toxicity.score_toxicity, "op9_toxicity", 0.75),
}


@pytest.mark.parametrize("label", SCORERS)
def test_held_out_labels(spark, label):
    _, name, least = SCORERS[label]
    rows = QUERIES[name](spark, TEN).collect()
    labels = dict(table(TEN, "labels", f"doc_id, {label}"))
    assert len(rows) == len(table(TEN, "documents", "doc_id"))
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= (0.3 if label == "quality" else 0.5))
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc(*zip(*held)) >= least


@pytest.mark.parametrize("label", SCORERS)
def test_labels_of_held_out_rows_change_nothing(spark, label):
    score, _, _ = SCORERS[label]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.selectExpr(
        "doc_id", f"IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - {label}, {label}) AS {label}"
    )
    one, two = (
        {r["doc_id"]: r["score"] for r in score(docs, given).collect()} for given in (labels, turned)
    )
    assert one == pytest.approx(two)


@pytest.mark.parametrize("label", SCORERS)
def test_odd_texts_and_missing_labels(spark, label):
    score, _, _ = SCORERS[label]
    docs = edge_docs(spark)
    none = edge_labels(spark, label)
    rows = score(docs, none).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.5}
    one_class = edge_labels(spark, label, [(i, 1, "y", "t") for i in range(20)])
    assert {r["score"] for r in score(docs, one_class).collect()} == {1.0}
    mixed = [(i, i % 2, "y", "t") for i in range(20)] + [(None, 1, "y", "t"), (4, None, "y", "t"), (6, 1, "y", "t")]
    rows = score(docs, edge_labels(spark, label, mixed)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert score(docs.where("false"), none).count() == 0


def test_chunks_cover_whole_texts():
    for size in (0, 1, 511, 512, 513, 960, 961, 5000):
        starts = quality.chunk_starts(size)
        covered = np.zeros(size + quality.CHUNK, bool)
        for s in starts:
            covered[s : s + quality.CHUNK] = True
        assert covered[:size].all()
        data = bytes(range(256)) * 20
        chunks = quality.chunks_of(data[:size], starts)
        for s, c in zip(starts, chunks):
            part = data[:size][s : s + quality.CHUNK]
            assert bytes(c[: len(part)].astype(np.uint8)) == part and (c[len(part) :] == quality.PAD).all()


def test_slopes_agree_with_differences():
    network = quality.Network(3)
    rng = np.random.default_rng(2)
    chunks = rng.integers(0, 257, (6, quality.CHUNK)).astype(np.int16)
    labels, weight = np.array([0, 1, 0, 1, 1, 0], np.float32), np.ones(6, np.float32)
    for k in network.weights:
        network.weights[k] = network.weights[k].astype(float)

    def loss():
        z = network.logits(chunks)
        return np.mean(np.log1p(np.exp(z)) - labels * z)

    slopes = network._slopes(chunks, labels, weight)
    for name in ("filters", "out", "bias", "embed", "shift"):
        values = network.weights[name]
        at = tuple(rng.integers(0, s) for s in values.shape)
        before, h = values[at], 1e-5
        values[at] = before + h
        high = loss()
        values[at] = before - h
        low = loss()
        values[at] = before
        assert slopes[name][at] == pytest.approx((high - low) / (2 * h), abs=2e-4)


def test_very_long_texts_are_scored_part_by_part():
    network = quality.Network(1)
    text = bytes(np.random.default_rng(0).integers(97, 123, 1_200_000).astype(np.uint8))
    starts = quality.chunk_starts(len(text))
    logits = network.logits(quality.chunks_of(text, starts))
    found = network.features([b"short", text, b""])
    assert found[1] == pytest.approx([logits.mean(), logits.min()])
    assert found.shape == (3, 2)


class PlainModel:
    """Both classes' Kneser-Ney models and scores, word by word, from (text, label) pairs; label None: not learned from."""

    def __init__(self, rows):
        self.counts = {}
        for text, label in rows:
            for word in set(toxicity.words(text)):
                for gram in toxicity.grams_of(word):
                    have = self.counts.setdefault(gram, [0, 0, 0])
                    have[0] += 1
                    have[1] += label == 1
                    have[2] += label == 0
        self.lower, longer = {}, set(self.counts)
        for order in toxicity.SHARED:
            before = {}
            for gram in longer:
                before.setdefault(gram[-order:], set()).add(gram[-order - 1])
            self.lower[order] = {k: len(v) for k, v in before.items()}
            longer = set(before)

    def odds(self, gram):
        p = 1 / 65536
        for order in reversed(toxicity.SHARED):
            ending, table = gram[-order:], self.lower[order]
            like = [n for k, n in table.items() if k[:-1] == ending[:-1]]
            off = sum(min(n, toxicity.DISCOUNT) for n in like)
            p = max((max(table[ending] - toxicity.DISCOUNT, 0) + off * p) / sum(like), 1e-12)
        return p

    def ratio(self, gram):
        like = [c for k, c in self.counts.items() if k[:-1] == gram[:-1]]

        def mixed(side, discount, lower):
            total = sum(c[side] for c in like)
            if not total:
                return lower
            off = sum(min(c[side], discount) for c in like)
            return (max(self.counts[gram][side] - discount, 0) + off * lower) / total

        shared = max(mixed(0, toxicity.DISCOUNT, self.odds(gram)), 1e-12)
        return np.log(mixed(1, toxicity.CLASS_DISCOUNT, shared)) - np.log(mixed(2, toxicity.CLASS_DISCOUNT, shared))

    def features(self, text):
        ratios = sorted(sum(map(self.ratio, toxicity.grams_of(w))) for w in set(toxicity.words(text)))
        if not ratios:
            return [0.0] * 4
        some = sum(np.log(1 + toxicity.SOME * (np.exp(min(r, 12)) - 1)) for r in ratios)
        return [np.mean(ratios), some, some / len(ratios) ** 0.5, sum(ratios[-3:]) / 3]


def toxic_rows():
    texts = ["good fine nice words été 漢字 nice", "nasty vile words niece", "nasty fine zebra", "", None, "unseen zzz words"]
    rows = []
    for i in range(60):
        text = texts[i % 6]
        rows.append((i, text, None if text is None else int("nasty" in text)))
    return rows


def test_document_features_are_those_of_the_plain_model(spark, monkeypatch):
    """Word for word, from several chunks, with labels broadcast and joined."""
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5 != 1], "doc_id bigint, toxic int")
    learned = {i: y for i, _, y in rows if i % 5 != 1 and zlib.crc32(str(i).encode()) % 5 in (2, 3, 4)}
    model = PlainModel([(t, learned.get(i)) for i, t, _ in rows])
    wanted = {t: model.features(t) for t in {t for _, t, _ in rows}}
    for most in (500_000, 0):
        monkeypatch.setattr(toxicity, "LABELLED_ROWS", most)
        found = toxicity.document_features(docs, labels, "toxic").collect()
        assert len(found) == len(rows)
        for r in found:
            assert [r[c] for c in toxicity.FEATURES[1:]] == pytest.approx(wanted[rows[r["doc_id"]][1]], rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("letters", ["abc", "aé漢😀", "".join(map(chr, range(0x4E00, 0x9000)))])
def test_grams_as_numbers(letters):
    """Small alphabets, all planes, and more letters than six of them fit one number."""
    rng = np.random.default_rng(6)
    words = list(dict.fromkeys("".join(rng.choice(list(letters), rng.integers(1, 12))) for _ in range(3000)))
    found = toxicity.Grams(words)
    assert found.spelt(found.keys) == [g for w in words for g in toxicity.grams_of(w)]
    assert found.spelt(np.unique(found.keys)) == sorted({g for w in words for g in toxicity.grams_of(w)})
    assert toxicity.Grams([]).spelt(np.array([], np.int64)) == []


def test_ratios_follow_the_classes():
    model = PlainModel([("good fine nice words", 0)] * 40 + [("nasty vile words", 1)] * 40 + [("zzz", None)])
    good, bad, both, new = (sum(map(model.ratio, toxicity.grams_of(w))) for w in ("nice", "vile", "words", "zzz"))
    assert bad > 1 and good < -1 and abs(both) < 1 and abs(new) < 1


def test_unlike_ngrams_are_never_merged(spark):
    letters = [chr(0x4E00 + i) for i in range(6000)]
    docs = [(i, " ".join(letters[i : i + 1000])) for i in range(0, 6000, 1000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    counts = toxicity.gram_counts(toxicity.chunks_of(frame, edge_labels(spark, "toxic"), "toxic"))
    # every letter and the end of each word after it, each under itself
    assert counts.count() == 12_000 and counts.agg({"every": "max"}).first()[0] == 1
    assert toxicity.shared_odds(counts).count() > 6000


def plain_logit(network, data):
    """One chunk through the network, value by value."""
    w = network.weights
    letters = [*data] + [quality.PAD] * (quality.CHUNK - len(data))
    vectors = [w["embed"][b] for b in letters]
    z = float(w["shift"][0])
    for f in range(quality.FILTERS):
        best = max(
            sum(
                float(vectors[start + i][e]) * float(w["filters"][i * quality.EMBED + e, f])
                for i in range(quality.WIDTH) for e in range(quality.EMBED)
            )
            for start in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
        )
        z += max(best + float(w["bias"][f]), 0) * float(w["out"][f])
    return z


def test_network_scores_a_document_like_plain_loops():
    """One text's features and its score, filter by filter and byte by byte."""
    network = quality.Network(7)
    text = bytes(np.random.default_rng(1).integers(32, 127, 700).astype(np.uint8))
    starts = quality.chunk_starts(len(text))
    logits = [plain_logit(network, text[s : s + quality.CHUNK]) for s in starts]
    assert network.features([text])[0] == pytest.approx([np.mean(logits), min(logits)], rel=1e-3, abs=1e-3)
