"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens between which no vocabulary entry reaches, so they can be merged
apart from each other. The distinct pre-tokens of a batch lie side by side in ragged numpy arrays;
each step applies the best pair (best score, then leftmost) of every pre-token at once, until none
has a pair left. The surviving symbols are the tokens; a symbol outside the vocabulary counts its
UTF-8 bytes. Very long pre-tokens (over ``LONG`` symbols) go through a heap with the same order.

Nulls count as the empty text, which has no tokens. Other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import Recent, query, read, text_of, text_pieces

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
LONG = 400
SPACE = "▁"
BATCH_BYTES = 4_000_000
NO_PAIR = -(2**62)


class Merges:
    """Pairs of symbols that make a vocabulary entry, in an open-addressed numpy table."""

    def __init__(self, scores: dict[str, float]):
        chars = sorted({c for piece in scores for c in piece})
        self.symbols = {c: i for i, c in enumerate(chars)}
        for piece in scores:
            self.symbols.setdefault(piece, len(self.symbols))
        self.known = set(scores)
        self.char_bytes = {c: 1 if c in scores else len(c.encode()) for c in chars}
        #: byte count of symbols that are no entry by themselves
        self.width = np.ones(len(self.symbols) + 1, np.int64)
        for c in chars:
            self.width[self.symbols[c]] = self.char_bytes[c]
        ranks = {s: -i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        self.bigrams = set()
        for piece, score in scores.items():
            self.bigrams.update(zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (ranks[score], self.symbols[piece])
        self.pairs = pairs
        self.inner_space = any(b == SPACE and a != SPACE for a, b in self.bigrams)
        self.bits = max(8, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size + 64, -1, np.int64)
        self.rank = np.full(size + 64, NO_PAIR, np.int64)
        self.made = np.zeros(size + 64, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        slots = self.slot(keys)
        self.probes = 1
        for key, slot in zip(keys.tolist(), slots.tolist()):
            step = 0
            while self.keys[slot + step] != -1:
                step += 1
                if step == 64:
                    raise ValueError("the table of pairs is too dense")
            self.probes = max(self.probes, step + 1)
            self.keys[slot + step] = key
            self.rank[slot + step], self.made[slot + step] = pairs[key]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; ``NO_PAIR`` where there is none."""
        keys = left << 32 | right
        slot = self.slot(keys)
        found = np.full(len(keys), -1, np.int64)
        for step in range(self.probes):
            found[self.keys[slot + step] == keys] = step
        at = slot + np.maximum(found, 0)
        return np.where(found >= 0, self.rank[at], NO_PAIR), self.made[at]

    def count_long(self, ids: list[int]) -> int:
        """The same merges for one long pre-token, by a heap."""
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j >= 0:
                pair = self.pairs.get(ids[i] << 32 | ids[j])
                if pair:
                    heapq.heappush(heap, (-pair[0], i, ids[i], ids[j], pair[1]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return int(sum(self.width[s] for s in ids if s >= 0))

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        total = np.zeros(len(words), np.int64)
        owner, pieces = [], []
        for k, word in enumerate(words):
            run: list[int] = []
            last = None
            for c in word.replace(" ", SPACE):
                symbol = self.symbols.get(c)
                if symbol is None:
                    total[k] += len(c.encode())
                    if run:
                        owner.append(k)
                        pieces.append(run)
                        run = []
                    last = None
                    continue
                if last is not None and (last, c) not in self.bigrams:
                    owner.append(k)
                    pieces.append(run)
                    run = []
                run.append(symbol)
                last = c
            if run:
                owner.append(k)
                pieces.append(run)
        short = [i for i, run in enumerate(pieces) if len(run) <= LONG]
        for i, run in enumerate(pieces):
            if len(run) > LONG:
                total[owner[i]] += self.count_long(run)
        if short:
            found = self._merge([pieces[i] for i in short])
            np.add.at(total, np.array([owner[i] for i in short]), found)
        return total

    def _merge(self, sequences: list[list[int]]) -> np.ndarray:
        lengths = np.array([len(s) for s in sequences])
        ids = np.fromiter((x for s in sequences for x in s), np.int64, int(lengths.sum()))
        seq = np.repeat(np.arange(len(sequences)), lengths)
        ends = np.cumsum(lengths) - 1
        rank = np.full(len(ids), NO_PAIR, np.int64)
        made = np.zeros(len(ids), np.int64)
        inner = np.ones(len(ids), bool)
        inner[ends] = False
        at = np.flatnonzero(inner)
        rank[at], made[at] = self.look(ids[at], ids[at + 1])
        result = np.zeros(len(sequences), np.int64)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.maximum.reduceat(rank, starts)
            open_ = best > NO_PAIR
            sizes = np.diff(np.r_[starts, len(ids)])
            if not open_.all():
                still = np.repeat(open_, sizes)
                np.add.at(result, seq[~still], self.width[ids[~still]])
                ids, seq, rank, made = ids[still], seq[still], rank[still], made[still]
                continue
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            hit = hit[np.r_[True, seq[hit][1:] != seq[hit][:-1]]]  # the leftmost of each sequence
            ids[hit] = made[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            rank[hit] = rank[hit + 1]  # the pair that now follows is looked up below
            moved = hit - np.arange(len(hit))
            ids, seq, rank, made = ids[keep], seq[keep], rank[keep], made[keep]
            ends_now = np.r_[seq[1:] != seq[:-1], True]
            fresh = np.unique(np.r_[moved, np.maximum(moved - 1, 0)])
            rank[fresh[ends_now[fresh]]] = NO_PAIR
            fresh = fresh[~ends_now[fresh]]
            rank[fresh], made[fresh] = self.look(ids[fresh], ids[fresh + 1])
        return result


def load_merges(path: str) -> Merges:
    """Ordinary entries and scores of a sentencepiece model whose text form is plain."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    plain = (
        spec.name == "identity" and spec.add_dummy_prefix and spec.escape_whitespaces
        and not spec.remove_extra_whitespaces and model.trainer_spec.byte_fallback
        and not any(p.type == 4 for p in model.pieces)
    )
    if not plain:
        raise ValueError("only byte-fallback BPE models over unchanged text are supported")
    return Merges({p.piece: p.score for p in model.pieces if p.type == 1})


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with the text after them; the first run has one space more."""
    text = text.replace(SPACE, " ")
    if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ")
    parts: list[str] = []
    spaces = ""
    for part in text.split(" "):
        if part:
            parts.append(spaces + part)
            spaces = ""
        else:
            spaces += " "
    if spaces:
        parts.append(spaces[1:])  # every run stands for one space more
    return parts


def _counter(path: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load_merges(path)
        if merges.inner_space:
            raise ValueError("a vocabulary entry goes on after a space")
        known = Recent(lambda word: int(merges.counts([" " + word])[0]), 500_000)
        for batch in text_pieces(batches, "text", BATCH_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            split = [pre_tokens(t) if t else [] for t in texts]
            new = list({w for words in split for w in words if w not in known and w not in known.old})
            for start in range(0, len(new), 50_000):
                part = new[start : start + 50_000]
                counts = merges.counts([" " + word for word in part]).tolist()
                for word, n in zip(part, counts):
                    known.keep(word, n)
            tokens = [sum(map(known.__getitem__, words)) for words in split]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; no shuffle.

    ``path`` is the model file on every worker. Repeated rows and ids give a row each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        _counter(path, limit),
        f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
