"""Personal data by patterns and a linear-chain conditional random field over word shapes.

Base spans are the leftmost matches of four patterns (email, ip, card, phone) that pass their checks. A
conditional random field adds spans that are written otherwise: numbers broken by line ends or grouped
by other signs, phones without a plus sign, mail addresses with a spelled-out or spaced at sign.

Texts become tokens: runs of letters, runs of digits, single other signs, each with the kind of gap before
it. Every span of these kinds has a digit or an at sign, so the field decodes every token within ``REACH`` tokens of
one, in runs; all others are outside. A token's label scores are sums of table rows, one per shape in the
token's neighbourhood, and labels (outside, and first and further token of each kind) follow each
other by learned transitions. Viterbi runs over many runs of like lengths at once. A found span counts
if it passes its kind's check and touches no base span.

The field is trained from a small labelled table: texts with spans. By default this is drawn from the
documents: surroundings of base spans of at most ``LABELLED`` documents (smallest digests first), as they
are and rewritten in other ways, and of digits that are no base span. Training is maximum likelihood with
a quadratic penalty, on the driver, on at most ``RUNS`` runs of at most ``LONGEST`` tokens.

Defined results. Null and empty texts have no spans. Every row gives one row, null and repeated ids
too. Offsets are code points. Other columns never matter. Without labelled spans only base spans are found.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import query, read, text_of, text_pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *(f"{place} {kind}" for kind in KINDS for place in ("first", "further")))
REACH = 6
LABELLED = 3_000
RUNS = 3_000
LONGEST = 64
AROUND = 60
STEPS = 60
PENALTY = 1e-3
BATCH_BYTES = 2_000_000
#: Tokens of one decoded block, padding included.
BLOCK = 400_000

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def small_parts(parts: list[str]) -> bool:
    """Numbers of at most 255, however long their leading zeros."""
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        else:
            # a later match may not reach back over this sign, as it is no letter of a name
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None, summed: bool = True) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; ``summed``: only cards whose check digit is right."""
    if not text:
        return []
    found = [(0, s, e) for s, e in _emails(text)]
    if DIGITS.search(text):
        found += [(1, *m.span()) for m in IP.finditer(text) if small_parts(m[0].split("."))]
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start():
                digits = _digits(m[0])
                if 16 <= len(digits) <= 19 and (not summed or luhn(digits)):
                    found.append((2, *m.span()))
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def passes(kind: int, text: str) -> bool:
    """Whether a span that the field has found can be of its kind."""
    digits = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+\s*(?:@|[(\[]\s*at\s*[)\]])\s*[\w-]+(?:\s*(?:\.|[(\[]\s*dot\s*[)\]])\s*[\w-]+)+", text, re.I))
    if kind == 1:
        parts = DIGITS.findall(text)
        return len(parts) == 4 and small_parts(parts) and not re.search(r"[^0-9.\s]", text)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9\s./_-]", text)
    return 8 <= len(digits) <= 15 and not re.search(r"[^0-9\s()./+-]", text)


# --- tokens and shapes -------------------------------------------------------------------------------

#: Class of a character: 0 lower case and other letters, 1 upper case, 2 digit, 3 blank, 4 line end, 5 other sign.
CLASSES = np.full(128, 5, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[[9, 32]], CLASSES[[10, 11, 12, 13]] = 0, 1, 2, 3, 4
#: Shapes: edge of a run, letters by case and length, digits by length, each ASCII sign, other signs.
LETTERS_AT, DIGITS_AT, SIGNS_AT = 1, 1 + 3 * 6, 1 + 3 * 6 + 12
WORDS_AT = SIGNS_AT + 129
#: Words that tell kinds apart have shapes of their own.
CUES = ("at", "dot", "com", "mail", "phone", "tel", "call", "card")
SHAPES = WORDS_AT + len(CUES)
LETTER_STEPS = np.array([2, 3, 4, 6, 10])
DIGIT_STEPS = np.array([2, 3, 4, 5, 6, 8, 10, 12, 15, 17, 20])
GAPS = 3


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, shape and gap (none, blank, line end) of every token."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(codes < 128, CLASSES[np.minimum(codes, 127)], 0)
    kinds[(codes == 0xA0) | (codes == 0x3000) | ((codes >= 0x2000) & (codes <= 0x200B))] = 3
    group = np.array([0, 0, 1, 2, 2, 3], np.uint8)[kinds]
    new = np.ones(len(codes), bool)
    new[1:] = (group[1:] != group[:-1]) | (group[1:] == 3)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(codes))
    blank = group[start] == 2
    breaks = np.append(0, np.cumsum(kinds == 4))
    gap = np.zeros(len(start), np.int64)
    gap[1:] = np.where(blank[:-1], 1 + (breaks[end[:-1]] > breaks[start[:-1]]), 0)
    if len(gap):
        gap[0] = 2
    kept = ~blank
    start, end, gap = start[kept], end[kept], gap[kept]
    uppers = np.append(0, np.cumsum(kinds == 1))
    size, caps = end - start, uppers[end] - uppers[start]
    case = np.where(caps == 0, 0, np.where((caps == 1) & (kinds[start] == 1), 1, 2))
    first = group[start]
    shape = np.where(
        first == 0, LETTERS_AT + 6 * case + np.searchsorted(LETTER_STEPS, size, "right"),
        np.where(first == 1, DIGITS_AT + np.searchsorted(DIGIT_STEPS, size, "right"), SIGNS_AT + np.minimum(codes[start], 128)),
    ).astype(np.int64)
    short = np.flatnonzero((first == 0) & (size <= 5))
    if len(short):
        lower = text.lower() if len(text.lower()) == len(text) else text
        for number, cue in enumerate(CUES):
            like = short[(size[short] == len(cue)) & (codes[start[short]] | 32 == ord(cue[0]))]
            for i in like.tolist():
                if lower[start[i] : end[i]] == cue:
                    shape[i] = WORDS_AT + number
    return start, end, shape, gap


def near_runs(shape: np.ndarray, gap: np.ndarray) -> list[tuple[int, int]]:
    """Runs of the tokens within ``REACH`` of a digit or an at sign."""
    telling = np.flatnonzero(((shape >= DIGITS_AT) & (shape < SIGNS_AT)) | (shape == SIGNS_AT + 64) | (shape == WORDS_AT))
    if not len(telling):
        return []
    low, high = np.maximum(telling - REACH, 0), np.minimum(telling + REACH + 1, len(shape))
    first = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    return list(zip(low[first].tolist(), high[np.append(first[1:] - 1, len(high) - 1)].tolist()))


#: Neighbourhoods: places of the shapes (and the gaps before them) that make up a feature.
VIEWS = ((0,), (-1,), (1,), (-2,), (2,), (-3,), (3,), (-1, 0), (0, 1))
VIEW_SIZES = [(SHAPES * GAPS) ** len(v) for v in VIEWS]
#: Pairs are hashed to so many rows.
PAIR_ROWS = 1 << 14


def view_rows(shape: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """(token, view) rows of the weight table for one run; edges have shape 0."""
    joint = np.concatenate([np.zeros(3, np.int64), shape * GAPS + gap, np.zeros(3, np.int64)])
    n, rows, base = len(shape), [], 0
    for view, size in zip(VIEWS, VIEW_SIZES):
        parts = [joint[3 + p : 3 + p + n] for p in view]
        if len(parts) == 1:
            rows.append(base + parts[0])
            base += size
        else:
            rows.append(base + (parts[0] * 40503 + parts[1] * 69069) % PAIR_ROWS)
            base += PAIR_ROWS
    return np.stack(rows, 1)


TABLE_ROWS = sum(s if len(v) == 1 else PAIR_ROWS for v, s in zip(VIEWS, VIEW_SIZES))


def allowed() -> np.ndarray:
    """A further token follows its own kind only."""
    table = np.ones((len(LABELS), len(LABELS)), bool)
    for to in range(2, len(LABELS), 2):
        table[:, to] = False
        table[[to - 1, to], to] = True
    return table


class Field:
    """Weights of the views' rows and of label transitions (row 0 also starts a run)."""

    def __init__(self, table: np.ndarray, steps: np.ndarray):
        self.table, self.steps = table, np.where(allowed(), steps, -1e9)

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Likeliest labels of each run, given as (token, view) rows."""
        found: list = [None] * len(runs)
        sizes = np.array([len(r) for r in runs], int)
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end + 1 - start) * sizes[order[end]] <= BLOCK:
                end += 1
            part = order[start:end]
            for i, labels in zip(part.tolist(), self._viterbi([runs[i] for i in part], sizes[part])):
                found[i] = labels
            start = end
        return found

    def _viterbi(self, runs: list[np.ndarray], sizes: np.ndarray) -> Iterator[np.ndarray]:
        longest, count = int(sizes.max()), len(LABELS)
        scores = np.zeros((longest, len(runs), count))
        for i, rows in enumerate(runs):
            scores[: len(rows), i] = self.table[rows].sum(1)
        back = np.zeros((longest, len(runs), count), np.uint8)
        best = scores[0] + self.steps[0]
        for t in range(1, longest):
            into = best[:, :, None] + self.steps
            back[t] = into.argmax(1)
            now = into.max(1) + scores[t]
            best = np.where((t < sizes)[:, None], now, best)
        label = best.argmax(1)
        path = np.zeros((longest, len(runs)), np.uint8)
        places = np.arange(len(runs))
        for t in range(longest - 1, -1, -1):
            inside = t < sizes
            path[t, inside] = label[inside]
            if t:
                label = np.where(inside, back[t, places, label], label)
        for i, size in enumerate(sizes):
            yield path[:size, i]


def train(runs: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS) -> Field:
    """Maximum likelihood by adaptive gradient steps; sums over labellings by forward and backward passes."""
    count, longest = len(LABELS), max(map(len, runs))
    sizes = np.array([len(r) for r in runs])
    n = len(runs)
    rows = np.zeros((longest, n, len(VIEWS)), np.int64)
    gold = np.zeros((longest, n), np.int64)
    for i, (r, y) in enumerate(zip(runs, labels)):
        rows[: len(r), i], gold[: len(r), i] = r, y
    inside = np.arange(longest)[:, None] < sizes
    flat, used = rows[inside], np.unique(rows[inside])
    flat = np.searchsorted(used, flat)
    table, moves = np.zeros((len(used), count)), np.zeros((count, count))
    open_ = allowed()
    true_moves = np.zeros((count, count))
    np.add.at(true_moves, (np.vstack([np.zeros((1, n), int), gold[:-1]])[inside], gold[inside]), 1)
    truth = np.eye(count)[gold[inside]]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, moves)]
    for step in range(1, steps + 1):
        emit = np.zeros((longest, n, count))
        emit[inside] = table[flat].sum(1)
        top = emit.max(2, keepdims=True)
        emit = np.exp(emit - top)
        jump = np.where(open_, np.exp(moves), 0)
        ahead, behind = np.zeros_like(emit), np.ones_like(emit)
        scale = np.ones((longest, n, 1))
        for t in range(longest):
            now = (jump[0] if t == 0 else ahead[t - 1] @ jump) * emit[t]
            scale[t] = now.sum(1, keepdims=True)
            ahead[t] = np.where(inside[t][:, None], now / scale[t], 0 if t == 0 else ahead[t - 1])
        for t in range(longest - 2, -1, -1):
            back = (behind[t + 1] * emit[t + 1] / scale[t + 1]) @ jump.T
            behind[t] = np.where(inside[t + 1][:, None], back, 1)
        odds = ahead * behind
        odds /= odds.sum(2, keepdims=True)
        expected = np.zeros((count, count))
        for t in range(1, longest):
            go = inside[t]
            right = behind[t, go] * emit[t, go] / scale[t, go]
            expected += jump * (ahead[t - 1, go].T @ right)
        expected[0] += odds[0].sum(0)
        wrong = truth - odds[inside]
        up = np.stack([
            np.bincount(flat.ravel(), np.repeat(wrong[:, label], flat.shape[1]), len(used)) for label in range(count)
        ], 1)
        for x, slope, (mean, spread) in zip((table, moves), (up, np.where(open_, true_moves - expected, 0)), state):
            slope = slope / n - PENALTY * x
            mean += 0.1 * (slope - mean)
            spread += 0.01 * (slope * slope - spread)
            x += 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    whole = np.zeros((TABLE_ROWS, count), np.float32)
    whole[used] = table
    return Field(whole, moves)


# --- the labelled table ------------------------------------------------------------------------------

#: Other ways to write a span, by kind: a pattern and what it becomes.
REWRITES = {
    0: ((r"@", " @ "), (r"@", "(at)"), (r"@", " [at] "), (r"\.(?=[a-z]+\Z)", " [dot] ")),
    1: ((r"\.", ". "), (r"\.", " . ")),
    2: ((r"(\d{4})[ -]?(?=\d)", r"\1 "), (r"(\d{4})[ -]?(?=\d)", r"\1."), (r"(\d{4})[ -]?(?=\d)", r"\1  "), (r"(\d{4})[ -]?(\d{4})[ -]?(?=\d)", "\\1 \\2\n")),
    3: ((r"\A\+", "00"), (r"\A\+\d+ ", ""), (r"[ ()-]+", "."), (r" (?=\d+-)", "\n"), (r"-", " / ")),
}


def labelled_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> list[tuple[str, list]]:
    """(text, spans) of short texts: base spans in their surroundings, as they are and rewritten, and other digits."""
    spotted = docs.where(F.col(text_col).rlike(r"@|\+[0-9]|[0-9]{4}|[0-9]\.[0-9]")).select(F.col(text_col).alias("text"))
    chosen = spotted.orderBy(F.md5("text"), F.length("text")).limit(most)
    pieces = chosen.mapInArrow(_surroundings, "text string, spans array<struct<kind:int,start:int,end:int>>")
    return [(r["text"], [tuple(s) for s in r["spans"]]) for r in pieces.collect()]


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most eight short pieces of a text, each with its spans; check digits are left to the check that follows."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        texts, spans = [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text, False)
            for i, (k, s, e) in enumerate(found[:6]):
                before, inner, after = text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND]
                # rewritten every second time, so that the ways of the texts themselves prevail
                ways = REWRITES[k]
                way = (len(text) + i) % (2 * len(ways))
                if way < len(ways):
                    inner = re.sub(*ways[way], inner)
                edge = len(before)
                piece = before + inner + after
                others = [(k, edge, edge + len(inner))]
                others += [x for x in base_spans(piece, False) if x[2] <= edge or x[1] >= edge + len(inner)]
                texts.append(piece)
                spans.append([dict(zip(("kind", "start", "end"), x)) for x in sorted(others, key=lambda x: x[1])])
            taken = [(s, e) for _, s, e in found]
            free = [m for m in DIGITS.finditer(text or "") if not any(s < m.end() and m.start() < e for s, e in taken)]
            for m in free[:2]:
                piece = text[max(0, m.start() - AROUND) : m.end() + AROUND]
                texts.append(piece)
                spans.append([dict(zip(("kind", "start", "end"), x)) for x in sorted(base_spans(piece, False), key=lambda x: x[1])])
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, kind)], ["text", "spans"])


def training_runs(labelled: list[tuple[str, list]], most: int = RUNS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Runs of tokens and their labels."""
    runs, labels = [], []
    for text, spans in sorted(labelled):
        start, end, shape, gap = tokens(text)
        label = np.zeros(len(start), np.int64)
        for kind, s, e in spans:
            held = np.flatnonzero((start >= s) & (end <= e))
            if len(held) and not label[held].any():
                label[held] = 2 + 2 * kind
                label[held[0]] = 1 + 2 * kind
        for low, high in near_runs(shape, gap):
            if high - low <= LONGEST:
                runs.append(view_rows(shape[low:high], gap[low:high]))
                labels.append(label[low:high])
    if len(runs) > most:
        picked = np.linspace(0, len(runs) - 1, most).astype(int)
        runs, labels = [runs[i] for i in picked], [labels[i] for i in picked]
    return runs, labels


def fit(labelled: list[tuple[str, list]]) -> Field | None:
    runs, labels = training_runs(labelled)
    return train(runs, labels) if any(y.any() for y in labels) else None


# --- search ------------------------------------------------------------------------------------------


def field_spans(field: Field | None, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """Spans that the field finds in each text and that pass their checks."""
    found: list[list] = [[] for _ in texts]
    runs, places = [], []
    for i, text in enumerate(texts):
        if not field or not text or not (DIGITS.search(text) or "@" in text or "at" in text):
            continue
        start, end, shape, gap = tokens(text)
        for low, high in near_runs(shape, gap):
            runs.append(view_rows(shape[low:high], gap[low:high]))
            places.append((i, start[low:high], end[low:high]))
    for (i, start, end), labels in zip(places, field.decode(runs) if runs else ()):
        for first in np.flatnonzero(labels % 2 == 1).tolist():
            last = first
            while last + 1 < len(labels) and labels[last + 1] == labels[first] + 1:
                last += 1
            kind, s, e = int(labels[first] - 1) // 2, int(start[first]), int(end[last])
            if passes(kind, texts[i][s:e]):
                found[i].append((kind, s, e))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _search(shared):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in text_pieces(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            listed = []
            for text, more in zip(texts, field_spans(field, texts)):
                base = base_spans(text)
                taken = sorted((s, e) for _, s, e in base)
                free = [x for x in more if not any(s < x[2] and x[1] < e for s, e in _close(taken, x[1], x[2]))]
                both = sorted([(*x, True) for x in base] + [(*x, False) for x in free])
                listed.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in both])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(listed, kind)], ["doc_id", "found"])

    return search


def _close(spans: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Those of the sorted spans that may touch this one."""
    high = bisect_left(spans, (end, 0))
    low = high
    while low and spans[low - 1][1] > start - 200:
        low -= 1
    return spans[low:high]


def find_personal_data(
    docs: DataFrame, labelled: list[tuple[str, list]] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, found (kind, start, end, base) of every row; ``labelled``: (text, (kind number, start, end) spans)."""
    kind = docs.schema[id_col].dataType.simpleString()
    field = fit(labelled_texts(docs, id_col, text_col) if labelled is None else labelled)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(
        _search(docs.sparkSession.sparkContext.broadcast(field)),
        f"doc_id {kind}, found array<struct<kind:string,start:int,end:int,base:boolean>>",
    )


@query("op13_pii")
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["base"])

    def number(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "doc_id",
        *map(number, KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: ~x["base"])).cast("bigint").alias("n_added"),
    )
