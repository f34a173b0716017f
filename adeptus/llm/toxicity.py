"""Toxicity: a subsequence string kernel, an SVM on Nyström landmarks.

The kernel compares two strings by their common subsequences of three characters;
a subsequence that spans ``s`` characters weighs ``DECAY**s``, up to ``SPAN`` of them.
Characters are code points of any script, lower-cased; a Latin letter with a mark
is the letter, and other letters are dealt to 26 codes by their code point.  So ``idxiot`` or ``i-d-i-o-t`` still shares most of its weight with ``idiot``.

A text is cut into sentences, a sentence into segments: pieces without white
space, of which letters and digits are kept; runs of one-character pieces joined
(``i d i o t``); and overlapping windows of joined neighbours, every two of them
and more up to ``JOIN`` characters (``id iot``, insults of several words, spelled
out sentences).  Each stands between border marks.  A sentence is as toxic as its
most toxic segment, a document as its most toxic sentence.

Training sees labelled sentences.  Those of clean documents are clean.  A toxic
document's segments are a bag of which the one that most tells toxic from clean
sentences is positive, if enough toxic sentences have it (a share of the toxic
documents).  Every other toxic document gives, among its segments of the best
odds, that which the machine of the turn before finds most toxic.  They train
against segments of clean sentences a linear SVM in the space that the landmarks
span (Nyström), with rounds of hard clean segments added; a logistic curve over
documents calibrates the scores.

The decision is linear in the subsequences, so the trained machine is folded
into one weight per subsequence, and scoring is table look-ups for all segments
of many documents at once.

Training reads a bounded sample (``max_train`` of each label, those of smallest
id hash); scoring reads every whole text.  Labels, ids and other columns are
never inputs.  Null and empty texts have no segment and get the lowest score of
the curve.  Null labels aren't learnt from; without both labels every score is
0.  Repeated rows are scored each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adeptus.llm.shared import by_batches
from adeptus.llm.textblock import BYTE_KEY, CLASS, LOWER, POWER, SPACE, WORD, column_bytes, mix, powers, slices

SPAN, DECAY = 8, 0.6
LANDMARKS = 256
#: Bytes of text whose segments are held at once; each byte is in several windows.
SLICE_BYTES = 1 << 17
#: Characters whose subsequences are summed in one pass.
PASS = 1 << 13
#: Characters of a window of three or more pieces.
JOIN = 10
#: Toxic sentences, as a share of the toxic documents, that make a segment's odds count.
LEAST_SHARE = 0.001
INVERSE = np.uint64(pow(int(POWER), -1, 1 << 64))
#: Codes: 1..26 letters, 27..36 digits, 37..62 other characters, 63 the border.
OTHER, BORDER = 37, 63
CODE = np.zeros(128, np.int32)
CODE[97:123] = np.arange(1, 27)
CODE[48:58] = np.arange(27, 37)
#: Code points that may have case or marks, which lie in the first two planes.
CASED = 0x20000
STEPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[10, 13, 33, 46, 63]] = True


@cache
def _code_table() -> np.ndarray:
    """The code of every code point below ``CASED``; once a process."""
    table = np.zeros(CASED, np.int32)
    for point in range(CASED):
        low = chr(point).lower()
        base = ord(unicodedata.normalize("NFD", low)[0])
        table[point] = CODE[base] if base < 128 and CODE[base] else OTHER + ord(low[0]) % (BORDER - OTHER)
    return table


def _codes(text: np.ndarray) -> np.ndarray:
    """The code of each character of UTF-8 bytes."""
    if not len(text) or text.max() < 128:
        return CODE[text]
    at = np.flatnonzero((text & 0xC0) != 0x80)
    point = text[at].astype(np.int32)
    kind = point.copy()
    follow = np.append(text & 0x3F, np.zeros(3, np.uint8)).astype(np.int32)
    for least, most, size, bits in ((0xC0, 0xDF, 2, 0x1F), (0xE0, 0xEF, 3, 0x0F), (0xF0, 0xF7, 4, 0x07)):
        some = np.flatnonzero((kind >= least) & (kind <= most))
        value = kind[some] & bits
        for k in range(1, size):
            value = value << 6 | follow[at[some] + k]
        point[some] = value
    return np.where(point < CASED, _code_table()[np.minimum(point, CASED - 1)], OTHER + point % (BORDER - OTHER))


@dataclass
class Model:
    """A weight for each subsequence, the SVM's intercept, and the calibration curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


class Segments:
    """Segments of rows ``lo:hi`` of a text column.

    ``codes`` holds the coded characters of all distinct segments one after another,
    each between borders, segment k at ``first[k]:first[k+1]``.  ``kind`` names
    the distinct segment of each occurrence, ``doc`` its row, ``sentence`` its sentence.
    Segments of the same codes are the same, since the kernel can't tell them apart.
    """

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, lo: int, hi: int):
        base = offsets[lo]
        offsets = offsets[lo:hi + 1] - base
        self.rows = hi - lo
        buf = LOWER[raw[base:base + offsets[-1]]]
        n = len(buf)
        kind = CLASS[buf]
        fresh = np.zeros(n, bool)
        if n:
            inner = offsets[:-1]
            space = kind == SPACE
            fresh[0] = True
            fresh[1:] = space[:-1]
            fresh[inner[inner < n]] = True
        piece = np.cumsum(fresh)                       # white space ends a piece
        at = np.flatnonzero(kind == WORD)
        piece = piece[at]
        new = np.ones(len(at), bool)
        new[1:] = piece[1:] != piece[:-1]
        start = np.flatnonzero(new)
        doc = np.searchsorted(offsets, at[start], side="right") - 1
        ends = np.flatnonzero(SENTENCE_END[buf]) if n else np.zeros(0, np.int64)
        sentence = np.searchsorted(ends, at[start]) + doc
        text = buf[at]
        count = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))[np.append(start, len(at))]
        # runs of at least three one-character pieces are one segment
        single = np.diff(count) == 1
        follows = np.zeros(len(start), bool)
        if len(start) > 1:
            follows[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
        run = np.cumsum(~follows) - 1
        length = np.bincount(run) if len(run) else np.zeros(0, np.int64)
        joined = (length >= 3)[run] & follows if len(run) else follows
        begin = [np.flatnonzero(~joined)]
        end = [np.append(begin[0][1:], len(start))] if len(start) else [begin[0]]
        # windows of neighbours in a sentence
        for k in range(2, JOIN + 1):
            m = max(0, len(start) - k + 1)
            near = sentence[k - 1:k - 1 + m] == sentence[:m]
            if k > 2:
                near &= count[k:k + m] - count[:m] <= JOIN
            begin.append(np.flatnonzero(near))
            end.append(begin[-1] + k)
        begin, end = np.concatenate(begin), np.concatenate(end)
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        self.doc, self.sentence = doc[begin], sentence[begin]
        if len(start):
            text = _codes(text)
            start, size_of = count[begin], count[end] - count[begin]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_KEY[text] * powers(len(text)))))
            back = np.full(len(text), INVERSE)
            back[0] = 1
            h = mix((total[start + size_of] - total[start]) * np.multiply.accumulate(back)[start])
            self.hash, some, self.kind = np.unique(h, return_index=True, return_inverse=True)
            s, z = start[some], size_of[some]
        else:
            self.hash, self.kind = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            s = z = np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(z + 2)))
        codes = np.full(int(self.first[-1]), BORDER, np.int32)
        put = np.repeat(self.first[:-1] + 1, z) + (np.arange(int(z.sum())) - np.repeat(np.cumsum(z) - z, z))
        take = np.repeat(s, z) + (np.arange(int(z.sum())) - np.repeat(np.cumsum(z) - z, z))
        codes[put] = text[take]
        self.codes, self.size = codes, z + 2


def _norms(longest: int) -> np.ndarray:
    """Length of a string's feature vector by the string's size, subsequences counted as distinct."""
    size = np.arange(longest + 1)
    total = np.zeros(longest + 1)
    for a, b in STEPS:
        total += np.maximum(size - a - b, 0) * DECAY ** (2 * (a + b + 1))
    return np.sqrt(np.maximum(total, 1e-9))


def segment_values(codes: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of each segment's subsequences, divided by its norm."""
    n = len(codes)
    size = np.diff(first)
    left = np.repeat(first[1:], size) - np.arange(n)   # characters from here to the segment's end
    value = np.zeros(n)
    for lo in range(0, n, PASS):                       # what a pass reads again and again fits the processor's cache
        part = codes[lo:lo + PASS + SPAN - 1].astype(np.intp)
        first_code, inner_code, rest = part * 4096, part * 64, left[lo:lo + PASS]
        for span in range(2, SPAN):                    # from the first character to the last
            m = min(PASS, len(part) - span)
            if m <= 0:
                break
            ends = first_code[:m] + part[span:span + m]
            total = weights[ends + inner_code[1:1 + m]]
            for a in range(2, span):
                total += weights[ends + inner_code[a:a + m]]
            value[lo:lo + m] += total * (rest[:m] > span) * DECAY ** (span + 1)
    return np.add.reduceat(value, first[:-1]) / _norms(int(size.max()))[size] if n else np.zeros(0)


def _subsequences(strings: list[bytes], column: np.ndarray, width: int) -> np.ndarray:
    """Feature vectors of strings over the subsequences that ``column`` numbers."""
    out = np.zeros((len(strings), width), np.float32)
    norms = _norms(max(map(len, strings)))
    for r, s in enumerate(strings):
        c = np.frombuffer(s, np.uint8).astype(np.int32)
        for a, b in STEPS:
            m = len(c) - a - b
            if m > 0:
                at = column[c[:m] * 4096 + c[a:a + m] * 64 + c[a + b:]]
                np.add.at(out[r], at[at >= 0], DECAY ** (a + b + 1))
        out[r] /= norms[len(s)]
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the rows inside the margin."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], cost[inside]
        new = np.linalg.solve(ridge + (xi * ci[:, None]).T @ xi, xi.T @ (ci * y[inside]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, slightly regularised, by Newton steps."""
    a = np.array([1.0, 0.0])
    f = np.stack((x, np.ones(len(x))), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(f @ a, -30, 30)))
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + np.eye(2) * 0.05,
                               f.T @ (p - y) + 0.05 * a * [1, 0])
        a = a - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(a[0]), float(a[1])


def train(texts: pa.Array, labels: np.ndarray, landmarks: int = LANDMARKS, seed: int = 7) -> Model:
    """Fit on whole labelled texts; see the module's docstring."""
    weights = np.zeros(64 ** 3)
    toxic = labels > 0
    if not toxic.any() or toxic.all():
        return Model(weights, 0.0, 0.0, -40.0)
    offsets, raw = column_bytes(texts)
    parts, marks, sentences = [], [], 0                # per slice: its distinct segments, and its occurrences
    for lo, hi in slices(offsets, SLICE_BYTES):
        part = Segments(offsets, raw, lo, hi)
        cut = np.flatnonzero(np.diff(part.sentence, prepend=-1))
        if not len(cut):
            continue
        kind = part.kind.astype(np.int32)
        sent = np.repeat(np.arange(len(cut), dtype=np.int32), np.diff(np.append(cut, len(kind))))
        parts.append((part.hash, part.codes.astype(np.uint8), part.first.astype(np.int32), kind, (lo + part.doc).astype(np.int32),
                      sent, sentences))
        marks.append(np.add.reduceat(mix(part.hash[kind]), cut))
        sentences += len(cut)
    if not parts:
        return Model(weights, 0.0, 0.0, -40.0)
    known = np.zeros(0, np.uint64)
    for lo in range(0, len(parts), 16):
        known = np.unique(np.concatenate([known, *(p[0] for p in parts[lo:lo + 16])]))
    place = [np.searchsorted(known, p[0]).astype(np.int32) for p in parts]
    held, spot = np.zeros(len(known), np.int32), np.zeros(len(known), np.int32)
    for i, at in enumerate(place):
        held[at], spot[at] = i, np.arange(len(at))

    def strings(kinds: list[int]) -> list[bytes]:
        return [parts[held[s]][1][parts[held[s]][2][spot[s]]:parts[held[s]][2][spot[s] + 1]].tobytes() for s in kinds]

    def values() -> np.ndarray:
        out = np.zeros(len(known))
        for at, (_, codes, first, *_) in zip(place, parts):
            out[at] = segment_values(codes.astype(np.int32), first, weights)
        return out

    # a sentence is the set of its segments; copies of a sentence count once
    fresh = np.zeros(sentences, bool)
    fresh[np.unique(np.concatenate(marks), return_index=True)[1]] = True
    clean, bad, kept = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), [0, 0]
    row, has = [], []
    for at, (_, _, _, kind, doc, sent, before) in zip(place, parts):
        bad_row = toxic[doc]
        row.append(doc[bad_row])
        has.append(at[kind[bad_row]])
        side = np.zeros(int(sent[-1]) + 1, bool)
        side[sent] = bad_row
        new = fresh[before:before + len(side)]
        kept[0] += int((new & ~side).sum())
        kept[1] += int((new & side).sum())
        pair = np.unique(sent[new[sent]].astype(np.int64) * len(at) + kind[new[sent]])
        of, pair = side[pair // len(at)], at[pair % len(at)]
        np.add.at(clean, pair[~of], 1)
        np.add.at(bad, pair[of], 1)
    odds = np.log((bad + 0.3) / (kept[1] + 1)) - np.log((clean + 0.3) / (kept[0] + 1))
    # a toxic document's positive is its most telling segment
    row, has = np.concatenate(row), np.concatenate(has)
    sure = (bad >= max(2, LEAST_SHARE * toxic.sum())) & (odds > 2.0)
    told = np.isin(row, row[sure[has]])

    def best(second: np.ndarray, among: np.ndarray) -> np.ndarray:
        d, s = row[among], has[among]
        order = np.lexsort((s, -second[s], -odds[s], d))
        return s[order][np.diff(d[order], prepend=-1) > 0]

    rng = np.random.Generator(np.random.PCG64(seed))
    value, negative, bias = np.zeros(len(known)), None, 0.0
    for turn in range(4):
        # the first turn has the documents with such a segment, if there are any; the others follow the machine
        positive = best(value, told & sure[has] if not turn and told.any() else told & sure[has] | ~told)
        witness, often = np.unique(positive, return_counts=True)
        if not len(witness):
            return Model(weights, 0.0, 0.0, -40.0)
        order = np.lexsort((witness, -often))
        positive, often = witness[order].tolist(), often[order].astype(float)
        free = clean > 0
        free[witness] = False
        pool = np.flatnonzero(free)
        if negative is None:
            negative = rng.permutation(pool)[:6000]
        hard = pool[np.argsort(-value[pool], kind="stable")[:1500]] if turn else pool[:0]
        negative = np.union1d(negative[free[negative]], hard)
        marks = positive[:landmarks * 3 // 4]
        marks = marks + negative[np.argsort(-value[negative], kind="stable")[:landmarks - len(marks)]].tolist()
        weights, bias = _fit(strings(marks), strings(positive), often, strings(negative.tolist()))
        value = values()
    top = document_values(weights, bias, offsets, raw)
    return Model(weights, bias, *_curve(top, toxic.astype(float)))


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join(strings), np.uint8).astype(np.int32),
            np.concatenate(([0], np.cumsum([len(s) for s in strings]))))


def _fit(marks: list[bytes], positive: list[bytes], often: np.ndarray, negative: list[bytes]) -> tuple[np.ndarray, float]:
    """SVM in the landmarks' Nyström space, folded into a weight per subsequence."""
    column = np.full(64 ** 3, -1, np.int64)
    used = set()
    for s in marks:
        c = np.frombuffer(s, np.uint8).astype(np.int32)
        for a, b in STEPS:
            if len(c) > a + b:
                used.update((c[:len(c) - a - b] * 4096 + c[a:len(c) - b] * 64 + c[a + b:]).tolist())
    codes = np.array(sorted(used))
    column[codes] = np.arange(len(codes))
    base = _subsequences(marks, column, len(codes))
    value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])                 # K_mm ** -1/2
    both = positive + negative
    rows = np.vstack([_subsequences(both[i:i + 256], column, len(codes)) @ base.T for i in range(0, len(both), 256)])
    y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
    cost = np.concatenate((np.minimum(often, 50), np.full(len(negative), 3.0)))
    beta, bias = _svm(rows @ root, y, cost)
    out = np.zeros(64 ** 3)
    out[codes] = base.T @ (root @ beta)
    return out, bias


def document_values(weights: np.ndarray, bias: float, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Largest segment decision of each row; -2 for a row without segments."""
    out = np.full(len(offsets) - 1, -2.0)
    for lo, hi in slices(offsets, SLICE_BYTES):
        part = Segments(offsets, raw, lo, hi)
        if len(part.kind):
            value = segment_values(part.codes, part.first, weights)[part.kind] + bias
            cut = np.flatnonzero(np.diff(part.doc, prepend=-1))
            out[lo + part.doc[cut]] = np.maximum(np.maximum.reduceat(value, cut), -2.0)
    return out


def fit(sample: DataFrame) -> Model:
    """Train on a bounded sample, in one task; the model comes back to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        m = train(table.column("text").combine_chunks(), np.array(table.column("label")))
        at = np.flatnonzero(m.weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at.astype("<i4").tobytes()]), pa.array([m.weights[at].astype("<f8").tobytes()]),
             pa.array([[m.bias, m.slope, m.shift]])], names=["at", "weights", "rest"])

    ordered = sample.repartition(1).sortWithinPartitions("place", "k", "text")
    rows = by_batches(ordered, run, "at binary, weights binary, rest array<double>").collect()
    weights = np.zeros(64 ** 3)
    if not rows:
        return Model(weights, 0.0, 0.0, -40.0)
    weights[np.frombuffer(rows[0]["at"], "<i4")] = np.frombuffer(rows[0]["weights"], "<f8")
    return Model(weights, *rows[0]["rest"])


def scores(model: Model, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    margin = model.slope * document_values(model.weights, model.bias, offsets, raw) + model.shift
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] = ("doc_id",),
          out: str = "score") -> DataFrame:
    """The columns ``carry`` of every row of ``docs``, and its score as ``out``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = [*carry] if text_col in carry else [*carry, text_col]
    at, n = names.index(text_col), len(carry)
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(shipped.value, *column_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found)], names=[*carry, out])

    return by_batches(docs.select(*names), run, schema)
