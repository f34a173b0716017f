"""License scans: exact phrases, and short notices found with a few errors.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after ``A-Z`` is
lowered.  Base labels come from phrases whose words stand consecutively.

Notices are found by the pigeonhole principle: a notice that may have ``k``
edits is split into ``k + 1`` pieces, of which at least one must occur unchanged.
An automaton over all pieces finds them in one pass over a text; around every
piece found, the ``regex`` library matches the whole notice with at most ``k``
errors and gives the span and the number of edits, leftmost first.  Windows that
touch are merged first, so a text full of pieces is matched once.  Every run of
white space is one space before that, so wrapped and indented notices have the
same pieces; spans are places of the text as it was.

A null or empty text has no words and no labels, score 0.  Every whole text is
scanned, repeated rows each; all places are counted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adeptus.llm.textblock import TextBlock, column_bytes, slices, text_hash

# Fixed values of the task: phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short public notices, lower case, single spaces: text, label, edits allowed.
NOTICES = [
    ("permission is hereby granted, free of charge", "mit", 3),
    ("released under the mit license", "mit", 2),
    ("licensed under the apache license, version 2.0", "apache", 3),
    ("this program is free software: you can redistribute it", "gpl", 4),
    ("licensed under the gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 3),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", 4),
    ("licensed under cc by-nc 4.0", "cc-by-nc", 1),
    ("licensed under cc by-sa 4.0", "cc-by-sa", 1),
    ("creative commons attribution", "cc-by", 2),
    ("all rights reserved", "reserved", 1),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd", 4),
    ("permission to use, copy, modify, and/or distribute this software for any purpose", "isc", 4),
    ("this is free and unencumbered software released into the public domain", "unlicense", 4),
    ("gnu affero general public license", "agpl", 2),
    ("eclipse public license", "epl", 1),
    ("common development and distribution license", "cddl", 2),
    ("boost software license - version 1.0", "boost", 2),
    ("creative commons cc0 1.0 universal", "cc0", 2),
    ("licensed under cc by 4.0", "cc-by", 1),
]


def split_notice(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): the notice in ``edits + 1`` pieces of nearly equal size."""
    n, parts = len(notice), edits + 1
    cut = [n * i // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cut[:-1], cut[1:])]


#: White space that isn't one space already.
WIDE = regex.compile(r"\s{2,}|[^\S ]")


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """``text`` with each run of white space as one space, the folded runs' places, and characters lost up to each."""
    out, places, lost = [], [], [0]
    last = size = 0
    for m in WIDE.finditer(text):
        out += [text[last:m.start()], " "]
        size += m.start() - last + 1
        last = m.end()
        places.append(size - 1)
        lost.append(last - size)
    return ("".join(out) + text[last:] if out else text), places, lost


def notice_pattern(notice: str, edits: int):
    """Matches the notice with at most ``edits`` errors in folded text."""
    return regex.compile(f"(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}", regex.ENHANCEMATCH)


class Scanner:
    """The automaton of all pieces and the patterns, built once a task."""

    def __init__(self, notices: list[tuple[str, str, int]]):
        self.notices = notices
        self.patterns = [notice_pattern(n, k) for n, _, k in notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _, edits) in enumerate(notices):
            for at, piece in split_notice(notice, edits):
                pieces.setdefault(piece, []).append((i, at))
        self.find = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.find.add_word(piece, (len(piece), where))
        self.find.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of every notice in lower-case ``text``, by code points."""
        return [m[:4] for m in self.matches(text)]

    def matches(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """:meth:`spans`, each with the size of the notice that it matched."""
        text, places, lost = folded(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.find.iter(text):
            for i, at in where:
                notice, _, edits = self.notices[i]
                lo = end + 1 - size - at
                windows.setdefault(i, []).append((max(0, lo - 2 * edits), lo + len(notice) + 2 * edits))
        found = []
        for i, near in windows.items():
            own: list[list[int]] = []
            for lo, hi in sorted(near):
                if own and own[-1][1] >= lo:
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
            for lo, hi in own:
                for m in self.patterns[i].finditer(text, lo, min(hi, len(text))):
                    start, end = (x + lost[bisect_left(places, x)] for x in m.span())
                    found.append((self.notices[i][1], start, end, sum(m.fuzzy_counts), len(self.notices[i][0])))
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def phrase_places(block: TextBlock, phrases: dict[str, str]) -> list[tuple[np.ndarray, str]]:
    """(numbers of the words where the phrase starts, label) of each phrase, over all rows of the block."""
    out = []
    buf = block.buf.tobytes()
    for phrase, label in phrases.items():
        words = phrase.split()
        m = len(block.hash) - len(words) + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), label))
            continue
        hit = block.doc[:m] == block.doc[len(words) - 1:]
        for k, w in enumerate(words):
            hit &= block.hash[k:m + k] == np.uint64(text_hash(w))
        at = np.flatnonzero(hit)
        at = np.array([a for a in at if all(
            buf[block.start[a + k]:block.start[a + k] + block.length[a + k]] == w.encode()
            for k, w in enumerate(words))], np.int64)
        out.append((at, label))
    return out


SPANS = "array<struct<label:string,start:int,end:int,edits:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         phrases: dict[str, str] | None = None, notices: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score and the notices' spans.

    ``score`` is 1 with a base phrase, else the share of unedited characters of
    the notice that was matched best, else 0.
    """
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + T._parse_datatype_string(
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        f"labels string, score double, spans {SPANS}").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)

        for batch in batches:
            offsets, raw = column_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                block = TextBlock(offsets, raw, lo, hi)
                n = hi - lo
                count = np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set[str]] = [set() for _ in range(n)]
                for at, label in phrase_places(block, phrases):
                    row = block.doc[at]
                    place = at - block.first[row]
                    np.add.at(count, row, 1)
                    np.minimum.at(first, row, place)
                    np.maximum.at(last, row, place)
                    for r in set(row.tolist()):
                        base[r].add(label)
                texts = block.buf.tobytes()
                out = []
                for r in range(n):
                    text = texts[block.offsets[r]:block.offsets[r + 1]].decode()
                    found = scanner.matches(text)
                    near = [max(0.0, 1 - edits / size) for *_, edits, size in found]
                    out.append(([m[:4] for m in found], 1.0 if base[r] else max(near, default=0.0)))
                has = count > 0
                rows = {
                    id_col: batch.column(0).slice(lo, n),
                    "n_words": pa.array(np.diff(block.first), pa.int64()),
                    "n_base": pa.array(count),
                    "first_word": pa.array(first, mask=~has), "last_word": pa.array(last, mask=~has),
                    "base_labels": pa.array([",".join(sorted(b)) for b in base]),
                    "labels": pa.array([",".join(sorted(b | {s[0] for s in spans})) for b, (spans, _) in zip(base, out)]),
                    "score": pa.array([score for _, score in out]),
                    "spans": pa.array([[{"label": a, "start": b, "end": c, "edits": d} for a, b, c, d in spans]
                                       for spans, _ in out],
                                      pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()),
                                                          ("end", pa.int32()), ("edits", pa.int32())]))),
                }

                yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
