"""License scans by conditional compression.

A document's candidate blocks are the word windows around cue words: for every template and each
of its cues with the same stem, the window that the template would fill if the cue stood there. A
block is compressed on its own and with each such template as a raw Zstandard dictionary; the relative
size reductions rank the templates. Winners are confirmed by their exact wording: the words
that differ from the template are listed (words before its first and after its last one are not
part of the statement), at most `MAX_EDITS` of them may, and none that holds a digit or decides
the terms (a version, or a word like "no" or "non"). Of overlapping confirmed blocks the one with
the fewest differences, then the largest reduction, stays.

Documents without any cue are dropped by built-in string functions before the Python stage; every
whole text is searched.

Defined cases: null and empty texts have no findings; a text of one long line is like any other;
repeated rows are scanned each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesig.llm.common import doc_columns

LEAST_GAIN = 0.35
MAX_EDITS = 0.15  # of the template's words
LEVEL = 3

# License statements (identifier, wording)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("proprietary", "All rights reserved."),
]
# Words that begin with one of these are cues
CUES = ["licen", "copyright", "permission", "redistribut", "released", "unencumbered", "reserved"]
DECISIVE = {"no", "non", "not", "lesser", "affero", "mit", "apache", "bsd", "mozilla", "commons"}

_WORD = re.compile(r"\S+")
_EDGES = re.compile(r"^\W+|\W+$")


def plain(word: str) -> str:
    return _EDGES.sub("", word).lower()


def stem(word: str) -> str | None:
    """The cue that the word begins with."""
    return next((c for c in CUES if word.startswith(c)), None)


class Template:
    """One wording, with the compressor that knows it."""

    def __init__(self, number: int, name: str, text: str):
        import zstandard
        self.number, self.name, self.text = number, name, text.lower()
        self.words = [plain(w) for w in _WORD.findall(text)]
        self.cues = [(stem(w), i) for i, w in enumerate(self.words) if stem(w)]
        raw = zstandard.ZstdCompressionDict(self.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False).compress

    def differences(self, words: list[str]) -> tuple[int, list[str], bool, int, int]:
        """(number of words that differ, what differs, whether any of that decides the terms, words
        before the template's first one, words after its last one)."""
        edits, said, decisive, before, after = 0, [], False, 0, 0
        for what, a, b, c, d in difflib.SequenceMatcher(None, self.words, words, autojunk=False).get_opcodes():
            if what == "insert" and a == 0:
                before = d
            elif what == "insert" and a == len(self.words):
                after = d - c
            elif what != "equal":
                old, new = self.words[a:b], words[c:d]
                edits += max(len(old), len(new))
                said.append(f"{' '.join(old)} -> {' '.join(new)}")
                decisive |= any(w in DECISIVE or "-" in w or any(x.isdigit() for x in w) for w in old + new)
        return edits, said, decisive, before, after


def by_stem(templates: list[Template]) -> dict[str, list[tuple[Template, int]]]:
    """The templates by each of their cues' stems, with the cue's place."""
    out: dict[str, list[tuple[Template, int]]] = {}
    for t in templates:
        for cue, at in t.cues:
            out.setdefault(cue, []).append((t, at))
    return out


def scan_text(text: str, by_cue: dict[str, list[tuple[Template, int]]], alone) -> list[tuple]:
    """Confirmed statements (start, words, license, gain, edits, differences) of one text."""
    found = list(_WORD.finditer(text))
    words = [plain(m.group()) for m in found]
    confirmed = []
    for p, word in enumerate(words):
        cue = stem(word)
        if not cue:
            continue
        ranked, sizes = [], {}
        for t, at in by_cue.get(cue, ()):
            lo, hi = max(0, p - at), min(len(words), p - at + len(t.words))
            block = text[found[lo].start():found[hi - 1].end()].lower().encode()
            if (lo, hi) not in sizes:
                sizes[lo, hi] = len(alone(block))
            size = sizes[lo, hi]
            ranked.append(((size - len(t.compress(block))) / size, -t.number, t, lo, hi))
        for gain, _, t, lo, hi in sorted(ranked, key=lambda r: r[:2], reverse=True):
            if gain < LEAST_GAIN:
                break
            slack, near = int(MAX_EDITS * len(t.words)), []
            for more in {0, slack}:  # inserted or missing words beside the cue shift the statement's ends
                first, last = max(0, lo - more), min(len(words), hi + more)
                edits, said, decisive, before, after = t.differences(words[first:last])
                if edits <= MAX_EDITS * len(t.words) and not decisive:
                    near.append((edits, -gain, first + before, last - after, t.name, "; ".join(said)))
            if near:
                confirmed.append(min(near))
                break
    out, taken = [], []
    for edits, gain, lo, hi, name, said in sorted(confirmed, key=lambda c: (c[0], c[2] - c[3], *c[1:])):
        if all(hi <= a or lo >= b for a, b in taken):
            taken.append((lo, hi))
            out.append((lo, hi - lo, name, -gain, edits, said))
    return sorted(out)


FOUND = "doc_id long, start_word long, words long, license string, gain double, edits long, differences string"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per license statement of a document."""
    templates = templates or TEMPLATES

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        by_cue = by_stem([Template(number, name, text) for number, (name, text) in enumerate(templates)])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for hit in scan_text(text, by_cue, alone)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)],
                                             names=[c.split()[0] for c in FOUND.split(", ")])

    rows = doc_columns(docs, "doc_id", "text")
    low, cue = F.lower("text"), F.lit(False)
    for stem in CUES:
        cue = cue | F.contains(low, F.lit(stem))
    return rows.filter(cue).mapInArrow(find, FOUND)
