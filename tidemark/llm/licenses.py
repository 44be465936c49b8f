"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

from bisect import bisect_left
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import LOWER, span_hashes, text_slices, word_spans

#: Public license notices, fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
#: What tells a license from its siblings: of these phrases, each one that a template has must be aligned word by word.
TELLING = {
    "Apache-2.0": ("apache license version 2 0",),
    "MIT": ("mit license", "the above copyright notice and this permission notice shall be included"),
    "GPL-3.0": ("gnu general public license", "version 3", "gnu general public license version 3 29 june 2007"),
    "GPL-2.0": ("gnu general public license", "version 2", "gnu general public license version 2 june 1991"),
    "LGPL-2.1": ("lesser general public license", "version 2 1"),
    "LGPL-3.0": ("lesser general public license", "version 3", "gnu lesser general public license version 3 29 june 2007"),
    "AGPL-3.0": ("affero general public license", "version 3"),
    "MPL-2.0": ("mozilla public license version 2 0",),
    "BSD-3-Clause": ("endorse or promote",),
} | {
    f"CC-{kind.upper()}-4.0": (f"cc {kind.replace('-', ' ')} 4 0", f"attribution {long} 4 0".replace("  ", " "))
    for kind, long in (("by", ""), ("by-nc", "noncommercial"), ("by-sa", "sharealike"), ("by-nd", "noderivatives"),
                       ("by-nc-sa", "noncommercial sharealike"), ("by-nc-nd", "noncommercial noderivatives"))
}
#: A match that lacks words of its template spans at most so many times its length, wherever it stands; words strewn over a long
#: text would make up most of a short template. A match with every word may span any number of words.
SPREAD = 4


@cache
def known_texts() -> dict[str, tuple[str, ...]]:
    """TEMPLATES, and after them the whole license texts in license_texts/. Read on the driver."""
    out = dict(TEMPLATES)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        out[path.stem] = (*out.get(path.stem, ()), path.read_text())
    return out


#: Words are ASCII letters and digits and characters beyond ASCII; the same rule cuts texts and templates.
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(text: str) -> np.ndarray:
    buf = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(buf, np.array([0, len(buf)]), OUTSIDE)
    return span_hashes(buf, starts, ends)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, least: float = 0.8) -> DataFrame:
    """(id, license, variant, coverage, n_matched, first_word, last_word, n_licenses) for each row of ``docs``.

    The license whose template has the largest share of its words aligned with the text, ``least`` or more (coverage), and its telling
    phrases whole; a match that is not complete spans at most ``SPREAD`` times the template; of equals the one with more matched words, then the first name. A match within the places of another one with more words (a notice in a
    whole license text) does not count. first_word and last_word count the text's words from 0. n_licenses counts the licenses that
    are found. Without one license, variant and places are null, and coverage and n_matched are those of the nearest template; for null and wordless texts they are 0.
    Rows are judged one by one, repeated or not. An empty table gives an empty result; other columns are not read. Whole texts are aligned.
    """
    given = templates or known_texts()
    known = [(name, v, _words(t)) for name, variants in sorted(given.items()) for v, t in enumerate(variants)]
    known = [(name, v, w) for name, v, w in known if len(w)]
    vocabulary = np.unique(np.concatenate([w for _, _, w in known])) if known else np.zeros(0, np.uint64)
    known = [(name, v, np.searchsorted(vocabulary, w).tolist(), _telling(w, TELLING.get(name, ()), vocabulary)) for name, v, w in known]
    counts = np.array([np.bincount(t, minlength=len(vocabulary)) for _, _, t, _ in known], np.int32).reshape(len(known), len(vocabulary))

    def run(batches):
        for b in batches:
            rows = []
            for first, buf, offsets in text_slices(b.column(1)):
                low = LOWER[buf]
                starts, ends, row = word_spans(low, offsets, OUTSIDE)
                words = span_hashes(low, starts, ends)
                at = np.searchsorted(vocabulary, words)
                at[at == len(vocabulary)] = 0
                hit = np.flatnonzero(vocabulary[at] == words) if len(vocabulary) else np.zeros(0, np.int64)
                cuts = np.searchsorted(row[hit], np.arange(len(offsets)))
                begin = np.searchsorted(row, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    mine = hit[cuts[i]: cuts[i + 1]]
                    rows.append(best(at[mine], mine - begin[i], known, counts, least))
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            names = ["license", "variant", "coverage", "n_matched", "first_word", "last_word", "n_licenses"]
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], ["id", *names])

    schema = "id long, license string, variant int, coverage double, n_matched long, first_word long, last_word long, n_licenses int"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _telling(template: np.ndarray, phrases, vocabulary: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """(words, places in the template) of each phrase that the template has."""
    out = []
    for phrase in phrases:
        w = _words(phrase)
        at = [i for i in range(len(template) - len(w) + 1) if (template[i: i + len(w)] == w).all()]
        if at:
            out.append((np.searchsorted(vocabulary, w).tolist(), at))
    return out


def best(words: np.ndarray, places: np.ndarray, known, counts: np.ndarray, least: float):
    """The best license for a text, given its words that occur in some template, and their places."""
    if not len(words) or not len(known):
        return None, None, 0.0, 0, None, None, 0
    most = np.minimum(np.bincount(words, minlength=counts.shape[1]), counts).sum(axis=1)
    sizes = np.array([len(t) for _, _, t, _ in known])
    found, near = [], (0.0, 0)
    w, p = words.tolist(), places.tolist()
    for k in np.argsort(-most / sizes, kind="stable").tolist():
        name, variant, template, telling = known[k]
        need = int(np.ceil(least * len(template) - 1e-9))
        if most[k] < need and (found or most[k] / len(template) <= near[0]):
            continue  # cannot reach it
        used = set(template)
        mine = [i for i, x in enumerate(w) if x in used]
        a, at = [w[i] for i in mine], [p[i] for i in mine]
        pairs = aligned(a, template)
        near = max(near, (len(pairs) / len(template), len(pairs)))
        if most[k] < need:
            continue
        tried = [pairs]
        if len(pairs) < len(template) or not _tells(pairs, at, telling):
            tried += _local(a, at, template, telling, need)
        tried = [x for x in tried if len(x) >= need and _tells(x, at, telling)
                 and (len(x) == len(template) or at[x[-1][0]] - at[x[0][0]] < SPREAD * len(template))]
        if tried:
            pairs = max(tried, key=len)
            found.append((name, variant, len(pairs) / len(template), len(pairs), at[pairs[0][0]], at[pairs[-1][0]]))
    if not found:
        return None, None, *near, None, None, 0
    found = [f for f in found if not any(o[3] > f[3] and o[4] <= f[4] and f[5] <= o[5] for o in found)]
    name, variant, coverage, matched, first, last = min(found, key=lambda f: (-f[2], -f[3], f[0], f[1]))
    return name, variant, coverage, matched, first, last, len({f[0] for f in found})


def _tells(pairs: list[tuple[int, int]], places: list[int], telling) -> bool:
    """Each phrase is aligned somewhere with words that follow one another in the text."""
    place = {y: places[x] for x, y in pairs}
    return all(any(y in place and all(place.get(y + d) == place[y] + d for d in range(len(phrase))) for y in at) for phrase, at in telling)


def _local(words: list[int], places: list[int], template: list[int], telling, need: int):
    """Alignments with the surroundings of each telling phrase, and with windows of twice the template's length and of twice
    its widest span, that step by half: words far away cannot lead these astray, and a match that lies close is whole in some window."""
    length = len(template)
    windows = {((x // n + d) * n, (x // n + d + 2) * n) for n in (length, SPREAD * length) for x in places for d in (-1, 0)}
    for phrase, _ in telling[:1]:
        m = len(phrase)
        for i in range(len(words) - m + 1):
            if words[i] == phrase[0] and words[i: i + m] == phrase and places[i + m - 1] == places[i] + m - 1:
                windows.add((places[i] - 2 * length, places[i] + m + 2 * length))
    for lo, hi in sorted(windows):
        a, b = bisect_left(places, lo), bisect_left(places, hi)
        if b - a >= need:
            yield [(a + x, y) for x, y in aligned(words[a:b], template)]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment: anchors are words unique on both sides; the longest increasing run of them is kept, gaps are aligned
    likewise. Equal ends are taken first; a gap without anchors gets a longest common subsequence."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, a0, a1, b, b0, b1)
        if not anchors:
            out += _longest(a, a0, a1, b, b0, b1)
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:]) if x + 1 < u and y + 1 < v]
    return sorted(out)


def _anchors(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    counts: dict[int, list[int]] = {}
    for side, (s, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
        for i in range(lo, hi):
            c = counts.setdefault(s[i], [0, 0, 0, 0])
            c[side] += 1
            c[2 + side] = i
    pairs = sorted((c[2], c[3]) for c in counts.values() if c[0] == c[1] == 1)
    # longest increasing subsequence of the second places, by piles
    tops, chain, back = [], [], []
    for x, y in pairs:
        k = bisect_left(tops, y)
        back.append(chain[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            chain.append(len(back) - 1)
        else:
            tops[k], chain[k] = y, len(back) - 1
    out, i = [], chain[-1] if chain else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _longest(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """Where every common word repeats: a longest common subsequence, with a bit for each template word."""
    bits: dict[int, int] = {}
    for j in range(b0, b1):
        bits[b[j]] = bits.get(b[j], 0) | 1 << (j - b0)
    mask = (1 << (b1 - b0)) - 1
    at = [i for i in range(a0, a1) if a[i] in bits]
    rows = [mask]  # a zero bit: the subsequence grows at this template word
    for i in at:
        v = rows[-1]
        u = v & bits[a[i]]
        rows.append(((v + u) | (v - u)) & mask)
    out, i, j = [], len(at), b1 - b0
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((at[i], b0 + j))
    return out[::-1]
