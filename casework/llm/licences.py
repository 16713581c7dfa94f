"""License scans: sparse TF-IDF cosine to templates, inherited down the directories.

Candidates are the lines of a text, and its windows of as many terms as a header,
a wrapped notice or a whole licence text has (the whole text, if it is shorter, but
for a licence text not below half of it), wherever lines break. Each is a sparse vector of its terms; its cosine to the
template decides which licence it names. Of candidates that overlap, a window of a
whole licence text goes before the headers inside it, then the larger cosine, then
a line. Document frequencies of the templates' terms are counted over all
documents; a term that no template has weighs as one that no document has (for a
line: no line template). A file most of whose terms stand in chosen candidates is
a licence file and speaks for its directory: files without a licence of their own
take that of the nearest ancestor directory that has one, found by joining the
distinct directories' ancestors, not by looking from each file.

Scale: texts stay in their tasks; only counts of the templates' terms (a bounded
vocabulary) reach the driver. A template whose terms in a text cannot reach the
cosine (Cauchy-Schwarz) is not looked for there, and windows are compared exactly only
where an upper bound of their cosine, from running sums, reaches it. Joins carry
paths, and a directory with a third of all files meets one row in a join that can be
split.

Defined results: a null or empty text has no licence of its own; a null path counts
as a file in the root; equal cosines go to the first template name; two licence
files in a directory: the larger cosine, then the first name; repeated rows get
repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.arrays import LOWER
from casework.session import cut_lineage

TERM = re.compile(rb"[0-9a-z]+")
LEAST_COSINE = 0.7
FILE_SHARE = 50  # per cent of a file's terms that stand in licence lines
SLACK = 1e-6  # bounds are taken a little lower than the cosine, for rounding

#: Short headers by licence.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
}


_GNU = (
    "This {kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
    "Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)
_WARRANTY = (
    " This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)


def _gnu(kind: str, name: str, version: str) -> tuple[str, str]:
    short = _GNU.format(kind=kind, name=name, version=version)
    return short, short + _WARRANTY.format(kind=kind, name=name)


#: Longer notices, and those of near relatives, so that these are not taken for a licence above.
NOTICES: Mapping[str, Sequence[str]] = {
    "AGPL-3.0": (*_gnu("program", "Affero General Public License", "3"), "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("SPDX-License-Identifier: BSD-2-Clause",),
    "CC-BY-NC-SA-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",),
    "CC-BY-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": (*_gnu("program", "General Public License", "2"), "SPDX-License-Identifier: GPL-2.0-or-later"),
    "GPL-3.0": _gnu("program", "General Public License", "3"),
    "LGPL-2.1": (*_gnu("library", "Lesser General Public License", "2.1"), "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "LGPL-3.0": (*_gnu("library", "Lesser General Public License", "3"), "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}


def whole_texts() -> dict[str, str]:
    """The full licence texts beside this file, by licence."""
    return {p.stem: p.read_text("utf-8") for p in sorted(Path(__file__).with_name("texts").glob("*.txt"))}


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.translate(LOWER))


def _known(*groups: Mapping[str, Sequence[str]]) -> set[bytes]:
    return {t for group in groups for texts in group.values() for text in texts for t in terms(text.encode())}


class Matcher:
    """Unit vectors of the templates over the weighted vocabulary."""

    def __init__(
        self,
        templates: Mapping[str, Sequence[str]],
        frequency: Mapping[str, int],
        documents: int,
        notices: Mapping[str, Sequence[str]] = NOTICES,
        whole: Mapping[str, str] | None = None,
    ):
        whole = whole_texts() if whole is None else whole
        weigh = lambda df: math.log((1 + documents) / (1 + df)) + 1
        self.unseen = weigh(0)
        words = sorted(_known(templates, notices, {name: [text] for name, text in whole.items()}))
        self.place = {t: i for i, t in enumerate(words)}
        self.wide = np.array([weigh(frequency.get(t.decode(), 0)) for t in words] + [self.unseen])
        self.weight = {t: self.wide[self.place[t]].item() for t in _known(templates)}
        every = [(name, text, False) for group in (templates, notices) for name in sorted(group) for text in group[name]]
        self.lines = sum(len(texts) for texts in templates.values())
        every += [(name, whole[name], True) for name in sorted(whole)]
        self.names = [name for name, _, _ in every]
        self.full = [full for _, _, full in every]
        self.sizes = []
        self.unit = np.zeros((len(words) + 1, len(every)))
        self.templates = []
        for n, (name, text, _) in enumerate(every):
            found = terms(text.encode())
            self.sizes.append(len(found))
            values = {t: c * self.wide[self.place[t]].item() for t, c in Counter(found).items()}
            norm = math.sqrt(sum(v * v for v in values.values()))
            template = {t: v / norm for t, v in values.items()}
            for t, v in template.items():
                self.unit[self.place[t], n] = v
            if n < self.lines:
                self.templates.append((name, template))
        self.mass = self.unit**2

    def line(self, found: list[bytes]) -> tuple[float, str | None]:
        """Largest cosine of a line's terms to a template, to six digits, and its name."""
        count = Counter(found)
        values = {t: n * self.weight.get(t, self.unseen) for t, n in count.items()}
        norm = math.sqrt(sum(v * v for v in values.values()))
        best, name = 0.0, None
        for candidate, template in self.templates:
            cosine = round(sum(v * template[t] for t, v in values.items() if t in template) / norm, 6)
            if cosine > best:
                best, name = cosine, candidate
        return best, name

    def windows(self, places: np.ndarray, which: int) -> Iterator[tuple[float, int, int]]:
        """(cosine, first term, end) of the windows that reach the cosine, the best of each run of windows."""
        if self.full[which] and 100 * len(places) < FILE_SHARE * self.sizes[which]:
            return  # a notice, not a whole licence text
        size = min(self.sizes[which], len(places))
        known = np.maximum(places, -1)  # negative places: terms that no template has, one for each
        weight = self.wide[known]
        sums = lambda x: (s := np.concatenate(([0.0], np.cumsum(x))))[size:] - s[:-size]
        dots = sums(weight * self.unit[known, which])
        # the squared norm is at least the sum of squared weights, as if no term came twice
        near = np.flatnonzero(dots >= (LEAST_COSINE - SLACK) * np.sqrt(np.maximum(sums(weight**2), 1e-9)))
        runs = np.split(near, np.flatnonzero(np.diff(near) > 1) + 1) if len(near) else []
        terms_, squares = places.tolist(), (self.wide**2).tolist()
        for run in runs:
            first, last = int(run[0]), int(run[-1])
            count = Counter(terms_[first : first + size])
            norm2 = sum(n * n * squares[t if t >= 0 else -1] for t, n in count.items())
            best: tuple[float, int] | None = None
            for at in range(first, last + 1):
                if at > first:
                    old, new = terms_[at - 1], terms_[at + size - 1]
                    norm2 -= (2 * count[old] - 1) * squares[old if old >= 0 else -1]
                    count[old] -= 1
                    norm2 += (2 * count[new] + 1) * squares[new if new >= 0 else -1]
                    count[new] += 1
                cosine = round(float(dots[at]) / math.sqrt(norm2), 6)
                if cosine >= LEAST_COSINE:
                    if best and at >= best[1] + size:  # beside the best so far
                        yield best[0], best[1], best[1] + size
                        best = None
                    if best is None or cosine > best[0]:
                        best = (cosine, at)
            if best:
                yield best[0], best[1], best[1] + size

    def text(self, text: str | None) -> tuple[str | None, float, int, int]:
        """Licence, cosine, terms in licence lines and windows, all terms."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
        found = TERM.findall(data)
        present = [self.place[t] for t in self.place.keys() & set(found)]
        # a vector reaches the cosine only if the template's terms in it hold that share of the template
        likely = np.flatnonzero(self.mass[present].sum(axis=0) >= (LEAST_COSINE - SLACK) ** 2).tolist() if present else []
        if not likely:
            return None, 0.0, 0, len(found)
        spans = []  # (not a whole text, -cosine, not a line, name, first, end)
        if likely[0] < self.lines:
            first = 0
            for line in data.split(b"\n"):
                own = TERM.findall(line)
                if not self.weight.keys().isdisjoint(own):  # no cosine without a template's term
                    cosine, name = self.line(own)
                    if cosine >= LEAST_COSINE:
                        spans.append((True, -cosine, False, name, first, first + len(own)))
                first += len(own)
        other: dict[bytes, int] = {}
        places = np.array([p if (p := self.place.get(t)) is not None else other.setdefault(t, -1 - len(other)) for t in found], np.int64)
        for n in likely:
            for cosine, first, end in self.windows(places, n):
                spans.append((not self.full[n], -cosine, True, self.names[n], first, end))
        inside = np.zeros(len(found), bool)
        best: tuple[float, str | None] = (0.0, None)
        for _, minus, _, name, first, end in sorted(spans):
            if not inside[first:end].any():
                inside[first:end] = True
                if -minus > best[0] or -minus == best[0] and name < best[1]:
                    best = (-minus, name)
        return best[1], best[0], int(inside.sum()), len(found)


def term_frequencies(texts: DataFrame, *groups: Mapping[str, Sequence[str]]) -> tuple[dict[str, int], int]:
    """In how many of all documents each template term occurs, and the number of documents."""
    known = _known(*groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                found = set(terms((text.as_py() or "").encode("utf-8", "surrogatepass")))
                count.update(t.decode() for t in known & found)
        count[""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["term", "n"])

    # one row per template term, however many documents there are
    sums = texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = {r.term: r.n for r in sums}
    return frequency, frequency.pop("", 0)


def parent(path: Column) -> Column:
    """The directory of a path; '' is the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan_licences(
    docs: DataFrame,
    path: Column,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    id_column: str = "doc_id",
    text_column: str = "text",
    notices: Mapping[str, Sequence[str]] = NOTICES,
    whole: Mapping[str, str] | None = None,
) -> DataFrame:
    """doc_id, path, own_licence, cosine, licence_file, licence, inherited_from of every row."""
    texts = docs.select(F.col(text_column).cast("string").alias("text"))
    whole = whole_texts() if whole is None else whole
    counts = term_frequencies(texts, templates, notices, {name: [text] for name, text in whole.items()})
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(templates, *counts, notices, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [matcher.value.text(t.as_py()) for t in batch.column(2)]
            name, cosine, inside, total = zip(*rows) if rows else ((), (), (), ())
            is_file = [n is not None and 100 * i >= FILE_SHARE * t for n, i, t in zip(name, inside, total)]
            arrays = [batch.column(0), batch.column(1), pa.array(name, pa.string()), pa.array(cosine, pa.float64()), pa.array(is_file, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "path", "own_licence", "cosine", "licence_file"])

    picked = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.col(text_column).cast("string").alias("text"),
    )
    files = picked.mapInArrow(run, "doc_id long, path string, own_licence string, cosine double, licence_file boolean")
    files = cut_lineage(files.withColumn("dir", parent(F.col("path"))), "licence-files")
    spoken = files.where("licence_file").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own_licence")).alias("best"))
    spoken = cut_lineage(spoken.select(F.col("dir").alias("ancestor"), F.col("best.own_licence").alias("dir_licence")), "licence-dirs")
    # the directory itself, its parents and the root, with their depth
    parts = F.split("dir", "/")
    depths = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    ancestors = files.select("dir").distinct().select("dir", F.explode(depths).alias("depth"))
    ancestors = ancestors.withColumn("ancestor", F.concat_ws("/", F.slice(F.split("dir", "/"), F.lit(1), F.col("depth"))))
    nearest = (
        ancestors.join(spoken, "ancestor")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "ancestor", "dir_licence")).alias("near"))
    )
    nearest = cut_lineage(nearest.select("dir", "near.ancestor", "near.dir_licence"), "licence-nearest")
    joined = files.join(nearest, "dir", "left")
    return joined.select(
        "doc_id",
        "path",
        "own_licence",
        "cosine",
        "licence_file",
        F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("ancestor")).alias("inherited_from"),
    )
