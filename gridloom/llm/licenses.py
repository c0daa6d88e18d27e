"""License scans: TF-IDF cosine to templates, then inheritance down the path tree.

A file's candidate parts are its whole text, if it holds a cue word or its name
is a licence file's, and its header lines: lines that hold a cue word, alone, in
windows of up to four lines, sentence by sentence, and as whole paragraphs, so
that comment signs, wraps and neighbours do not matter. A part becomes a sparse
TF-IDF vector over the templates' vocabulary plus one slot for all other words
(so that foreign text lowers the cosine); inverse document frequencies come from
counts over all files. Templates are header forms, titles and the full texts in
``license_texts``. The licence of the template of the largest cosine is the
file's own if the cosine reaches ``threshold``; a short part that names other
versions than a template does not match it, and a bare reservation of rights
counts only where no other licence does. SPDX tags are read as identifiers. A
file is a licence file by its name, or by a whole text that reaches the threshold.
A file without a licence inherits from the nearest ancestor directory
that has a licence file: every file's ancestors are joined by path to the
directories' licences, and the deepest match wins.

Scale. Templates are few and fixed, and travel in the closure. Scanning is one
narrow pass; document frequencies are one row a vocabulary word and task. The
inheritance joins (path, directory) rows only, one a level of the path; a
directory's licences are reduced to one row before the join, so a directory
with a third of all files joins as one row. Texts are never shuffled.

Cases. Null or empty text has no licence of its own and may inherit. A null
path inherits nothing. Ties go to the template first in name order; of several
licence files in one directory the one of the largest cosine counts, then the
name that is first. Repeated rows are answered each. Empty tables give no rows.
Extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._run import map_arrow, sized, written


def _cc(short: str, long: str) -> tuple[str, ...]:
    return (
        f"Licensed under CC {short} 4.0.",
        f"This work is licensed under a Creative Commons {long} 4.0 International License.",
        f"Creative Commons {long} 4.0 International Public License",
    )


def _gnu(kind: str, version: str, date: str) -> tuple[str, ...]:
    name, terms = f"GNU {kind}General Public License", "it under the terms of the"
    start = f"This program is free software: you can redistribute it and/or modify {terms} {name} as published by the Free Software Foundation"
    return (
        f"This work is licensed under the {name}, version {version}.",
        f"Licensed under the {name} v{version}.",
        f"{start}, either version {version} of the License, or (at your option) any later version.",
        f"{start}, version {version} of the License.",
        f"{name} Version {version}, {date}",
    )


#: Header forms and openings of well-known licences (fixed values), several forms to a licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": (),
    "AGPL-3.0": _gnu("Affero ", "3", "19 November 2007"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "BSD-2-Clause": ("Use of this source code is governed by a BSD 2-Clause license.",),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD 3-Clause license.",
        "Use of this source code is governed by a BSD-style license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    ),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ("Licensed under CC0 1.0 Universal.",),
    "GPL-2.0": _gnu("", "2", "June 1991"),
    "GPL-3.0": _gnu("", "3", "29 June 2007"),
    "ISC": ("Released under the ISC License.",),
    "LGPL-2.1": _gnu("Lesser ", "2.1", "February 1999"),
    "LGPL-3.0": _gnu("Lesser ", "3", "29 June 2007"),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": ("All rights reserved.", "Copyright (c). All rights reserved.", "No part may be reproduced without permission."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
for _text in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):  # full texts, without holders
    TEMPLATES[_text.stem] += (_text.read_text(encoding="utf-8"),)
#: Notices that stand beside other licences too: they count only where no other licence reaches the threshold.
WEAK = frozenset({"Proprietary"})
_CUE = re.compile(r"licen[sc]e|copyright|spdx|redistribution|rights reserved|public domain|permission is hereby|permission to use", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|,\s+(?=all rights)", re.IGNORECASE)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.IGNORECASE)
_SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")
_VERSION = re.compile(r"\bv(?=[0-9])|(?<=[0-9])\.0\b(?!\.[0-9])", re.IGNORECASE)
_WORDY = re.compile(r"[^\W_]")
_NUMBER = re.compile(r"[0-9]{1,2}(?:\.[0-9]+)*$")
#: Words of a part up to which versions must agree, and lines of a window.
_SHORT, _LINES = 60, 4
_FILE = re.compile(r"(?:^|/)(?:licen[sc]e|copying|notice)[^/]*$", re.IGNORECASE)


def tokens(text: str) -> list[str]:
    """Words and numbers; v3, 3 and 3.0 are one."""
    return _TOKEN.findall(_VERSION.sub("", text.lower()))


def versions(words: Iterable[str]) -> frozenset[str]:
    """Numbers that may be versions (years are not)."""
    return frozenset(w for w in words if _NUMBER.match(w))


def tags(text: str) -> list[str]:
    """Identifiers of a text's SPDX tags, in lower case and without what they say of later versions."""
    found = [x.lower() for line in _SPDX.findall(text) for x in _SPDX_ID.findall(line)]
    return [x.removesuffix("-only").removesuffix("-or-later") for x in found]


def parts(text: str) -> Iterator[str]:
    """The header lines of a text: alone and in windows, their sentences, and the paragraphs they stand in."""
    if not _CUE.search(text):
        return
    lines = _SPDX.sub("", text).split("\n")
    cues = [i for i, line in enumerate(lines) if _CUE.search(line)]
    done = -1
    for i in cues:
        sentences = _SENTENCE.split(lines[i])
        if len(sentences) > 1:
            yield from filter(_CUE.search, sentences)
        for n in range(1, _LINES + 1):
            for a in range(max(i - n + 1, 0), min(i, len(lines) - n) + 1):
                yield " ".join(lines[a : a + n])
        if i <= done:
            continue
        a, z = i, i + 1
        while a > 0 and _WORDY.search(lines[a - 1]):
            a -= 1
        while z < len(lines) and _WORDY.search(lines[z]):
            z += 1
        done = z - 1
        if z - a > 1:
            paragraph = " ".join(x.strip(" \t*#/;-") for x in lines[a:z])
            yield paragraph
            yield from filter(_CUE.search, _SENTENCE.split(paragraph))


class Scanner:
    def __init__(self, templates: Mapping[str, Sequence[str]], idf: Mapping[str, float], rest: float, threshold: float):
        self.idf, self.rest, self.threshold = dict(idf), rest, threshold
        forms = [(n, form) for n in sorted(templates) for form in templates[n]]
        self.names = [n for n, _ in forms]
        self.known = {n.lower(): n for n in templates}
        self.versions = [versions(tokens(form)) for _, form in forms]
        self.index: dict[str, list[tuple[int, float]]] = {}
        for k, (_, form) in enumerate(forms):
            for t, x in self.vector(tokens(form)).items():
                self.index.setdefault(t, []).append((k, x))

    def vector(self, words: list[str]) -> dict[str, float]:
        tf = Counter(t if t in self.idf else "" for t in words)
        v = {t: (1 + math.log(n)) * self.idf.get(t, self.rest) for t, n in tf.items() if t}
        if tf[""]:  # foreign words are taken to be different from each other
            v[""] = math.sqrt(tf[""]) * self.rest
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    def cosines(self, text: str) -> Iterator[tuple[float, str]]:
        words = tokens(text)
        sums = [0.0] * len(self.names)
        for t, x in self.vector(words).items():
            for k, w in self.index.get(t, ()) if t else ():
                sums[k] += x * w
        said = versions(words) if len(words) <= _SHORT else frozenset()
        for k, c in enumerate(sums):
            if c > 0 and (not said or not self.versions[k] or said & self.versions[k]):
                yield c, self.names[k]

    def best(self, path: str | None, text: str) -> tuple[str | None, float, bool]:
        """Licence and cosine of the best part, and whether the whole text reaches the threshold."""
        found: dict[bool, tuple[float, str | None]] = {False: (0.0, None), True: (0.0, None)}
        for x in tags(text)[::-1]:  # of several the first
            if x in self.known:
                found[False] = (1.0, self.known[x])
        whole, seen = False, set()
        candidates = [text] if _CUE.search(text) or (path and _FILE.search(path)) else []
        for i, p in enumerate(chain(candidates, parts(text))):
            if p in seen:
                continue
            seen.add(p)
            for c, name in self.cosines(p):
                whole |= i == 0 and c >= self.threshold
                if c > found[name in WEAK][0] + 1e-12:
                    found[name in WEAK] = (c, name)
        strong, weak = found[False], found[True]
        c, name = strong if strong[0] >= min(self.threshold, weak[0]) else weak
        return name, c, whole


def document_frequencies(files: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Files that hold each word of the templates' vocabulary, and all files."""
    words = sorted(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        known = frozenset(words)
        for b in batches:
            n += b.num_rows
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(known.intersection(tokens(t)))
        yield pa.RecordBatch.from_arrays([pa.array(["", *counts]), pa.array([n, *counts.values()], pa.int64())], names=["w", "n"])

    got = map_arrow(files.select("text"), run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {r["w"]: r["n"] for r in got}  # one row a vocabulary word
    return found, found.pop("", 0)


def scan(files: DataFrame, templates: Mapping[str, str | Sequence[str]] = TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """id, path, own (licence or null), cosine, license (own or inherited) and inherited_from of (id, path, text) rows."""
    names = {n: (forms,) if isinstance(forms, str) else tuple(forms) for n, forms in templates.items()}
    vocabulary = {w for forms in names.values() for form in forms for w in tokens(form)}
    df, n = document_frequencies(files, vocabulary)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in sorted(vocabulary)}
    rest = math.log(n + 1) / 2 + 1
    kind = files.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(names, idf, rest, threshold)
        for b in batches:
            own, cos, is_file = [], [], []
            for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                name, c, whole = scanner.best(p, t) if t else (None, 0.0, False)
                own.append(name if c >= threshold else None)
                cos.append(round(c, 9))
                is_file.append(own[-1] is not None and (whole or bool(p and _FILE.search(p))))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("path"), pa.array(own, pa.string()), pa.array(cos, pa.float64()), pa.array(is_file, pa.bool_())],
                names=["id", "path", "own", "cosine", "is_file"],
            )

    own = written(map_arrow(files.select("id", "path", "text"), run, f"id {kind}, path string, own string, cosine double, is_file boolean"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")  # the root of relative paths is ""
    rank = F.struct((-F.col("cosine")).alias("c"), F.col("path").alias("p"), F.col("own").alias("o"))
    granted = own.filter("is_file and path is not null").groupBy(folder.alias("dir")).agg(F.min(rank).alias("best"))
    # every ancestor directory of the directories that hold files without a licence: one row a level, once each
    dirs = own.filter("own is null and path is not null").select(folder.alias("at")).distinct()
    pieces = F.split("at", "/")
    above = dirs.select("at", F.explode(F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(pieces, F.lit(1), k), "/").alias("dir")))).alias("u"))
    above = above.select("at", "u.depth", "u.dir").join(granted, "dir")
    # one row a directory: counted, and broadcast only if small, as no file with a licence of its own has a key
    nearest = above.groupBy("at").agg(F.max_by(F.struct("best.o", "dir"), "depth").alias("got")).select("at", F.col("got.o").alias("o"), F.col("got.dir").alias("from"))
    bare = own.filter("own is null").withColumn("at", folder).join(sized(written(nearest), 256), "at", "left").drop("at")
    none = F.lit(None).cast("string")
    out = bare.unionByName(own.filter("own is not null").withColumns({"o": none, "from": none}))
    return out.select("id", "path", "own", "cosine", F.coalesce("own", "o").alias("license"), F.when(F.col("own").isNull(), F.col("from")).alias("inherited_from"))
