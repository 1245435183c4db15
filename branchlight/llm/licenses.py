"""License scan by conditional compression.

A text is read as words, across lines, in lower case and without punctuation. At each word of licensing every notice that holds
such a word is laid over the text: the window is as many words as the notice has, so what surrounds it, however long, is no
part of any measure. The window is compressed alone and with the notice as a raw zstandard dictionary. At each such word the notices are ranked by
the size reduction; those that reach `least_gain` and `NEAR` of the best there are the winners, and only they are confirmed.

A winner is confirmed by exact wording: words of the notice and of the window, a fifth wider on each side, are aligned. The share of the notice's
words found decides, and the words that tell licenses apart must be the same on both sides: names, versions, Lesser, Affero, ShareAlike, later and
the like (TELLING), and no version and no word of CHANGING may follow within `BESIDE` words of the sentence. A notice behind a negation, or before words
that only a longer relative has (RIVALS), is none. So a relative without a template is reported as nothing, not as its neighbour.
Of notices that lie over the same words the one with the best wording is named alone.

Defined results: a null text has no window; a very long text is scanned whole; an empty table gives none; columns of documents of any name
are kept, but one named as the result is replaced; each row is judged by itself; ties go to the larger size reduction, then to the
notice that sorts first; a text may hold several licenses, each named once, sorted.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import free, session_ready, struct_of, table

#: Public license notices by SPDX name.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "AGPL-3.0-or-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "GPL-2.0-only": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    "LGPL-2.1-or-later": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0-or-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-1.1": ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/.',),
    "GPL-2.0-or-later": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-3.0-or-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
}
#: Parts of Creative Commons licenses and what they are called; versions and the word that goes with them.
_CC = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    for _version, _ported in (("3.0", "Unported"), ("4.0", "International")):
        _long = "-".join(_CC[p] for p in _parts.split("-"))
        NOTICES[f"CC-{_parts}-{_version}"] = (f"Licensed under CC {_parts} {_version}.", f"This work is licensed under a Creative Commons {_long} {_version} {_ported} License.")

#: Words of licensing; a text without any of these cannot hold a notice above.
TRIGGER = re.compile(r"licen[sc]e|permission|redistribution|free(?=[^a-z0-9]+software)|subject to", re.I)
#: Words that tell licenses apart; versions do so too (see telling()).
TELLING = frozenset("affero apache artistic boost bsd by cc cecill clause creative eclipse epl eupl gfdl gnu gpl isc later lesser lgpl agpl library mit mozilla mpl nc nd sa noncommercial noderivatives noderivs only public sharealike unlicense zlib advertising endorse".split())
#: Those that change a license when they stand behind its name.
CHANGING = frozenset("later only nc nd sa noncommercial noderivatives sharealike noderivs".split())
#: Words behind a notice that make it a longer one.
RIVALS = {"BSD-2-Clause": frozenset({"neither", "endorse", "advertising"})}
NEGATIONS = frozenset("not no never nor neither cannot isn aren wasn without unlike formerly".split())
LEAST_GAIN, LEAST_SHARE, LEVEL = 0.25, 0.8, 3
#: Winners reach this part of the best reduction at their place; words beside a match that are looked at; words behind it for RIVALS.
NEAR, BESIDE, BEHIND = 0.8, 4, 40
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_VERSION = re.compile(r"v?(\d+(?:\.\d+)+)")


def telling(words: list[str]) -> frozenset[str]:
    """Words that tell licenses apart: those of TELLING, dotted numbers, and numbers behind `version` or `v`; n and n.0 are one version."""
    parts = [p for w in words for p in w.split("-")]
    found = {p for p in parts if p in TELLING}
    for before, p in zip(["", *parts], parts, strict=False):
        dotted = _VERSION.fullmatch(p)
        if dotted or p.isdigit() and before in ("version", "v", "gpl", "lgpl", "agpl"):
            found.add((dotted[1] if dotted else p).removesuffix(".0"))
    return frozenset(found)


def sentences_of(text: str) -> tuple[list[str], list[int]]:
    """Words, and for each the number of its sentence."""
    words, sentence, end, low = [], [], 0, text.lower()
    for m in _WORD.finditer(low):
        begun = bool(words) and bool(re.search(r"[.!?;]\s|\n\s*\n", low[end : m.start()] + " "))
        sentence.append((sentence[-1] if sentence else 0) + begun)
        words.append(m[0])
        end = m.end()
    return words, sentence


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def anchors_of(words: list[str]) -> dict[str, list[int]]:
    """Places of words of licensing by kind."""
    found: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        kind = "license" if "license" in w or "licence" in w else w
        if kind in ("license", "permission", "redistribution") or (kind == "subject" and words[i + 1 : i + 2] == ["to"]) or (kind == "free" and words[i + 1 : i + 2] == ["software"]):
            found.setdefault(kind, []).append(i)
    return found


class Scanner:
    def __init__(self, notices: dict[str, tuple[str, ...]] = NOTICES):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.templates = []
        for name, forms in sorted(notices.items()):
            for wanted in map(words_of, forms):
                held = zstandard.ZstdCompressionDict(" ".join(wanted).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.templates.append((name, wanted, telling(wanted), anchors_of(wanted), zstandard.ZstdCompressor(level=LEVEL, dict_data=held)))

    def gain(self, window: list[str], template: int) -> float:
        """Size reduction by the template as a share of the window's size without."""
        data = " ".join(window).encode()
        alone = len(self.plain.compress(data))
        return (alone - len(self.templates[template][4].compress(data))) / alone

    def confirm(self, have: list[str], template: int) -> tuple[float, list[str], int, int, int, int]:
        """Share of the notice's words among these in order, the words that differ there, first and last place, and how many words of the notice stand
        before the first and behind the last."""
        wanted = self.templates[template][1]
        parts = SequenceMatcher(None, wanted, have, autojunk=False).get_opcodes()
        equal = [p for p in parts if p[0] == "equal"]
        inner = [p for p in parts if p[0] != "equal" and not (p[0] == "insert" and p[1] in (0, len(wanted)))]
        # At the notice's ends as many words of the window stand against its own, not all that surround it.
        inner = [(a, b, max(c, d - b + a) if a == 0 else c, min(d, c + b - a) if b == len(wanted) else d) for _, a, b, c, d in inner]
        differ = [w for a, b, c, d in inner for w in (*wanted[a:b], *have[c:d])]
        return sum(p[2] - p[1] for p in equal) / max(1, len(wanted)), differ, *((equal[0][3], equal[-1][4], equal[0][1], len(wanted) - equal[-1][2]) if equal else (0, 0, 0, 0))

    def told(self, words: list[str], sentence: list[int], a: int, b: int, template: int) -> bool:
        """Whether the words from a to b tell the template's license and no other, nothing before them denies it and nothing behind them changes it."""
        before = [words[i] for i in range(max(0, a - BESIDE), a) if sentence[i] == sentence[a]]
        behind = [words[i] for i in range(b, min(len(words), b + BESIDE)) if sentence[i] == sentence[b - 1]]
        name, _, mine = self.templates[template][:3]
        if NEGATIONS.intersection(before) or RIVALS.get(name, frozenset()).intersection(words[b : b + BEHIND]):
            return False
        changed = {w for w in telling(behind) if w in CHANGING or w[0].isdigit()}
        return telling(words[a:b]) == mine and changed <= mine

    def winners(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(template, start, size reduction) of windows that are among the best at one of their words of licensing."""
        anchors = anchors_of(words)
        laid: dict[tuple[int, int], float] = {}
        best: dict[int, float] = {}
        at: dict[tuple[int, int], list[int]] = {}
        for i, (_, wanted, _, own, _) in enumerate(self.templates):
            for kind, places in own.items():
                for p in anchors.get(kind, ()):
                    for t in places:
                        start = p - t
                        if (i, start) not in laid:
                            laid[i, start] = self.gain(words[max(0, start) : start + len(wanted)], i)
                        best[p] = max(best.get(p, 0.0), laid[i, start])
                        at.setdefault((i, start), []).append(p)
        return [(i, start, gain) for (i, start), gain in laid.items() if gain >= LEAST_GAIN and any(gain >= NEAR * best[p] for p in at[i, start])]

    def scan(self, text: str | None) -> list[tuple[str, float, float, int]]:
        """(license, size reduction, share of wording, words that differ) of each license found."""
        if not TRIGGER.search(text or ""):
            return []
        words, sentence = sentences_of(text)
        found = []
        for i, start, gain in self.winners(words):
            name, wanted = self.templates[i][:2]
            size, wider = len(wanted), max(2, len(wanted) // 5)
            first = max(0, start - wider)
            share, differ, a, b, lead, trail = self.confirm(words[first : start + size + wider], i)
            low, high = max(0, first + a - lead), min(len(words), first + b + trail)
            if share >= LEAST_SHARE and len(differ) <= max(2, (1 - LEAST_SHARE) * 2 * size) and self.told(words, sentence, low, high, i):
                found.append((-share, -gain, name, len(differ), first + a, first + b))
        # Near relatives of a notice that lie over the same words are not reported beside it.
        taken: list[tuple[str, int, int]] = []
        best: dict[str, tuple[float, float, int]] = {}
        for share, gain, name, differ, a, b in sorted(found):
            if not any(n != name and a < d and c < b for n, c, d in taken):
                taken.append((name, a, b))
                one = (round(-gain, 6), round(-share, 6), differ)
                best[name] = max(best.get(name, one), one)
        return sorted((k, *v) for k, v in best.items())


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def scan_licenses(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """docs with an array `into` of license, gain, share and n_differ."""
    session_ready(docs.sparkSession)

    @F.arrow_udf("struct<name:array<string>,gain:array<double>,share:array<double>,n_differ:array<bigint>>")
    def scanned(column: pa.Array) -> pa.Array:
        out = [list(zip(*_scanner().scan(t), strict=True)) or [()] * 4 for t in column.to_pylist()]
        kinds = {"name": pa.string(), "gain": pa.float64(), "share": pa.float64(), "n_differ": pa.int64()}
        return struct_of({k: (pa.list_(t), [list(x[i]) for x in out]) for i, (k, t) in enumerate(kinds.items())})

    held = free("found", docs)
    found = docs.drop(into).withColumn(held, scanned(F.col(text)))
    return found.withColumn(into, F.arrays_zip(*[F.col(held)[k].alias(k) for k in ("name", "gain", "share", "n_differ")])).drop(held)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.name", ",").alias("licenses"), F.array_max("licenses.gain").alias("best_gain"), F.array_max("licenses.share").alias("best_share"))
