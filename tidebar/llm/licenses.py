"""License scans: known sentences are recognised, and their sequence is matched against ordered rules.

A sentence is known by the hashes of its normalised words (case folded, runs of
letters and digits), so line breaks and punctuation don't matter. The places of
known sentences give each text a sequence of sentence ids; a rule is an ordered
sequence of ids with at most ``GAP`` words (``GAPS`` for some licenses) between one
and the next. Known sentences of other licenses may lie between, and their words
don't count; so may repeats of the rule's own sentences but the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .textio import PLAIN, Words, sliced

GAP = 40
#: The MIT license has 47 words between its first two known sentences.
GAPS = {"MIT": 60}
# The known sentences.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "distributed under the License is distributed on an AS IS BASIS",
    "mit-short": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl-version-3": "either version 3 of the License, or (at your option) any later version",
    "gpl-version-2": "either version 2 of the License, or (at your option) any later version",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd-names": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "reserved": "All rights reserved",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS",
    "lgpl-free": "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "lgpl-version-2.1": "either version 2.1 of the License, or (at your option) any later version",
    "agpl-free": "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "gpl2-short": "licensed under the GNU General Public License, version 2",
    "gpl2-or-later-short": "licensed under the GNU General Public License, version 2 or later",
    "gpl3-or-later-short": "licensed under the GNU General Public License, version 3 or later",
    "lgpl2.1-short": "licensed under the GNU Lesser General Public License, version 2.1",
    "lgpl3-short": "licensed under the GNU Lesser General Public License, version 3",
    "agpl3-short": "licensed under the GNU Affero General Public License, version 3",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "epl-1": "made available under the terms of the Eclipse Public License v1.0",
    "epl-2": "made available under the terms of the Eclipse Public License 2.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-notice": "provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
    "zlib-as-is": "This software is provided as-is, without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "boost-short": "Distributed under the Boost Software License, Version 1.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "cc0-short": "licensed under CC0 1.0",
    "cc0-waived": "has waived all copyright and related or neighboring rights",
    "cc-by-3": "Licensed under CC BY 3.0",
    "cc-by-sa-3": "Licensed under CC BY-SA 3.0",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd-4": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-4-long": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-long": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4-long": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-4-long": "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa-4-long": "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-nd-4-long": "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "cc-by-3-long": "licensed under a Creative Commons Attribution 3.0 Unported License",
    "cc-by-sa-3-long": "licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "artistic-2": "under the terms of the Artistic License 2.0",
    "public-domain": "dedicated to the public domain",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "mit-licensed": "licensed under the MIT License",
    "mit-terms": "under the terms of the MIT license",
    "gpl-2-published": "version 2 as published by the Free Software Foundation",
    "gpl-2-published-terms": "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "apache-heading": "Apache License Version 2.0, January 2004",
    "gpl3-heading": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-heading": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl2.1-heading": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-heading": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-heading": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl2-heading": "Mozilla Public License Version 2.0",
    "epl2-heading": "Eclipse Public License - v 2.0",
}
# The ordered rules; the first rule that matches at a place wins.
RULES = [
    ("Apache-2.0", ("apache-short", "apache-use", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-short",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-version-3")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-version-2")),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("LGPL-3.0-or-later", ("lgpl-free", "gpl-version-3")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-version-2.1")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-version-3")),
    ("GPL-3.0-or-later", ("gpl3-or-later-short",)),
    ("GPL-2.0-or-later", ("gpl2-or-later-short",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("LGPL-2.1-only", ("lgpl2.1-short",)),
    ("LGPL-3.0-only", ("lgpl3-short",)),
    ("AGPL-3.0-only", ("agpl3-short",)),
    ("MPL-2.0", ("mpl-subject", "mpl-obtain")),
    ("MPL-2.0", ("mpl-subject",)),
    ("MPL-1.1", ("mpl-1.1",)),
    ("EPL-1.0", ("epl-1",)),
    ("EPL-2.0", ("epl-2",)),
    ("ISC", ("isc-grant", "isc-notice", "isc-as-is")),
    ("ISC", ("isc-grant", "isc-notice")),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin")),
    ("BSL-1.0", ("boost-short",)),
    ("Unlicense", ("unlicense-free",)),
    ("WTFPL", ("wtfpl",)),
    ("CC0-1.0", ("cc0-short",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("CC-BY-3.0", ("cc-by-3",)),
    ("CC-BY-SA-3.0", ("cc-by-sa-3",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC-BY-4.0", ("cc-by-4-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4-long",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4-long",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4-long",)),
    ("CC-BY-3.0", ("cc-by-3-long",)),
    ("CC-BY-SA-3.0", ("cc-by-sa-3-long",)),
    ("Artistic-2.0", ("artistic-2",)),
    ("public-domain", ("public-domain",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-terms",)),
    ("GPL-2.0-only", ("gpl-free", "gpl-2-published")),
    ("GPL-2.0-only", ("gpl-2-published-terms",)),
    ("Apache-2.0", ("apache-heading",)),
    ("GPL-3.0-only", ("gpl3-heading",)),
    ("GPL-2.0-only", ("gpl2-heading",)),
    ("LGPL-2.1-only", ("lgpl2.1-heading",)),
    ("LGPL-3.0-only", ("lgpl3-heading",)),
    ("AGPL-3.0-only", ("agpl3-heading",)),
    ("MPL-2.0", ("mpl2-heading",)),
    ("EPL-2.0", ("epl2-heading",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("all-rights-reserved", ("reserved",)),
]
RESERVED = "all-rights-reserved"
# A line that names a license by its identifier is a sentence of its own, for every license there is a rule for.
for _id in dict.fromkeys(n for n, _ in RULES if n not in (RESERVED, "public-domain")):
    SENTENCES[f"spdx-{_id}"] = f"SPDX-License-Identifier: {_id}"
    RULES.append((_id, (f"spdx-{_id}",)))
ANCHOR = 3


class Scanner:
    """Finds the known sentences of texts and matches the rules."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES):
        self.rules = rules
        self.family = {first: {s for _, other in rules if other[0] == first for s in other} for _, (first, *_) in rules}
        self.names = list(sentences)
        words = Words([s.casefold().encode() for s in sentences.values()], PLAIN)
        if (words.count < ANCHOR).any():
            raise ValueError(f"a known sentence has {ANCHOR} words or more")
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        anchors, first = words.grams(ANCHOR)
        self.anchor, self.sentence = np.unique(anchors[first[:-1]], return_inverse=True)

    def sentences(self, texts: list[bytes]) -> list[list[tuple[int, int, str]]]:
        """For each text the (first word, word after the last, sentence id), longest first at a place, none inside another."""
        words = Words(texts, PLAIN)
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        grams, first = words.grams(ANCHOR)
        if not len(grams):
            return found
        at = np.minimum(np.searchsorted(self.anchor, grams), len(self.anchor) - 1)
        for g in np.flatnonzero(self.anchor[at] == grams).tolist():
            text = int(np.searchsorted(first, g, side="right")) - 1
            begin = int(words.first[text] + g - first[text])
            known = [(len(self.words[k]), k) for k in np.flatnonzero(self.sentence == at[g]).tolist()]
            for n, k in sorted(known, reverse=True):
                if begin + n <= words.first[text + 1] and (words.hash[begin : begin + n] == self.words[k]).all():
                    a = begin - int(words.first[text])
                    if not found[text] or a >= found[text][-1][1]:
                        found[text].append((a, a + n, self.names[k]))
                    break
        return found

    def _follow(self, found: list[tuple[int, int, str]], k: int, sequence: tuple[str, ...], most: int) -> list[int] | None:
        """The places of a rule's sentences and of their repeats from ``k`` on, or None."""
        if found[k][2] != sequence[0]:
            return None
        places, done, gap = [k], 1, 0
        for j in range(k + 1, len(found)):
            if done == len(sequence):
                break
            gap += found[j][0] - found[j - 1][1]
            name = found[j][2]
            if gap > most:
                return None
            if name == sequence[done]:
                done += 1
            elif name not in self.family[sequence[0]]:
                continue
            elif name not in sequence[1:done]:
                return None
            places.append(j)
            gap = 0
        return places if done == len(sequence) else None

    def match(self, found: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
        """(license, first word, word after the last) of the rules that the sequence of sentences matches, by first word.

        Known sentences between those of a rule, which are no part of it, are matched on their own. Rights
        reserved at most ``GAP`` words before a license belong to its copyright line and say nothing else.
        """
        out, used = [], set()
        for k in range(len(found)):
            if k in used:
                continue
            for license_id, sequence in self.rules:
                places = self._follow(found, k, sequence, GAPS.get(license_id, GAP))
                if places:
                    out.append((license_id, found[k][0], found[places[-1]][1]))
                    used.update(places)
                    break
        starts = [a for n, a, _ in out if n != RESERVED]
        return [m for m in out if m[0] != RESERVED or not any(0 <= a - m[2] <= GAP for a in starts)]


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, matches array<struct<license, first_word, end_word>>, sentences array<string>) for every row, from its whole text.

    Null and empty texts have none. Repeated rows and null ids are kept; other
    columns are ignored; an empty table gives no rows.
    """
    scanner = Scanner()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [s for _, texts in sliced(batch["text"], fold=True) for s in scanner.sentences(texts)]
            matches = [[{"license": n, "first_word": a, "end_word": b} for n, a, b in scanner.match(s)] for s in found]
            yield pd.DataFrame({id_col: batch["id"], "matches": matches, "sentences": [[n for *_, n in s] for s in found]})

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInPandas(scan, f"`{id_col}` {kind}, matches array<struct<license:string,first_word:bigint,end_word:bigint>>, sentences array<string>")
