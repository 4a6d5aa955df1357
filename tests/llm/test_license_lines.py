"""Licenses by heading, identifier and short line, and rules of several sentences against a plain matcher."""

import random
import re

from tidebar.llm import licenses

BSD = """Copyright (c) 1990 A Name. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by A Name.\n"
NAMES = "4. Neither the name of A Name nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def scan(text):
    s = licenses.Scanner()
    return [m[0] for m in s.match(s.sentences([text.casefold().encode()])[0])]


def test_lines():
    for text, want in [
        (BSD + ADVERTISING + NAMES, ["BSD-4-Clause"]),
        (BSD + NAMES, ["BSD-3-Clause"]),
        (BSD, ["BSD-2-Clause"]),
        ("This project is licensed under the MIT License - see the file.", ["MIT"]),
        ("// SPDX-License-Identifier: Apache-2.0\nint main", ["Apache-2.0"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: BSD-4-Clause", ["BSD-4-Clause"]),
        ("                                 Apache License\n                           Version 2.0, January 2004", ["Apache-2.0"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", ["GPL-3.0-only"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", ["GPL-2.0-only"]),
        ("it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["GPL-2.0-only"]),
        ("Copyright 2020. All rights reserved.", ["all-rights-reserved"]),
        ("All rights reserved. " + "word " * 60 + "SPDX-License-Identifier: MIT", ["all-rights-reserved", "MIT"]),
        ("the license version", []),
    ]:
        assert scan(text) == want, text


def plain(text):
    """Sentences word by word, then every rule at every place, all by search."""
    words = re.findall(r"[^\W_]+", text.casefold())
    known = {n: re.findall(r"[^\W_]+", s.casefold()) for n, s in licenses.SENTENCES.items()}
    found, at = [], 0
    while at < len(words):
        best = max((n for n, s in known.items() if words[at : at + len(s)] == s), key=lambda n: len(known[n]), default=None)
        if best:
            found.append((at, at + len(known[best]), best))
        at += len(known[best]) if best else 1
    related = lambda first: {s for _, q in licenses.RULES if q[0] == first for s in q}
    out, used = [], set()
    for k, (start, _, name) in enumerate(found):
        for license_id, sequence in [] if k in used else licenses.RULES:
            if sequence[0] != name:
                continue
            taken, need, gap, most = [k], list(sequence[1:]), 0, licenses.GAPS.get(license_id, licenses.GAP)
            for j in range(k + 1, len(found)):
                gap += found[j][0] - found[j - 1][1]
                if not need or gap > most:
                    break
                if found[j][2] == need[0]:
                    need.pop(0)
                elif found[j][2] not in related(name):
                    continue
                elif found[j][2] not in sequence[1 : len(sequence) - len(need)]:
                    break
                taken.append(j)
                gap = 0
            if not need:
                out.append((license_id, start, found[taken[-1]][1]))
                used.update(taken)
                break
    firsts = [a for n, a, _ in out if n != licenses.RESERVED]
    return [m for m in out if m[0] != licenses.RESERVED or not any(0 <= a - m[2] <= licenses.GAP for a in firsts)]


def test_sequences_equal_a_plain_matcher():
    rng, s = random.Random(3), licenses.Scanner()
    several = [q for _, q in licenses.RULES if len(q) > 1]
    hits = 0
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            for sentence in rng.choice(several):
                if rng.random() < 0.9:
                    parts.append(licenses.SENTENCES[sentence])
                if rng.random() < 0.2:
                    parts.append(licenses.SENTENCES[rng.choice(list(licenses.SENTENCES))])
                parts.append("filler " * rng.choice([0, 1, 5, 30, 70]))
        text = ". ".join(parts)
        got = s.match(s.sentences([text.casefold().encode()])[0])
        assert got == plain(text)
        hits += len(got)
    assert hits > 300
