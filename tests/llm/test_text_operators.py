import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import chat, decontaminate, graph, licenses, ngram_join, packing, pii, quality, rules, tokencount, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "   ", "a", "x" * 9000, "it's 'sx <|endoftext|> é É ß 5's", "naïve 日本語 \x1c z", "The The the\nThe The the\n", "one two three four"]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(1, "", 1), (None, "a b c", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int")


def library(spark):
    return tokencount.transducer(tokencount.vocabulary_path()).library


def test_token_counts_equal_the_library(spark, docs, odd):
    for df in (docs, odd, odd.limit(0)):
        got = tokencount.count_tokens(df, tokencount.vocabulary_path()).collect()
        texts = sorted((r.text or "" for r in df.collect()))
        want = [(len(t.encode()), len(e)) for t, e in zip(texts, library(spark).encode_batch(texts, add_special_tokens=False), strict=True)]
        assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted(want)


def test_transducer_on_random_text():
    random.seed(4)
    m = tokencount.transducer(tokencount.vocabulary_path())
    texts = ["".join(random.choice("abst'relv1 !.#éÉ<|\n") for _ in range(50)) for _ in range(500)]
    assert m.count([t.encode() for t in texts]).tolist() == [len(e) for e in m.library.encode_batch(texts, add_special_tokens=False)]


def test_packing_holds_every_id_once(spark, docs, odd):
    for df in (docs, odd):
        rows = packing.pack_documents(df.where("doc_id is not null").dropDuplicates(["doc_id"]), tokencount.vocabulary_path(), with_ids=True).collect()
        texts = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
        by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
            by_seq[r.sequence_id].append(r)
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        for d, text in texts.items():
            pieces = sorted(by_doc[d], key=lambda r: r.start)
            assert [i for r in pieces for i in r.ids] == [*library(spark).encode(text, add_special_tokens=False).ids, 2]
            assert all(r.doc_tokens == sum(p.length for p in pieces) for r in pieces)
        total = padding = 0
        for pieces in by_seq.values():
            pieces.sort(key=lambda r: r.offset)
            n = sum(r.length for r in pieces)
            assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))] and n <= 4096
            total, padding = total + n, padding + (0 if n & (n - 1) == 0 else 4096 - n)
        assert padding <= 0.02 * total


def test_best_cuts_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 9, 14))]))
        cost = rng.integers(0, 4, len(at)).astype(float)
        f = [0.0] + [np.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= 16:
                    f[j] = min(f[j], f[i] + cost[j] + (0 if n & (n - 1) == 0 else 16 - n))
        cuts = packing.best_cuts(at, cost, 16)
        got = sum(cost[j] + (0 if (n := int(at[j] - at[i])) & (n - 1) == 0 else 16 - n) for i, j in zip(cuts, cuts[1:], strict=False))
        assert got == f[-1]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, docs):
    extra = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)] + [(10_100, "one Two three four")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    got = {tuple(r) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_components([tuple(r) for r in df.collect()])
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_blocks_lose_no_link(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)
    text = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(k, f"{text} {'x ' * (k % 4)}end{k}") for k in range(25)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.near_duplicates(df).collect()} == {0}


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 60), (60, 55)], "a long, b long")
    got = dict(tuple(r) for r in graph.connected_components(chain).collect())
    assert got == {k: 0 for k in range(21)} | {50: 50, 55: 50, 60: 50}


def test_rules_equal_brute_force(spark, docs, labels, odd):
    for df in (docs, odd):
        for r in rules.apply_rules(df.select("doc_id", "text"), rules.trusted_ids(labels)).collect():
            text = r.text or ""
            w = WORD.findall(text)
            seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            repeated = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
            lines = [x for x in text.split("\n") if WORD.search(x)]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
            assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert rules.apply_rules(docs, rules.trusted_ids(spark.createDataFrame([], LABELS))).where("not base_failed and not kept").count() == 0


def test_pii(spark, odd):
    text = "mail a.b@c.de, ip 10.0.0.255 not 300.1.1.1, card 4111 1111 1111 1111, call +1 (415) 555-0100, bank GB82 WEST 1234 5698 7654 32"
    kinds = [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text)]
    assert ("email", "a.b@c.de") in kinds and ("ip", "10.0.0.255") in kinds and ("card", "4111 1111 1111 1111") in kinds
    assert ("phone", "+1 (415) 555-0100") in kinds and ("iban", "GB82 WEST 1234 5698 7654 32") in kinds
    assert "@" not in pii.mask(text, pii.find_spans(text)) and len([k for k, _ in kinds if k == "ip"]) == 1
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    random.seed(1)
    for _ in range(3000):
        t = "".join(random.choice("a.@-+ b1") for _ in range(25))
        assert pii._emails(t) == [(m.start(), m.end()) for m in pattern.finditer(t)]
    got = pii.span_digest(pii.scan_pii(odd)).collect()
    assert len(got) == odd.count() and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.mask_pii(odd).where("text is null").count() == 1


def test_decontamination(spark, docs):
    item = " ".join(f"token{k}" for k in range(30))
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    words = item.split()
    words[5], words[12] = "other", "more"
    rows = [(0, f"before {item.upper()} after"), (1, "x " + " ".join(words)), (2, " ".join(item.split()[:8])), (3, None), (4, "too short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [i["item"] for i in r["items"]] for r in decontaminate.find_contamination(df, bench).collect()}
    assert got == {0: [7], 1: [7], 2: [], 3: [], 4: [9]}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench, max_index=8).collect()) == [2, 3]
    longer = decontaminate.find_contamination(df, bench, min_tokens=3)  # only a parameter leaves short items out
    assert [r.doc_id for r in longer.where("size(items) > 0").orderBy("doc_id").collect()] == [0, 1]


def test_licenses():
    s = licenses.Scanner()
    scan = lambda t: [m[0] for m in s.match(s.sentences([t.casefold().encode()])[0])]
    assert scan("x.\nLicensed under the Apache\nLicense, version 2.0.") == ["Apache-2.0"]
    mit = "\n".join(licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is"))
    assert scan(mit) == ["MIT"] and scan(licenses.SENTENCES["mit-notice"]) == []
    assert scan("Licensed under CC BY-NC 4.0. All rights reserved.") == ["CC-BY-NC-4.0", "all-rights-reserved"] and scan("") == []


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\</s>", "<|turn|>user<|say|>x</s>", "a\\\\b", ""]
    for text in hard:
        assert [(r, t) for r, t, *_ in chat.read_turns(chat.format_turn("user", text))] == [("user", text)]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)] + [(2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(chat.canonical_turns(df))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:-1]).encode()).hexdigest()
    loss = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (6, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].n_turns == 1 and got[2].loss_chars == 0


def test_layouts(spark):
    records = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "response": "a"}, {"instruction": "q", "input": "", "output": "a"}]
    for r in records:
        assert chat.turns_of(r) == [("user", "q"), ("assistant", "a")]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(9, "{"), (10, '{"z": 1}')], "id long, j string")
    got = chat.turns_from_json(df, "id", "j").collect()
    assert len(got) == 10 and {r.id for r in got if r.turn < 0} == {9, 10}
    table = spark.createDataFrame([(1, "q", "a", 0)], "conv_id long, question string, answer string, more int")
    assert [(r.turn, r.role, r.text) for r in chat.canonical_turns(table).orderBy("turn").collect()] == [(0, "user", "q"), (1, "assistant", "a")]


def test_classifiers_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    got = quality.score_quality(some, quality.train_quality(docs, labels)).join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert got > 0.97
    scored = toxicity.score_toxicity(some, toxicity.train_toxicity(docs, labels)).withColumnRenamed("toxic", "found").join(labels, "doc_id")
    hit = scored.agg(F.avg(F.when(F.col("toxic") == 1, F.col("found").cast("int"))), F.avg(F.when(F.col("found"), F.col("toxic")))).first()
    assert hit[0] > 0.8 and hit[1] > 0.9


def test_classifiers_without_labels(spark, odd):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.score_quality(odd, quality.train_quality(odd, none)).collect()} == {0.5}
    assert toxicity.score_toxicity(odd, toxicity.train_toxicity(odd, none)).count() == odd.count()


def test_seeds_lose_no_window():
    for n in range(1, decontaminate.WINDOW + 1):
        equal = max(1, math.ceil(decontaminate.SHARE * n))
        masks = [sum(1 << (at + k) for k, c in enumerate(seed) if c == "1") for seed in decontaminate.seeds_for(n, equal) for at in range(n - len(seed) + 1)]
        for gone in range(n - equal + 1):
            for places in itertools.combinations(range(n), gone):
                lost = sum(1 << k for k in places)
                assert any(not m & lost for m in masks), (n, places)


def test_decontamination_of_short_changed_and_unspaced_items():
    random.seed(3)
    for n in (*range(3, 17), 20, 40):
        item = [f"i{n}w{k}" for k in range(n)]
        index = decontaminate.Index([(0, " ".join(item))])
        need = min(n, decontaminate.WINDOW)
        for _ in range(60):
            at = random.randrange(n - need + 1)
            places = random.sample(range(at, at + need), need - math.ceil(decontaminate.SHARE * need))
            words = [w if at <= k < at + need and k not in places else f"other{k}" for k, w in enumerate(item)]
            assert [i for _, i, *_ in index.search(["a b".encode(), f"x {' '.join(words)} y".encode()])] == [0], (n, at, places)
    index = decontaminate.Index([(5, "今日は天気がいいですね。散歩に行きましょう")])
    changed = decontaminate.spaced("前の文。今日は天気が悪いですね、散歩に行きましょう！後の文").encode()
    assert [i for _, i, *_ in index.search([changed, decontaminate.spaced("全く別の文章です").encode()])] == [0]


FULL = {
    "MIT": """MIT License. Copyright (c) 2020 A Name
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
}
FULL["BSD-3-Clause"] = FULL["BSD-2-Clause"] + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


FREE = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
FULL |= {
    "LGPL-2.1-or-later": FREE.format("library", "Lesser", "2.1"),
    "LGPL-3.0-or-later": FREE.format("library", "Lesser", "3"),
    "AGPL-3.0-or-later": FREE.format("program", "Affero", "3"),
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
}


def test_licenses_verbatim_and_with_others_between():
    s = licenses.Scanner()
    scan = lambda t: [m[0] for m in s.match(s.sentences([t.casefold().encode()])[0])]
    short = {n: licenses.SENTENCES[q[0]] for n, q in licenses.RULES if len(q) == 1 and n not in FULL}
    assert set(FULL) | set(short) == {n for n, _ in licenses.RULES}
    for name, text in (FULL | short).items():
        assert scan(f"Some text.\n{text}\nMore text.") == [name], name
    for name, text in FULL.items():
        parts = s.sentences([text.casefold().encode()])[0]
        words = re.findall(r"[^\W_]+", text)
        cut = parts[0][1]
        assert scan(" ".join([*words[:cut], "All rights reserved.", *words[cut:]])) == [name, "all-rights-reserved"]
    assert scan(FULL["GPL-2.0-or-later"] + FULL["GPL-3.0-or-later"]) == ["GPL-2.0-or-later", "GPL-3.0-or-later"]
    assert scan(FULL["MIT"].replace("The above", "word " * 80 + "The above")) == []


def test_ibans_before_other_words_and_with_a_last_group_of_one():
    def printed(text):
        return [text[a:b] for k, a, b, _ in pii.find_spans(text) if k == "iban"]

    for number, after in [
        ("DE89 3704 0044 0532 0130 00", " EUR"),
        ("DE89 3704 0044 0532 0130 00", " BIC COBADEFF"),
        ("DE89370400440532013000", " BY 2024"),
        ("CH93 0076 2011 6238 5295 7", " and more"),
        ("CH93 0076 2011 6238 5295 7", " A 1"),
        ("LV80 BANK 0000 4351 9500 1", "."),
        ("NO93 8601 1117 947", ""),
        ("MT84 MALT 0110 0001 2345 MTLC AST0 01S", ", BIC"),
    ]:
        assert printed(f"to {number}{after}") == [number], number
        assert number not in pii.mask(f"to {number}{after}", pii.find_spans(f"to {number}{after}"))
    assert printed("RF12 AB34 DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432") == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert printed("DE89 3704 0044 0532 0130 01, DE89370400440532013000X, DE89 3704 0044") == []


def test_rules_of_texts_with_more_windows_than_place_bits(spark, labels, monkeypatch):
    monkeypatch.setattr(rules, "_PLACE_BITS", 4)
    random.seed(9)
    texts = [" ".join(random.choice("abcdefg") for _ in range(n)) for n in (*range(14, 24), 60, 300)]
    texts += [" ".join(f"w{k % 40}" for k in range(80)), " ".join(f"w{k}" for k in range(80)), " ".join(f"w{k % 79}" for k in range(81))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.apply_rules(df, rules.trusted_ids(labels)).collect():
        w = r.text.split()
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert r.n_repeat_words == len(repeated) and r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def test_rules_see_whole_words_and_all_labels(spark):
    good = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert rules.trusted_ids(good).count() == 9000
    random.seed(5)
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join(random.choice(words) for _ in range(200)) for _ in range(60)]
    junk = [" ".join("#" + w for w in texts[0].split()), " ".join(w[:2] + "|" + w[2:] for w in texts[1].split())]
    df = spark.createDataFrame(list(enumerate(texts + junk)), "doc_id long, text string")
    got = {r.doc_id: r for r in rules.apply_rules(df, rules.trusted_ids(good.where("doc_id < 60"))).collect()}
    assert all(got[k].kept for k in range(60)) and not got[60].kept and not got[61].kept


def test_keep_one_of_repeated_rows_and_classes_of_one_id(spark):
    base = [f"w{k}" for k in range(60)]
    other = [f"v{k}" for k in range(60)]
    text = lambda words, end: " ".join([*words, end])
    rows = [(5, text(base, "a")), (5, text(base, "a")), (7, text(base, "b")), (None, text(base, "c")), (None, text(base, "c")), (3, text(other, "a")), (3, text(base[:30] * 2, "z")), (4, text(base[:30] * 2, "y")), (9, text(other, "q")), (None, "alone as it is"), (1, ""), (1, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and sets[b] and (100 * same >= 80 * both or rows[a][0] is not None and rows[a][0] == rows[b][0]):
                root = [root[b] if r == root[a] else r for r in root]
    want = [min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in sorted(set(root))]
    got = [r.doc_id for r in ngram_join.keep_one(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
