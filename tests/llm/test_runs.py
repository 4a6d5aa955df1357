"""What the operators' work grows with: different runs, and steps of the plan."""

import random
import re

import pytest

from tidebar.llm import packing, rules, tokencount


def test_runs_are_looked_up_once_a_slice_and_their_ids_are_the_librarys(monkeypatch):
    encoder = packing.RunEncoder(tokencount.vocabulary_path())
    looked, made = [], packing.RunEncoder._made
    monkeypatch.setattr(packing.RunEncoder, "_made", lambda self, runs: looked.extend(runs) or made(self, runs))
    odd = ["--", "Don't", "«Äpfel»", "İSTANBUL", "H̱", "x" * 300, "a\xa0b\x85c", "<|endoftext|>", "(Straße),", "naïve!?", "µª", "\x1cq", "日本", "12.5%", "\U0001f600"]
    texts = ["", " \x0b ", *odd, " ".join(odd * 3), "\n" + "  ".join(odd) + "\t", "word " * 1000]
    for _ in range(2):
        ids, count = encoder.encode([t.encode() for t in texts])
        want = [[*encoder.library.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert len(looked) == len(set(looked)) and set(looked) == {*odd, "word", ""}
    encoder.cache |= {str(k): b"" for k in range(packing.MAX_CACHED_RUNS)}
    assert encoder.encode([b"word"])[1].tolist() == [len(want[-1]) // 1000 + 1] and len(encoder.cache) == 1


def test_ratios_are_no_column_of_the_rows(spark):
    docs = spark.range(2).selectExpr("id AS doc_id", "repeat('a b ', 9) AS text")
    judged = rules.apply_rules(docs, docs.select("doc_id"))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "AS n_repeat_words" in plan and not re.search(r" AS _r(atios|\d)#", plan)
    assert judged.count() == 2


@pytest.mark.parametrize("bits", [3, 20, 57, 60])
def test_repeats_with_any_number_of_low_bits(spark, monkeypatch, bits):
    """Few low bits: texts with more windows than they number. Few high bits: windows that share them and no more."""
    monkeypatch.setattr(rules, "_PLACE_BITS", bits)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    texts += [" ".join(map(str, range(n))) for n in (2, 3, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in rules.apply_rules(df, df.select("doc_id").limit(0)).collect()}
    for k, text in enumerate(texts):
        w = text.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert got[k] == len({i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)})
