"""Benchmark items of a few words against plain Python."""

import random

import pytest

from recspark.llm import decontaminate


def test_short_items_match_as_they_are(spark):
    draw = random.Random(8)
    items = [(k, " ".join(f"q{draw.randrange(12)}" for _ in range(1 + k % 4))) for k in range(16)]
    items += [(50, "Q1  q2"), (51, ""), (52, "  "), (53, None), (60, " ".join(f"z{k}" for k in range(20)))]
    docs = [(i, " ".join(draw.choice([f"q{draw.randrange(12)}", "of"]) for _ in range(draw.randint(0, 30)))) for i in range(60)]
    docs += [(100, "q3"), (101, items[3][1]), (102, "x " + " ".join(f"z{k}" for k in range(1, 20)))]
    docs += [(200 + k, f"of {items[k][1]} of") for k in range(16)]
    want = {}
    for i, t in docs:
        words = t.lower().split()
        for j, item in items:
            w = (item or "").lower().split()
            ends = [k + len(w) for k in range(len(words) - len(w) + 1) if words[k : k + len(w)] == w] if w else []
            if ends:
                want[i, j] = (0, min(ends), len(w))
    want[102, 60] = (1, 20, 20)
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["end_word"], r["item_words"]) for r in decontaminate.contaminated(frame, bench).collect()}
    assert {j for _, j in want} == {*range(16), 50, 60}
    assert got == want


@pytest.mark.parametrize("n", range(1, 5))
def test_short_items_allow_no_edit(n):
    assert decontaminate.allowed(n) == 0 and decontaminate.run_length(n, decontaminate.PERCENT) == min(n, 3)


def test_short_items_leave_the_walks_of_longer_ones_as_they_are():
    long = [(k, " ".join(f"a{k}b{i}" for i in range(20 + k))) for k in range(10)]
    short = [(100 + k, f"s{k}") for k in range(200)]
    assert decontaminate.prepare(long + short).walks == decontaminate.prepare(long).walks > decontaminate.prepare(short).walks == 1
