from __future__ import annotations

import random
import re

import pytest

from shotledger.llm import jaccard

DOCS = "doc_id long, text string, n_shingles string, token string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else set(zip(*(words[k:] for k in range(5))))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = [i for i, _ in rows]
    change = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while change:
        change = False
        for i, j in links:
            ends = [x for x in (label[i], label[j]) if x is not None]
            low = min(ends) if ends else None
            for k in (i, j):
                if label[k] != low:
                    label[k], change = low, True
    return sorted(((rows[k][0], len(sets[k]), label[k]) for k in range(len(rows))), key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    return sorted((tuple(r) for r in jaccard.classes(docs).collect()), key=repr)


def test_family_of_edited_copies(spark):
    pick = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    base = [pick.choice(words) for _ in range(120)]
    rows = []
    for k in range(160):
        own = list(base)
        for _ in range(pick.choice([0, 1, 2, 4, 6, 9])):
            own[pick.randrange(len(own))] = f"e{pick.randrange(10**6)}"
        rows.append((k * 3, " ".join(own[: pick.choice([120, 120, 110, 100])])))
    rows += [(1000 + k, " ".join(pick.choice(words) for _ in range(60)) + " " + " ".join(base[:30])) for k in range(60)]
    rows += [(2000 + k, rows[5][1].upper().replace(" ", "\n\t")) for k in range(20)]
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"v{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (8, long), (9, long + " tail"), (10, "é É é É é"), (11, "É É é É é")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_one_per_class_keeps_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (5, "", 3)], "doc_id long, text string, node int")
    assert sorted(tuple(r) for r in jaccard.one_per_class(docs).collect()) == [(1, "a b c d e f", 2), (5, "", 3)]


def test_long_texts_are_hashed_in_pieces():
    text = "\n".join("word%d" % (k % 977) for k in range(300_000)) + " " + "x" * 2_000_000
    whole = jaccard.shingle_sets([text, "tail"])
    assert [len(s) for s in whole] == [len(shingles(text)), 1]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_number_of_shingles(n):
    assert len(jaccard.shingle_sets([" ".join("abcdef"[:n])])[0]) == (1 if n < 6 else 2)
