from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict

import pytest

from shotledger.llm import filter_audit
from shotledger.llm.queries import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, part int, failed string, salt long, good int, own string"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    """Every order run over every document."""
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    fails, parts = [], defaultdict(list)
    for k, (i, text, lang) in enumerate(docs):
        x = text or ""
        w = WORD.findall(x)
        f = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", x)) > 3 * len(x),
            "D": bool(re.search(r"[#$%&*|]", x)),
            "E": i is not None and any(j is not None and j < i and (y or "") == x for j, y, _ in docs),
        }
        fails.append({c for c in f if f[c]})
        parts[lang or ""].append(k)
    out, shapley = {}, defaultdict(int)
    for part, rows in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = set(rows)
            for step, c in enumerate(order):
                gone = {k for k in left if c in fails[k]}
                redundant = sum(c in fails[k] for k in rows) - len(gone)
                left -= gone
                shapley[part, c] += len(gone)
                out[part, order, step + 1] = (len(left), len(gone), redundant, sum(fails[k] == {c} for k in rows), sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone))
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def run(spark, docs, labels):
    table = spark.createDataFrame([(*d, 1, "x", 7, 1, "y") for d in docs], DOCS)
    got = filter_audit.audit_documents(table, spark.createDataFrame([(*x, "z") for x in labels], LABELS)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(found) == len(got)
    return found


def test_against_every_order(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", long, long + " #", "Ab " * 300, long.upper(), "x" * 300_000, long, "a\x0bb\x1cc", "café Élan |", long]
    docs = [(i, t, [None, "", "en", "de"][i % 4]) for i, t in enumerate(texts * 3)]
    docs += [(5, long, "en"), (5, long, "en"), (None, long, "en"), (None, None, None), (40, "A", "fr"), (40, "A", "fr"), (2, "A", "fr")]
    labels = [(i, i % 2, (i % 3 == 0) * 1) for i in range(30)] + [(None, 1, 1), (3, None, 1), (4, 0, 0), (4, 1, None), (99, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert len(run(spark, [(1, "a", "en")], [])) == 600


def test_path_counts_and_limits(spark):
    forward, backward = filter_audit.path_counts(4)
    assert forward == [math.factorial(s.bit_count()) for s in range(16)] and backward == [math.factorial(4 - s.bit_count()) for s in range(16)]
    rows = spark.createDataFrame([("p", 3, True, False)] * 5 + [("p", 4, False, False)], "part string, failed int, good boolean, toxic boolean")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(rows, "XYZ").collect()}
    assert len(got) == 18 and got["XYZ", 1]["removed"] == 5 and got["XYZ", 2]["redundant"] == 5 and got["YXZ", 1]["shapley"] == 15 and got["ZXY", 1]["shapley"] == 6
    with pytest.raises(ValueError):
        filter_audit.audit(rows, "ABCDEFGH")


def test_has_sql():
    assert "op11_lattice_path_audit" in ORACLES
