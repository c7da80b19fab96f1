"""Every stage over a small table, each held against brute force on its own input."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shotledger.llm import quality, tokens
from tests.llm.test_jaccard import brute as jaccard_brute
from tests.llm.test_quality import base
from tests.llm.test_suffixes import brute_kept

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\v\f\r"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def cleaned(text):
    """The lines that stay, or None if the document is rejected: the rules once more, by characters and regular expressions."""
    text = text or ""
    n_words, chars, _, _, repeats = base(text)
    seen, left, lost = set(), [], 0
    for line in text.split("\n"):
        words = re.findall(f"[^{SPACES}]+", line)
        if not words:
            left.append(line)
            continue
        symbols = sum(c in "#*$%&|<>" for c in line)
        separators = sum(w in quality.SEPARATORS for w in words)
        ended = any(w.endswith(quality.END_MARKS) for w in words)
        notice = len(words) <= 20 * len(re.findall("|".join(quality.NOTICES), line, re.I))
        if line in seen or notice or symbols >= 3 and 100 * symbols >= 30 * len(words) or len(words) > 20 and not ended or separators >= 2 and 100 * separators >= 20 * len(words):
            lost += sum(map(len, words))
        else:
            left.append(line)
        seen.add(line)
    if n_words < 50 or 100 * repeats > 50 * n_words or 100 * lost > 40 * chars:
        return None
    return "\n".join(left)


def pieces(rows):
    whole = Tokenizer.from_file(tokens.default_paths()[0])
    found = Counter()
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        found.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return found


def run_stages(spark, docs):
    """What each stage gives, checked against brute force over what the one before gave."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_passages", "source_mixing", "best_fit_packing"]
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    text, out, frame = columns.index("text"), [], docs
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, frame, SF)
        frame = spark.createDataFrame(made.collect(), made.schema)
        out.append([tuple(r) for r in frame.collect()])
        if len(out) < 5:
            assert frame.columns == columns
    assert Counter((r[0], r[text]) for r in out[0]) == Counter((r[0], c) for r in rows if (c := cleaned(r[text])) is not None)

    left = [(r[0], r[text]) for r in out[0]]
    kept_ids = {i for i, _, c in jaccard_brute(left) if i == c}
    assert {r[0] for r in out[1]} == kept_ids and {(r[0], r[text]) for r in out[1]} <= set(left)

    before = [(r[0], r[text]) for r in out[1]]
    assert Counter((r[0], r[text]) for r in out[2]) == Counter((i, kept.decode(errors="ignore")) for (i, _), (_, kept) in zip(before, brute_kept(before)))

    times, ones = Counter((r[0], r[text]) for r in out[3]), Counter((r[0], r[text]) for r in out[2])
    assert all(n <= 3 * ones[k] for k, n in times.items())

    assert Counter(r[:5] for r in out[4]) == pieces([(r[0], r[text]) for r in out[3]])
    sequences = defaultdict(list)
    for r in out[4]:
        sequences[r[5]].append((r[6], r[3]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * -(-sum(r[3] for r in out[4]) // 1024) + 2
    return out


def test_stages(spark):
    out = run_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    assert all(out)


PROSE = [" ".join(f"s{k}w{i}" + "." * (i % 12 == 11) for i in range(120)) + "." for k in range(6)]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, PROSE[0], "en", "a", 9), (1, PROSE[0], "en", "a", 9), (2, PROSE[0].upper(), None, None, None), (None, PROSE[1], "en", None, 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, PROSE[2], "en", "b", 2), (5, PROSE[3], "en", "b", 2)]
    out = run_stages(spark, spark.createDataFrame(rows, COLUMNS))
    assert {r[0] for r in out[1]} == {1, None, 5}


CLASHING = "positions int, plan_id int, planned_row int, kept_id int, `row` int, number string, digest string, size int, spans string, text_ string, left_text string, rest string, KEEP_row int, copy int"


@pytest.mark.parametrize("unique", [True, False])
def test_columns_with_clashing_names(spark, unique):
    n = CLASHING.count(",") + 1
    kinds = [c.split()[1] for c in CLASHING.split(", ")]
    more = tuple(k if kinds[k] == "int" else str(k) for k in range(n))
    rows = [(k, PROSE[k % 6] if not unique else f"{k} " + PROSE[k % 6].replace("s", f"q{k}"), "en", "ab"[k % 2], k, *more) for k in range(12)]
    rows += [] if unique else [rows[0], (None, PROSE[1] + " x", None, None, None, *more), (None, None, None, None, None, *more)]
    frame = spark.createDataFrame(rows, f"{COLUMNS}, {CLASHING}")
    for name, stage in corpus_pipeline.STAGES:
        columns = frame.columns
        made = stage(spark, frame, SF)
        assert name == "best_fit_packing" or made.columns == columns
        got = made.collect()
        assert got and (name == "best_fit_packing" or all(tuple(r)[5:] == more for r in got))
        frame = spark.createDataFrame(got, made.schema)


@pytest.mark.parametrize("rows", [[], [(1, "too short", "en", "a", 9)], [(k, " ".join(f"long{k}x{i}." for i in range(9000)), "en", "a", 1) for k in range(3)]])
def test_run(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    assert (got.count() > 0) == (len(rows) > 1)
