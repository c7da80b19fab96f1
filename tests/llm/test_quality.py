from __future__ import annotations

import re
from collections import Counter

import duckdb

from shotledger.llm import quality
from shotledger.llm.quality import Rules, judge_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The contract's counts, word by word."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


TEXTS = [
    None, "", " \n\t", "one two three", "a b c a b c a b c", "ä ö\x0bü\xa0x　y\x1cz", "same line.\nsame line.\nother\n\n", "x" * 300_000, "| a | b | c\n" * 40,
    "The quick brown fox jumps over the lazy dog. " * 20, " ".join(f"word{k}." for k in range(60)), "### $$$ %%% &&& <b>",
]


def test_counts():
    for t in TEXTS:
        assert judge_text(t, Rules())[:5] == base(t), repr(t)[:60]


def test_clean_prose_is_kept_and_junk_is_not():
    prose = "\n".join(" ".join(f"w{i}x{k}" for k in range(15)) + "." for i in range(10))
    assert judge_text(prose, Rules())[6]
    assert judge_text(prose + "\nAll rights reserved.", Rules())[6:9] == (True, 1, 18)
    assert not judge_text("\n".join(" | ".join(f"n{i}x{k}" for k in range(15)) for i in range(10)), Rules())[6]
    assert not judge_text("\n".join(" ".join(f"w{i}x{k}###" for k in range(15)) for i in range(10)), Rules())[6]


def test_rows_columns_and_oracle(spark):
    docs = spark.createDataFrame([(None if k == 3 else k, t, "n", "c") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words string, id string")
    rows = quality.judge(docs).drop("n_lost_lines", "lost_chars").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [[None if k == 3 else k, t] for k, t in enumerate(TEXTS)])
    assert sorted(map(tuple, rows), key=repr) == sorted(con.execute(quality.oracle_sql()).fetchall(), key=repr)


def test_clean_keeps_columns(spark):
    prose = "\n".join(" ".join(f"w{i}x{k}" for k in range(15)) + "." for i in range(10))
    docs = spark.createDataFrame([(1, prose + "\nAll rights reserved.", "en", 5, "z"), (2, "short", "en", 5, "z")], "doc_id long, text string, lang string, n_chars long, kept string")
    (row,) = quality.clean(docs).collect()
    assert row.asDict() == {"doc_id": 1, "text": prose, "lang": "en", "n_chars": len(prose), "kept": "z"}


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_paragraph_about_a_notice_is_text():
    ruling = "On Tuesday the court of appeal held that the firm had changed its privacy policy without telling those who had signed up before, and that a sentence hidden on the last page could not bind anyone who had never been asked; the judges sent the case back and told both sides to settle the costs between them before the end of spring."
    other = "The hearing had lasted nine days and heard more than forty witnesses from six countries in all."
    kept = judge_text(f"{ruling}\n{other}", Rules())
    assert len(ruling.split()) > 55 and kept[6] and kept[7] == 0
    for notice in ("All rights reserved.", "Wir verwenden Cookies. Mehr in der Datenschutzrichtlinie.", "This site uses cookies; by going on you accept the use of cookies, our privacy policy and our terms of use, which you can read at any time on the page that the link at the foot of each page leads to."):
        assert judge_text(f"{ruling}\n{other}\n{notice}", Rules())[7] == 1, notice
