"""Line-first cleaning: rules are judged per line, failing lines go, documents that lose too much text are rejected.

A word is a run of characters other than space and ``\\t \\n \\v \\f \\r``; a line is a piece between ``\\n``. A line with words
fails if one of these holds:

* punctuation: it has at least ``min_symbols`` of ``#*$%&|<>`` and at least ``symbol_pct`` per 100 words, or it has more than
  ``max_unended`` words and none of them ends in a sentence mark (a line that only breaks off in its last sentence stays);
* navigation: at least two of its words are separators (``| > » • ·``), and they make up ``separator_pct`` % of its words;
* boilerplate: it holds fixed notice phrases in one of four languages, one for each ``words_per_notice`` of its words (so a notice stands alone or crowds its line; a paragraph that speaks of
  one is text), or it repeats an earlier line of the document.

A document is rejected by the base rules (fewer than ``min_words`` words, or too many words in repeated three-word windows) or
if its failing lines hold more than ``max_lost_pct`` % of its word characters.

Defined results: a null or empty text has no words and fails the base rules; null ids pass through; repeated rows are
judged one by one; extra columns of the input are ignored by ``judge`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that end a sentence or a quoted or bracketed one.
END_MARKS = (".", "!", "?", "…", "\"", "”", "»", "'", "’", ")", ":", ";", "。", "！", "？")
#: Words that only separate navigation entries.
SEPARATORS = ("|", ">", "»", "•", "·")
#: Phrases of notices, as patterns that are matched without regard to case.
NOTICES = (
    "all rights reserved",
    "licensed under",
    "released under",
    "is licensed",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "use of cookies",
    "enable javascript",
    "javascript is disabled",
    "click here to",
    "subscribe to our",
    "sign up for our",
    # German
    "alle rechte vorbehalten",
    "lizenziert unter",
    "steht unter der lizenz",
    "nutzungsbedingungen",
    "datenschutzrichtlinie",
    "verwendet cookies",
    "verwendung von cookies",
    "aktivieren sie javascript",
    "newsletter abonnieren",
    # French
    "tous droits r",
    "sous licence",
    "conditions d.utilisation",
    "utilise des cookies",
    "activer javascript",
    "cliquez ici pour",
    "abonnez-vous",
    # Spanish
    "todos los derechos reservados",
    "bajo licencia",
    "bajo la licencia",
    "condiciones de uso",
    "aviso legal",
    "utiliza cookies",
    "haga clic",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_pct: int = 50
    min_symbols: int = 3
    symbol_pct: int = 30
    max_unended: int = 20
    separator_pct: int = 20
    words_per_notice: int = 20
    max_lost_pct: int = 40


SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
_ENDS = tuple(x.encode() for x in END_MARKS)
_SEPARATORS = frozenset(x.encode() for x in SEPARATORS)
_NOTICE = re.compile("|".join(NOTICES).encode(), re.IGNORECASE)
#: What each notice begins with, up to its first wildcard: looked for once per document, as few hold any.
_NOTICE_STARTS = [x.split(".")[0].encode() for x in NOTICES]
#: Bytes that aren't the first of a character, and white space: deleting them leaves one byte per word character.
_NOT_COUNTED = bytes(range(0x80, 0xC0)) + SPACES


def line_fails(line: bytes, words: list[bytes], rules: Rules, noticed: bool = True) -> bool:
    """Whether a line with words fails by itself, repetition aside; ``noticed``: whether its document may hold a notice at all."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols >= rules.min_symbols and 100 * symbols >= rules.symbol_pct * n:
        return True
    if n > rules.max_unended and not words[-1].endswith(_ENDS) and not any(w.endswith(_ENDS) for w in words):
        return True
    separators = sum(map(_SEPARATORS.__contains__, words))
    if separators >= 2 and 100 * separators >= rules.separator_pct * n:
        return True
    return noticed and n <= rules.words_per_notice * len(_NOTICE.findall(line))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, upto = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def judge_text(text: str | None, rules: Rules) -> tuple[int, int, int, int, int, bool, bool, int, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines and characters lost, cleaned text."""
    raw = (text or "").encode()
    low = raw.lower()
    noticed = any(x in low for x in _NOTICE_STARTS)
    words: list[bytes] = []
    seen: set[bytes] = set()
    chars = dups = lost_lines = lost = 0
    left = []
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            n_chars = len(line.translate(None, _NOT_COUNTED))
            chars += n_chars
            words += own
            if repeats := line in seen:
                dups += 1
            else:
                seen.add(line)
            if repeats or line_fails(line, own, rules, noticed):
                lost += n_chars
                lost_lines += 1
                continue
        left.append(line)
    repeat = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_pct * len(words)
    kept = not failed and 100 * lost <= rules.max_lost_pct * chars
    cleaned = raw if not lost_lines else b"\n".join(left)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), chars, symbols, dups, repeat, failed, kept, lost_lines, lost, cleaned.decode()


_VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lost_lines long, lost_chars long"
)


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: its id, its counts, whether it is kept, and with ``with_text`` the text left after line removal."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {_VERDICT}" + ", cleaned string" * with_text
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = [judge_text(t.as_py(), rules) for t in part.column(1)]
                arrays = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)

    names = ["id", *(x.split()[0] for x in _VERDICT.split(", ")), *["cleaned"] * with_text]
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept rows of ``documents`` with their failing lines taken out, and ``n_chars`` counted anew."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{x}`") for x in names if x not in ("text", "n_chars")]).alias("rest"), "text")
    left = judge(packed, rules, "rest", "text", with_text=True).where("kept")
    text = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("long")}
    return left.select(*[(text[x] if x in text else F.col(f"rest.`{x}`")).alias(x) for x in names])


def oracle_sql(rules: Rules = Rules()) -> str:
    """The same verdicts as SQL, written apart from the code above."""
    word, gap = r"[^\x20\x09-\x0D]+", r"([\x20\x09-\x0D]|$)"
    ends = "".join(x if x not in "'" else "''" for x in END_MARKS)
    separators = "[" + ", ".join(f"'{x}'" for x in SEPARATORS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS words FROM d),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l1 AS (SELECT *, regexp_extract_all(line, '{word}') AS lw FROM l0),
l2 AS (SELECT *, len(lw) AS n, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
              length(array_to_string(lw, '')) AS chars,
              len(list_filter(lw, lambda x: list_contains({separators}, x))) AS seps,
              row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS dup
       FROM l1 WHERE len(lw) > 0),
l3 AS (SELECT *, dup OR (symbols >= {rules.min_symbols} AND 100 * symbols >= {rules.symbol_pct} * n)
              OR (n > {rules.max_unended} AND NOT regexp_matches(line, '[{ends}]{gap}'))
              OR (seps >= 2 AND 100 * seps >= {rules.separator_pct} * n)
              OR n <= {rules.words_per_notice} * len(regexp_extract_all(line, '(?i){"|".join(NOTICES)}')) AS bad FROM l2),
lines AS (SELECT r, sum(dup::INT) AS n_dup_lines, sum(CASE WHEN bad THEN chars ELSE 0 END) AS lost FROM l3 GROUP BY r),
g AS (SELECT r, i, [words[i], words[i + 1], words[i + 2]] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN lines USING (r) LEFT JOIN cov USING (r)),
v AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_pct} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {rules.max_lost_pct} * word_chars AS kept
FROM v"""
