"""Importance resampling towards a target: hashed n-grams of raw and target texts give each document a weight, and noise drawn from its id decides what is drawn.

Features are counted in tasks with Arrow kernels over bounded slices of a batch: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` turn texts into words' numbers;
numbers shifted by one and two places are paired with the number before, and the pairs encoded again, which gives the distinct bigrams and trigrams. Only distinct ones are hashed: words by ``zlib``, and
each longer run from the hash of its beginning, moved over the bytes of the next word by tables of the code's linear map, and the hash of that word. ``take`` spreads
what a distinct run has (its bucket's gain) to where it occurs, and differences of running sums reduce that to documents.

Both passes read the texts, as features would take more disk than texts do. Between them stand two vectors of ``BUCKETS`` counts. The draw sorts ids and scores by range,
numbers each partition's rows, and adds how many rows the partitions before have.

Defined results: a null text has no features; documents without features weigh 0; a null id's noise is that of ``42:`` alone, and it comes after all others of its score; repeated rows are
drawn each; without target texts all their counts are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotledger.sources.shared import materialise, scratch

BUCKETS = 10_000
#: Bytes of text that are worked on at once.
SLICE_BYTES = 4 << 20
#: What stands between words: every ASCII character but digits and small letters, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _zero_byte_tables() -> np.ndarray:
    """``[k, j, b]``: what byte ``j`` of value ``b`` of a CRC-32 becomes when ``2 ** k`` zero bytes follow; the map is linear, so bytes' results are combined by xor."""
    b = np.arange(256, dtype=np.uint32)
    one = b.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    tables = np.zeros((32, 4, 256), np.uint32)
    for j in range(4):
        crc = b << np.uint32(8 * j)
        tables[0, j] = (crc >> np.uint32(8)) ^ one[crc & np.uint32(255)]
    for k in range(1, 32):
        for j in range(4):
            tables[k, j] = _apply(tables[k - 1], tables[k - 1, j])
    return tables


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & np.uint32(255)]
    for j in (1, 2, 3):
        out = out ^ table[j][(crc >> np.uint32(8 * j)) & np.uint32(255)]
    return out


ZEROS = _zero_byte_tables()


def moved(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 values carried over so many further bytes: xor the CRC-32 of those bytes to get that of the whole."""
    out = crc.copy()
    for k in range(int(lengths.max(initial=0)).bit_length()):
        on = (lengths >> k & 1).astype(bool)
        out[on] = _apply(ZEROS[k], out[on])
    return out


class Runs:
    """Runs of 1 to 3 words in a slice of texts: per length the distinct ones' buckets, where each occurs, and each text's bounds in that."""

    def __init__(self, texts: pa.Array):
        # Of a plain string array, 32-bit offsets are enough, as a slice is small; one text of any size is a slice of its own.
        parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
        words, of = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
        some = pc.greater(pc.binary_length(words), 0)
        words, of = words.filter(some), of[some.to_numpy(zero_copy_only=False)]
        coded = words.dictionary_encode()
        number, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.n_texts, self.n_words = len(texts), np.bincount(of, minlength=len(texts))
        raw = [w.as_buffer() for w in known.cast(pa.binary())]
        own = np.array([zlib.crc32(w) for w in raw], np.uint32)
        space = zlib.crc32(b" ")
        after = np.array([zlib.crc32(w, space) for w in raw], np.uint32)
        length = np.array([w.size + 1 for w in raw], np.int64)
        self.found = [(own, number, of)]
        crc, run, at = own, number, np.arange(len(number))
        for n in (1, 2):
            # A run goes on where its text has another word.
            going = at + n < len(of)
            going[going] = of[at[going] + n] == of[at[going]]
            at, run = at[going], run[going]
            pairs = pa.array(run * max(1, len(raw)) + number[at + n]).dictionary_encode()
            pair = pairs.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)
            head, tail = pair // max(1, len(raw)), pair % max(1, len(raw))
            crc = moved(crc[head], length[tail]) ^ after[tail]
            run = pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            self.found.append((crc, run, of[at]))

    def counts(self, buckets: int) -> np.ndarray:
        """How many runs fall into each bucket."""
        total = np.zeros(buckets, np.int64)
        for crc, run, _ in self.found:
            np.add.at(total, crc % np.uint32(buckets), np.bincount(run, minlength=len(crc)))
        return total

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text its number of runs and the sum of their buckets' gains."""
        n, total = np.zeros(self.n_texts, np.int64), np.zeros(self.n_texts, np.int64)
        for crc, run, of in self.found:
            each = pa.array(gains[crc % np.uint32(len(gains))]).take(pa.array(run)).to_numpy(zero_copy_only=False)
            running = np.concatenate([[0], np.cumsum(each)])
            ends = np.searchsorted(of, np.arange(self.n_texts + 1))
            n += ends[1:] - ends[:-1]
            total += running[ends[1:]] - running[ends[:-1]]
        return n, total


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts take about ``SLICE_BYTES``; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall into each bucket; each task sends one number for each bucket that it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                total += Runs(part.column(0)).counts(buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    summed = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket a thousand times the logarithm of how much likelier it is in the target, counts smoothed by one, rounded down."""
    n = len(raw)
    s, t = float(raw.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log(((b + 1.0) * s) / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise from the id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` per document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                runs = Runs(part.column(1))
                n, weight = runs.sums(shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs.n_words.astype(np.int64)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` per document; ``rank`` counts from 1 for the ``percent`` hundredths that are drawn and is null for others."""
    with scratch(docs.sparkSession) as kept:
        gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
        rows = materialise(weighed(docs, gain, seed).withColumn("row", F.monotonically_increasing_id()), "weighed")
        may = rows.where(F.col("n_words") >= least_words)
        # Rows of one score and id are told apart by where they stand, so that many of them are dealt out too.
        line = may.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
        # A row's number in its partition stands in the lower 33 bits; partitions stand in order.
        line = materialise(line.select("doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("at")), "line").withColumn("part", F.shiftright("at", 33))
        # One row per partition.
        before, all_rows = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
        starts = line.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.call_function("div", F.sum("n").over(all_rows) * percent, F.lit(100)).alias("drawn"))
        rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
        ranked = line.join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= F.col("drawn"), rank))
        names = ("doc_id", "n_features", "weight", "score")
        rest = rows.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
        return kept(ranked.select(*names, "rank").union(rest), "resampled")


def oracle_sql(percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> str:
    """The same with joins; CRC-32 byte by byte over a table made from its rule, once for each distinct run."""
    table = ZEROS[0, 0].tolist()  # of one byte, a zero byte after it
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    runs = "list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"
    data = "list_transform(range(1, octet_length(encode(g)) + 1), lambda i: ('0x' || substr(hex(encode(g)), 2 * i - 1, 2))::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
b AS (SELECT regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
dg AS MATERIALIZED (SELECT r, g, count(*) AS n FROM (SELECT r, unnest({runs}) AS g FROM d) GROUP BY ALL),
bg AS MATERIALIZED (SELECT g, count(*) AS n FROM (SELECT unnest({runs}) AS g FROM b) GROUP BY ALL),
k AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(4294967295, {data}), {step}), 4294967295) % {buckets} AS k FROM (SELECT g FROM dg UNION SELECT g FROM bg)),
s AS (SELECT k, sum(n)::BIGINT AS n FROM dg JOIN k USING (g) GROUP BY 1),
t AS (SELECT k, sum(n)::BIGINT AS n FROM bg JOIN k USING (g) GROUP BY 1),
gain AS (SELECT k, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (k)),
w AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM dg JOIN k USING (g) JOIN gain USING (k) GROUP BY 1),
x AS (SELECT doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d w LEFT JOIN w v USING (r)),
y AS (SELECT *, CASE WHEN n_words >= {least_words} THEN row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id NULLS LAST) END AS p FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= (SELECT count(*) FROM x WHERE n_words >= {least_words}) * {percent} // 100 THEN p END AS rank FROM y"""
