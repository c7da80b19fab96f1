"""Token ids of texts by a public byte-level vocabulary, and documents cut into pieces."""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotledger.llm.memory import tidy

#: The id that ends a document, and the vocabulary's one special token, which is matched inside texts.
END_ID, SPECIAL = 2, "<|endoftext|>"


def default_paths() -> tuple[str, str]:
    """Places of the vocabulary for ``tokenizers`` and of the same vocabulary as ranks for ``tiktoken``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str) -> Callable[[str], list[int]]:
    """Ids of a text. ``tiktoken`` is three times as fast; texts with the special token's string go to ``tokenizers``, which matches it."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = None

    def encode(text: str) -> list[int]:
        nonlocal whole
        if SPECIAL not in text:
            return plain(text)
        if whole is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(json_path)
        return whole.encode(text, add_special_tokens=False).ids

    return encode


@functools.lru_cache(maxsize=2)
def vocabulary_size(paths: tuple[str, str]) -> int:
    """One more than the largest id, by the ranks and the special token."""
    with open(paths[1], "rb") as lines:
        return max(END_ID, *(int(line.split()[1]) for line in lines)) + 1


def id_arrays(texts: pa.Array, paths: tuple[str, str]) -> Iterator[np.ndarray]:
    """Ids of each text and the end id; a null text is empty."""
    encode = encoder(*paths)
    for text in texts:
        yield np.array([*encode(text.as_py() or ""), END_ID], np.uint32)


def pieces(docs: DataFrame, size: int = 1024, paths: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents of over ``size`` ids are cut; the first piece takes the odd length."""
    paths = paths or default_paths()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            which, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(id_arrays(batch.column(1), paths)):
                first = (len(ids) - 1) % size + 1
                cuts = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for x, y in zip((which, piece, start, length, crc), (row, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()))):
                        x.append(y)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
