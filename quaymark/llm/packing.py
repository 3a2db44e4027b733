"""Packing by power-of-two decomposition.

Every document becomes a run of token ids closed by an end id. The run is cut into pieces whose
lengths are powers of two, the largest first: as many pieces of ``max_length`` as fit, then the
binary digits of what is left. A piece is a sequence of its own, so no sequence crosses documents
and none is padded; pieces of one length share a bucket, from which batches of equal length are read.

Defined cases: a null text is an empty one and gives one piece that holds the end id alone; equal
rows give equal pieces under sequence ids of their own; an empty table gives no rows; other columns
of the input are ignored; texts of any length are cut whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are kept with their ids in each Python worker; others are encoded each time.
CACHED_WORDS = 600_000

#: The layout of tokenizer files that texts may be cut into words for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "bucket int, sequence_id bigint, offset bigint"
)


class WordEncoder:
    """Ids of a text by a ``tokenizers`` file whose pre-tokenizer drops white space.

    No token of such a tokenizer spans white space, so a text's ids are those of its words one after
    another, and the ids of a word met before come from a table. Words of plain Latin letters,
    digits and symbols are split by the same pattern as the tokenizer's own, and each part goes to
    its BPE model alone; any other word goes through the whole tokenizer. A file whose normalizer or
    pre-tokenizer is another one is used as it is, on whole texts.
    """

    _plain = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
    _parts = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z\xdf-\xf6\xf8-\xff0-9]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        self._known = (layout.get("normalizer"), layout.get("pre_tokenizer")) == (NORMALIZER, PRE_TOKENIZER) and layout["model"].get("type") == "BPE" and not layout.get("post_processor")
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters = {b: self._bytes.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        self._words: dict[bytes, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self._pieces.get(part)
        if found is None:
            mapped = part if part.isascii() else self._bytes.pre_tokenize_str(part)[0][0]
            found = np.array([t.id for t in self._model.tokenize(mapped)], "<u4").tobytes()
            if len(self._pieces) < CACHED_WORDS and len(part) < 64:
                self._pieces[part] = found
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self._plain.fullmatch(text) and "<|" not in text:
            found = b"".join(map(self._part, self._parts.findall(text.lower())))
        else:
            found = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self._words) < CACHED_WORDS // 4 and len(word) < 64:
            self._words[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self._known:
            return np.array(self._tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        words = text.split()
        ids = list(map(self._words.get, words))
        for at, found in enumerate(ids):
            if found is None:
                ids[at] = self._word(words[at])
        return b"".join(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def piece_lengths(n: int, max_length: int) -> list[int]:
    whole, rest = divmod(n, max_length)
    return [max_length] * whole + [1 << k for k in range(max_length.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, max_length: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents: ids (little-endian unsigned 32-bit), their place and their bucket.

    ``bucket`` is the base-2 logarithm of the length. A sequence id holds the bucket in its highest
    bits, then the input partition and a counter in it: equal lengths have neighbouring ids, and no
    shuffle or global order is needed to make them unique.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path).encode
        part, counts, end = TaskContext.get().partitionId(), [0] * max_length.bit_length(), np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            rows, held = [], 0
            for doc, text in zip(ids, texts, strict=True):
                run = encode(text.as_py() or b"") + end
                start, tokens = 0, len(run) // 4
                for length in piece_lengths(tokens, max_length):
                    bucket = length.bit_length() - 1
                    rows.append((doc, start, length, run[4 * start : 4 * (start + length)], tokens, bucket, bucket << 58 | part << 34 | counts[bucket], 0))
                    counts[bucket] += 1
                    start += length
                held += len(run)
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length; a reader takes its batches of equal length from one of them."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def packing_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The pieces with a CRC-32 in place of their ids."""
    return pack_documents(docs, tokenizer_path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
