"""Fill-in-the-middle transformation over an index of distinct texts.

1. Every batch puts its equal texts together, so that a text that fills a third of all rows is sent once a batch.
2. Texts are dealt out by ranges of (digest, first doc_id). Equal texts become neighbours, and those of a large group
   fill as many ranges as their rows take. Neighbours are one text if they are equal byte for byte, not by their digests.
3. A distinct text's line boundaries are found once and kept as an Elias-Fano list, about 2 + log2(letters per line) bits
   a line. It is joined with the documents of the text, whose seeds select two boundaries each, without another pass over
   the text.

Texts are shuffled once; nothing is broadcast or collected.

Defined cases: null and empty texts have no lines and stay plain; so does a row with a null doc_id, which has no seed; rows
that share a doc_id share its seeds and are cut each in its own text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, RATE, SUFFIX_FIRST = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES = 1 << 22


class EliasFano(NamedTuple):
    """A rising list of positive numbers: `width` low bits of each in `low`, the rest in unary in `high`."""

    n: int
    width: int
    low: bytes
    high: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        width = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(width)) & 1
        high = np.zeros(int(values[-1] >> width) + n if n else 0, np.uint8)
        high[(values >> width) + np.arange(n)] = 1
        return cls(n, width, np.packbits(low.astype(np.uint8)).tobytes(), np.packbits(high).tobytes())

    def select(self, at: np.ndarray) -> np.ndarray:
        """The numbers at some places, from 0."""
        at = np.asarray(at, np.int64)
        high = np.unpackbits(np.frombuffer(self.high, np.uint8))
        upper = np.flatnonzero(high)[at] - at
        if not self.width:
            return upper
        bits = at[:, None] * self.width + np.arange(self.width)
        low = (np.frombuffer(self.low, np.uint8)[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1
        return (upper << self.width) | (low.astype(np.int64) << np.arange(self.width)).sum(axis=1)


def boundaries(text: str) -> EliasFano:
    """Where the text's lines end, each with its line feed, in code points."""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(letters == 10) + 1
    if len(letters) and (not len(ends) or ends[-1] < len(letters)):
        ends = np.append(ends, len(letters))
    return EliasFano.of(ends.astype(np.int64))


class Cut(NamedTuple):
    form: str
    prefix: int | None
    middle: int | None
    output: str


def cut(text: str, lines: EliasFano, doc_id: int | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Cut:
    """The document's form of a text whose boundaries are known."""
    if doc_id is None or not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Cut("plain", None, None, text)
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    one, two, three, four = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if three % 100 >= rate:
        return Cut("plain", None, None, text)
    units = np.sort([one % (lines.n + 1), two % (lines.n + 1)])
    first, second = np.where(units > 0, lines.select(np.maximum(units - 1, 0)), 0).tolist()
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if four % 100 < suffix_first:
        return Cut("spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut("psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX)
    return prefix + middle + suffix


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, first, text, ids: each text of a batch once, with its doc_ids."""
    for batch in batches:
        texts: dict[str, list[int | None]] = {}
        for text, doc_id in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()):
            texts.setdefault(text or "", []).append(doc_id)
        ids = [sorted(x, key=lambda i: (i is not None, i or 0)) for x in texts.values()]
        digests = [hashlib.sha256(text.encode()).digest() for text in texts]
        arrays = [pa.array(digests, pa.binary()), pa.array([x[0] for x in ids], pa.int64()), pa.array(list(texts), pa.string()), pa.array(ids, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["digest", "first", "text", "ids"])


def distinct_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """digest, first, text, ids: rows of equal texts next to one another."""
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = own.mapInArrow(_together, "digest binary, first long, text string, ids array<long>")
    return rows.repartitionByRange("digest", "first").sortWithinPartitions("digest", "first")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _transformed(seed: int, rate: int, suffix_first: int, with_text: bool):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if with_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines = None, EliasFano.of(np.zeros(0, np.int64))
        for batch in batches:
            rows, size = [], 0
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                if text != now:
                    now, lines = text, boundaries(text)
                for doc_id in batch.column("ids")[k].as_py():
                    one = cut(text, lines, doc_id, seed, rate, suffix_first)
                    row = (doc_id, lines.n, one.form, one.prefix, one.middle, _sha256(one.output), _sha256(restored(one.output, one.form)))
                    rows.append((*row, one.output) if with_text else row)
                    size += len(one.output) if with_text else 1
                    if size >= SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [boundaries(text) for text in batch.column("text").to_pylist()]
        columns = [pa.array(c, t) for c, t in zip(zip(*lists), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))] if lists else []
        if columns:
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *columns], ["digest", "n", "width", "low", "high"])


def boundary_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """digest, n, width, low, high: the Elias-Fano boundary list of each distinct text, as a table."""
    return distinct_texts(docs, doc_id, text).mapInArrow(_indexed, "digest binary, n long, width int, low binary, high binary").dropDuplicates(["digest"])


def transformed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, with_text: bool = False
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row; with_text: also output.

    rate: of a hundred documents, how many are cut; suffix_first: of a hundred cut ones, how many give the suffix first.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return distinct_texts(docs, doc_id, text).mapInArrow(_transformed(seed, rate, suffix_first, with_text), schema + (", output string" if with_text else ""))
