"""What several operators of this package share: byte word splitting, word hashes, spans as text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Digits, lower-case letters and every byte of a non-ASCII character stay; all else becomes a space.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

MASK64 = (1 << 64) - 1
_WORDS_KEPT = 250_000


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_ALNUM).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_LOWER).split()


class WordHashes(dict):
    """64-bit hash of each word; forgets all words when it has met very many different ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; one hash of the whole when there are fewer; none of no words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += hashes[k : n - width + 1 + k]
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


def id_and_text(docs: DataFrame, id_col: str, text_col: str, text_type: str = "binary", carry: tuple[str, ...] = ()) -> DataFrame:
    """The two columns an operator reads, under names of its own so that others cannot clash.

    Columns to ``carry`` past a Python step go as one JSON text each row; see :func:`carried`.
    """
    rest = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in carry])).alias("carry")] if carry else [F.lit(None).cast("string").alias("carry")]
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast(text_type).alias("text"), *rest
    )


def carried(docs: DataFrame, carry: tuple[str, ...]) -> list[Column]:
    """The carried columns again, with their types."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    ddl = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in carry)
    return [F.from_json("carry", ddl)[c].alias(c) for c in carry]


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, converted a thousand at a time so that long texts are not all held twice."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for at in range(0, batch.num_rows, 1000):
            yield from zip(*(c.slice(at, 1000).to_pylist() for c in columns), strict=True)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length; nothing when there are none."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def let(value: Column, body) -> Column:
    """``body`` over ``value`` worked out once: a lambda variable is not copied into each place of use."""
    return F.transform(F.array(value), body)[0]


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of (kind, start, end), comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
