"""Packing by concatenate-and-cut."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import id_and_text, in_batches, rows_of
from barloom.session import persist_table

SEQUENCE = 2048
END_ID = 1

# Fixed value: the split pattern stated in the vocabulary file.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Separators on which str.split() and the vocabulary's \s disagree or might: such texts are encoded whole.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]")
_BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
_PARTS_KEPT = 200_000
_BATCH_CHARS = 1 << 19


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _latin_parts() -> re.Pattern:
    """The split pattern for texts below U+0250, its classes written out character by character."""
    latin = [chr(c) for c in range(0x250)]
    letters = re.escape("".join(filter(regex.compile(r"\p{L}").match, latin)))
    digits = re.escape("".join(filter(regex.compile(r"\p{N}").match, latin)))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+")


class Known(dict):
    """Ids of parts. A part without any is noted in ``new`` and stands for nothing until it is learned.

    When full, only parts asked for again are kept on.
    """

    def __init__(self) -> None:
        self.old: dict[str, bytes] = {}
        self.new: set[str] = set()

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            self.new.add(part)
            return b""
        self[part] = ids
        return ids

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class Encoder:
    """Token ids of texts, by the ids of their parts: runs of letters, digits, runs of signs.

    White space ends every token of this vocabulary and merges never leave a part, so a text's ids are
    those of its parts, and most parts recur. Parts not met before are encoded together and told apart by
    the mark that ends a word. In texts with characters beyond Latin, pieces between white space that hold one are
    encoded by themselves. Texts with unusual separators go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.ends = np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.split = _latin_parts().findall
        self.known = Known()

    def _encode(self, text: str) -> np.ndarray:
        done = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(done.ids, self.kind)

    def _learn(self, new: list[str]) -> None:
        text = " ".join(new)
        if _BEYOND_LATIN.search(text):
            for part in filter(_BEYOND_LATIN.search, new):
                self.known[part] = self._encode(part).tobytes()
            new = [part for part in new if part not in self.known]
            text = " ".join(new)
        ids = self._encode(text)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(new):
            raw, width, start = ids.tobytes(), ids.itemsize, 0
            for part, stop in zip(new, (stops * width).tolist(), strict=True):
                self.known[part] = raw[start:stop]
                start = stop
        else:
            for part in new:
                self.known[part] = self._encode(part).tobytes()

    def _parts(self, text: str) -> list[str]:
        if not _BEYOND_LATIN.search(text):
            plain = text if text.isascii() else unicodedata.normalize("NFC", text)
            return self.split(plain.lower())
        parts = []
        for piece in text.split():
            if _BEYOND_LATIN.search(piece):
                parts.append(piece)
            else:
                parts += self.split(unicodedata.normalize("NFC", piece).lower())
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``kind``; parts not met before wait and are learned together."""
        known = self.known
        if len(known) > _PARTS_KEPT:
            known.turn()
        out: list[bytes] = []
        waiting: list[tuple[int, list[str]]] = []
        of = known.__getitem__
        for k, text in enumerate(texts):
            if _ODD_SPACE.search(text):
                out.append(self._encode(text).tobytes())
                continue
            parts, before = self._parts(text), len(known.new)
            out.append(b"".join(map(of, parts)))
            if len(known.new) > before or not known.new.isdisjoint(parts):
                waiting.append((k, parts))
        if waiting:
            self._learn(list(known.new))
            known.new.clear()
            for k, parts in waiting:
                out[k] = b"".join(map(of, parts))
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker: the next task goes on with the parts met so far."""
    return Encoder(path)


TOKENS = pa.schema(
    [
        ("part", pa.int32()),
        ("before", pa.int64()),
        ("doc_id", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids", pa.binary()),
    ]
)
PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def _some(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows a few at a time, by the length of their texts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "")
        if size >= _BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_table(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"):
    """First pass: each document's ids with the tokens before it in its partition, as a written table."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], coder.kind).tobytes()
        width = len(end)

        def rows():
            before = 0
            for some in _some(rows_of(batches, "doc_id", "text")):
                for (doc_id, _), ids in zip(some, coder.encode([t or "" for _, t in some]), strict=True):
                    size = len(ids) // width + 1
                    yield part, before, doc_id, size, ids + end
                    before += size

        return in_batches(rows(), TOKENS, 1000)

    coded = id_and_text(docs, id_col, text_col, "string").mapInArrow(
        encode, "part int, before bigint, doc_id bigint, doc_tokens bigint, ids binary"
    )
    return persist_table(coded, "tokens")


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    length: int = SEQUENCE,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Put all documents end to end and cut into sequences of ``length`` tokens.

    Two passes. The first encodes every document, ends it with ``end_id`` and
    writes the ids with the partition's running total to the shared folder, so
    order and offsets stay what they were if an executor is lost. The partition
    totals (one row per input partition, the only broadcast) get a prefix sum;
    an offset in the whole stream is then partition offset plus running total.
    The second pass cuts each document at the multiples of ``length`` and
    returns the boundary records: one row per piece with its place in its
    document (``start``, ``length``) and in its sequence (``sequence_id``,
    ``offset``). Only the last sequence is shorter than ``length``.

    A null or empty text is its end id alone. Repeated rows are packed each for
    itself. A null id is kept as null. An empty table gives no rows. Further
    columns are ignored. A long text becomes many pieces; none is dropped.
    """
    vocabulary = vocabulary or default_vocabulary()
    tokens = token_table(docs, vocabulary, end_id, id_col, text_col)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tokens.groupBy("part")
        .agg(F.sum("doc_tokens").alias("total"))
        .select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shift"))
    )
    placed = tokens.join(F.broadcast(offsets), "part").select(
        "doc_id", "doc_tokens", "ids", (F.col("before") + F.col("shift")).alias("at")
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, n, raw, at in rows_of(batches, "doc_id", "doc_tokens", "ids", "at"):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    own = ids[start : start + size].tobytes()
                    yield doc_id, start, size, zlib.crc32(own), n, sequence, offset, own if with_ids else None
                    start += size

        return in_batches(rows(), PIECES)

    return placed.mapInArrow(
        cut,
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, ids binary",
    )
