"""Benchmark decontamination by an FM-index over each shard of the training documents."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import alnum_words, carried, id_and_text, in_batches, rows_of
from barloom.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 1 << 21
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

HITS = pa.schema(
    [
        ("row", pa.binary()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("items", pa.list_(pa.string())),
        ("text", pa.binary()),
        ("carry", pa.string()),
    ]
)
HITS_DDL = (
    "row binary, doc_id bigint, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, "
    "items array<string>, text binary, carry string"
)
CUT = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("carry", pa.string())]
)
CUT_DDL = "doc_id bigint, text string, n_words bigint, n_removed bigint, carry string"


class Phrases:
    """The windows of a block of benchmark items as rows of word numbers, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        places: dict[str, int] = {}
        windows: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for name, text in items:
            words = alnum_words(text or b"")
            # 0 ends the text of the index and 1 stands for every word that no item has.
            numbers = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words]
            size = min(window, len(numbers))
            if not size:
                continue
            place = places.setdefault(name, len(places))  # an item may have several rows
            own = windows.setdefault(size, {})
            for i in range(len(numbers) - size + 1):
                own.setdefault(tuple(numbers[i : i + size]), []).append(place)
        self.names = list(places)
        self.size = len(self.numbers) + 2
        self.by_length = {
            size: (np.array(list(own), np.int64), [np.unique(v) for v in own.values()]) for size, own in windows.items()
        }
        self.shortest = min(self.by_length, default=0)


class Shard:
    """Documents gathered until there is enough for one index."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.rows: list[tuple] = []
        self.counts: list[int] = []
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, row: bytes | None, doc_id: int | None, text: bytes | None, carry: str | None) -> None:
        words = alnum_words(text or b"")
        get = self.phrases.numbers.get
        self.parts.append(np.fromiter((get(w, 1) for w in words), np.int64, len(words)))
        self.rows.append((row, doc_id, text, carry))
        self.counts.append(len(words))
        self.words += len(words)

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, last word + 1) of each occurrence and its (document, item) pairs, by searching the index.

        A stretch of words that some item has, cut off by other words or the
        document's end, is the only place where a window can stand; stretches
        shorter than every window cannot hold one. The index is built over the
        remaining stretches with a separator after each.
        """
        words = np.concatenate([np.append(p, 1) for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        edge = np.diff(np.concatenate(([0], (words > 1).astype(np.int8), [0])))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long_ = stops - starts >= self.phrases.shortest
        starts, stops = starts[long_], stops[long_]
        if not len(starts) or not self.phrases.shortest:
            return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
        sizes = stops - starts + 1
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        text = words[np.repeat(starts - begin, sizes) + np.arange(int(sizes.sum()))]
        index = FMIndex(text, self.phrases.size)
        first_word = np.concatenate(([0], np.cumsum(np.array(self.counts) + 1)))
        spans, pairs = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for size, (windows, items) in self.phrases.by_length.items():
            low, high = index.search(windows)
            for w in _blocks(high - low, 1 << 20):
                counts = (high - low)[w]
                total = int(counts.sum())
                if not total:
                    continue
                which = np.repeat(w, counts)
                rows = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[w], counts)
                at = index.locate(rows)
                run = np.searchsorted(begin, at, "right") - 1
                place = starts[run] + at - begin[run]
                spans.append(np.stack((place, place + size), 1))
                doc = np.searchsorted(first_word, place, "right") - 1
                seen = np.unique(doc * len(windows) + which)
                for key in seen.tolist():
                    own = items[key % len(windows)]
                    pairs.append(np.stack((np.full(len(own), key // len(windows), np.int64), own), 1))
        return np.concatenate(spans), np.unique(np.concatenate(pairs), axis=0)

    def results(self) -> Iterator[tuple]:
        spans, pairs = self.hits()
        bounds = np.concatenate(([0], np.cumsum(np.array(self.counts, np.int64) + 1)))
        change = np.zeros(int(bounds[-1]) + 1, np.int64)
        np.add.at(change, spans[:, 0], 1)
        np.add.at(change, spans[:, 1], -1)
        edge = np.diff(np.concatenate(([0], (np.cumsum(change) > 0).astype(np.int8), [0])))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        first = np.searchsorted(starts, bounds)
        pair_at = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        for k, (row, doc_id, text, carry) in enumerate(self.rows):
            a, b = first[k], first[k + 1]
            own = [{"start": int(s - bounds[k]), "stop": int(e - bounds[k])} for s, e in zip(starts[a:b], stops[a:b])]
            items = [self.phrases.names[i] for i in pairs[pair_at[k] : pair_at[k + 1], 1]]
            yield row, doc_id, self.counts[k], own, sorted(items), text, carry


def _blocks(counts: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Positions in blocks of about ``most`` occurrences: locating never holds more at once."""
    cut = np.searchsorted(np.cumsum(counts), np.arange(most, int(counts.sum()) + most, most))
    yield from (b for b in np.split(np.arange(len(counts)), np.unique(np.minimum(cut + 1, len(counts)))) if len(b))


def _scan(
    rows: DataFrame, phrases: list[tuple[str, bytes | None]], window: int, shard_words: int, keep_text: bool, cut: bool = False
) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Phrases(phrases, window)

        def each():
            shard = Shard(known)
            for row in rows_of(batches, "row", "doc_id", "text", "carry"):
                shard.add(*row)
                if shard.words >= shard_words or len(shard.rows) >= 20_000:
                    yield from shard.results()
                    shard = Shard(known)
            yield from shard.results()

        if cut:
            return in_batches((_cut(d, text, n, spans, rest) for _, d, n, spans, _, text, rest in each()), CUT, 1000)
        return in_batches((r if keep_text else (*r[:-2], None, None) for r in each()), HITS, 1000)

    return rows.mapInArrow(run, CUT_DDL if cut else HITS_DDL)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    shard_words: int = SHARD_WORDS,
    keep_text: bool = False,
    carry: tuple[str, ...] = (),
    cut: bool = False,
) -> DataFrame:
    """Where benchmark passages stand in the documents: (doc_id, n_words, spans, items, text, carry).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A
    window is ``window`` consecutive words of an item, or all of a shorter item.
    Every task indexes its documents in shards of about ``shard_words`` words
    (Burrows-Wheeler transform, wavelet tree, sampled suffix positions),
    searches all windows backward, locates the occurrences and merges them to
    removal spans ``[start, stop)`` in words. ``items`` lists the items found.
    Documents are never shuffled.

    The phrases travel with the tasks in blocks of at most about
    ``block_bytes`` of benchmark text; a larger benchmark takes one pass for
    each block, and the passes' spans are merged by document.

    One row per document; equal rows give equal rows. Null and empty texts have
    no words and no hits; items without a word are ignored; empty documents
    give no rows and an empty benchmark gives no hits. Ids may be null, further
    columns are ignored. ``text`` and ``carry`` (the columns
    named there as JSON) are null unless ``keep_text``. With ``cut`` the rows are those of the
    texts without their spans instead, (doc_id, text, n_words, n_removed, carry). One block is
    searched and cut in the same Python step, so a task holds one worker and texts travel once.
    """
    own = id_and_text(docs, id_col, text_col, carry=carry)
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("binary").alias("words")
    ).filter("item IS NOT NULL AND words IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("words") + 32)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    if blocks == 1:
        phrases = [(r.item, bytes(r.words)) for r in items.collect()]
        rows = own.select(F.lit(None).cast("binary").alias("row"), "doc_id", "text", "carry")
        return _scan(rows, phrases, window, shard_words, keep_text, cut).drop("row")

    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"), F.lit(b" "),
                                  F.coalesce("text", F.lit(b""))), 256))
    rows = own.select(key.alias("row"), "doc_id", "text", "carry")
    passes = []
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block)
        phrases = [(r.item, bytes(r.words)) for r in part.collect()]
        passes.append(_scan(rows, phrases, window, shard_words, False).filter("size(items) > 0"))
    found = passes[0]
    for other in passes[1:]:
        found = found.union(other)
    found = found.groupBy("row").agg(
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("many"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def join(done, span):
        last = F.element_at(done, -1)
        merged = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (last["stop"] >= span["start"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(merged))
                      ).otherwise(F.concat(done, F.array(span)))

    found = found.select("row", F.aggregate("many", none, join).alias("spans"), "items")
    base = _scan(rows, [], window, shard_words, keep_text or cut).select("row", "doc_id", "n_words", "text", "carry")
    merged = base.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "text", "carry",
    )
    if not cut:
        return merged

    def cut_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches((_cut(*r) for r in rows_of(batches, "doc_id", "text", "n_words", "spans", "carry")), CUT, 1000)

    return merged.mapInArrow(cut_texts, CUT_DDL)


def without_spans(text: bytes, spans: list) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for span in spans:
        out.append(text[at : places[span["start"]][0]])
        at = places[span["stop"] - 1][1]
    return b"".join((*out, text[at:]))


def _cut(doc_id: int | None, text: bytes | None, words: int, spans: list, rest: str | None) -> tuple:
    left = None if text is None else without_spans(text, spans).decode("utf-8", "replace")
    return doc_id, left, words, sum(s["stop"] - s["start"] for s in spans), rest


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), **options
) -> DataFrame:
    """(doc_id, text, n_words, n_removed): each text with its removal spans cut out, its words before, the words removed.

    Columns to ``carry`` follow unchanged. Null texts stay null.
    """
    clean = find_contamination(docs, benchmark, id_col=id_col, text_col=text_col, carry=carry, cut=True, **options)
    return clean.select("doc_id", "text", "n_words", "n_removed", *carried(docs, carry))
