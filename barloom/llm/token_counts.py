"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import id_and_text, in_batches

# Fixed value: the split pattern of byte-level vocabularies of this kind.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MERGED_KEPT = 200_000
_PART_CHARS = 1 << 18
_BATCH_CHARS = 1 << 20

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings proved to encode alone as one token.

    A vocabulary string is no proof in itself: merges run in order of rank and may take a string apart
    in a way that never meets its entry. Each string that is text (half a character is not) is encoded
    once by the library; those that come out as exactly their own id, and that the pattern does not
    cut, are counted as one from then on. Special strings are left out: they are found before the split.
    """
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts, ids = [], []
    for number in range(tokenizer.get_vocab_size(with_added_tokens=False)):
        text = tokenizer.decode([number], skip_special_tokens=False)
        if text and "�" not in text and text not in special:
            texts.append(text)
            ids.append(number)
    done = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    cut = regex.compile(_PRE_TOKENS)
    return frozenset(
        text for text, number, e in zip(texts, ids, done, strict=True) if e.ids == [number] and cut.fullmatch(text)
    )


class Counter:
    """Number of tokens of a text: pre-tokens in the proved table count one, the rest are merged by the library.

    Counts of merged pre-tokens are kept, up to a bound, and forgotten together. A text is cut into
    parts before a space that follows a letter or sign, where a pre-token always ends, so that one very
    long text is never split all at once.

    The pattern's character classes come from the ``regex`` module, whose Unicode edition may be newer
    than the library's. Every non-ASCII character is tried on the library when it is first met; a part
    with a character on which the two differ is encoded by the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("the shortcut is proved for byte-level vocabularies only")
        self.whole = dict.fromkeys(whole_tokens(self.tokenizer), 1)
        self.counts = dict(self.whole)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(_PRE_TOKENS).findall
        self.alike: set[str] = set()
        self.odd: set[str] = set()
        self.tests = [(regex.compile(r"\p{L}"), 1), (regex.compile(r"\p{N}"), 2), (regex.compile(r"\s"), 3)]

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _try(self, char: str) -> None:
        """Which of letter, number, space and sign the library takes ``char`` for, against the pattern's class."""
        kind = next((k for test, k in self.tests if test.match(char)), 4)
        ends = {span[1] for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{char}1{char}!")}
        # a|c|1|c|! is where a piece may end; 1 ends at 1, c at 2, 1 at 3, c at 4.
        seen = {1: {2, 3, 4, 5}, 2: {1, 4, 5}, 3: {1, 2, 3, 4, 5}, 4: {1, 2, 3, 5}}[kind]
        (self.alike if ends == seen else self.odd).add(char)

    def _has_odd(self, text: str) -> bool:
        chars = set(text)
        for char in chars - self.alike - self.odd:
            self._try(char) if ord(char) > 127 else self.alike.add(char)
        return bool(chars & self.odd)

    def _parts(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > _PART_CHARS:
            at = text.find(" ", start + _PART_CHARS)
            while at > 0 and text[at - 1].isspace():
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:] if start else text

    def of(self, texts: list[str]) -> list[int]:
        """Tokens of each text; what the table lacks is merged for all of them in one call."""
        split: list[tuple[int, list[str]]] = []
        totals = [0] * len(texts)
        whole: list[tuple[int, str]] = []
        for k, text in enumerate(texts):
            plain = [text]
            if self.special and self.special.search(text):
                totals[k] += sum(1 for _ in self.special.finditer(text))
                plain = self.special.split(text)
            for stretch in plain:
                for part in self._parts(stretch):
                    if part.isascii() or not self._has_odd(part):
                        split.append((k, self.pieces(part)))
                    else:
                        whole.append((k, part))
        if len(self.counts) > len(self.whole) + _MERGED_KEPT:
            self.counts = dict(self.whole)
        new = list(set().union(*(p for _, p in split)).difference(self.counts)) if split else []
        self.counts.update(zip(new, self._library(new), strict=True))
        one = self.counts.__getitem__
        for k, pieces in split:
            totals[k] += sum(map(one, pieces))
        for (k, _), n in zip(whole, self._library([p for _, p in whole]), strict=True):
            totals[k] += n
        return totals


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for each Python worker: the proof is made once and later tasks go on with the counts met so far."""
    return Counter(path)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows a few at a time, by the length of their texts."""
    held, size = [], 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(batch.num_rows):
            text = texts[at].as_py() or ""
            held.append((ids[at].as_py(), text))
            size += len(text) + 1
            if size >= _BATCH_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def token_counts(
    docs: DataFrame, vocabulary: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every text.

    One pass without a shuffle; each task needs the vocabulary file at ``vocabulary`` on its machine.
    Counts are those of the library: special strings inside a text are one token each, nothing is added
    at the ends, nothing is cut off or padded.

    One row per input row, equal rows giving equal rows. A null or empty text has no bytes and no
    tokens; a null id is kept as null. A very long text is counted in parts. An empty table gives no
    rows; further columns are ignored.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)

        def rows():
            for some in _texts(batches):
                for (doc_id, text), n in zip(some, own.of([t for _, t in some]), strict=True):
                    yield doc_id, len(text.encode()), n

        return in_batches(rows(), COUNTS)

    counted = id_and_text(docs, id_col, text_col, "string").select("doc_id", "text")
    return counted.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit)
    )
