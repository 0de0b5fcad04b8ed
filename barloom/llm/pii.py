"""Personal data: exact patterns, and a conditional random field for what they miss."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import carried, id_and_text, in_batches, rows_of
from barloom.llm.crf import TOKEN, Crf, contexts

KINDS = ("email", "ip", "card", "phone")
LABELLED_TEXTS = 4_000
LABELLED_STRETCHES = 500
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS_DOTS = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]+")
_SIGN = re.compile(r"[^0-9]")
_AROUND = 40

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, in linear time: each ``@`` once, with the longest name before it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Email, ip, card and phone spans, in this order of kinds, each by start."""
    out = list(emails(text)) if "@" in text else []
    for block in _DIGITS_DOTS.finditer(text):
        if block.group().count(".") >= 3:
            for m in _IP.finditer(block.group()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out.append(("ip", block.start() + m.start(), block.start() + m.end()))
    for m in _CARD.finditer(text):
        digits = _SIGN.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_SIGN.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """The parts of each line within some characters of a digit or an ``@``, cut at white space.

    Every kind of personal data here has a digit or an ``@``: these are the
    sequences of the random field, in training as in use.
    """
    low = high = -1
    for m in _ANCHOR.finditer(text):
        if m.start() <= high:
            a, b = low, max(high, _reach(text, m.end()))
        else:
            if high >= 0:
                yield low, high
            a, b = _back(text, m.start(), max(high, 0)), _reach(text, m.end())
        low, high = a, b
    if high >= 0:
        yield low, high


def _back(text: str, at: int, floor: int) -> int:
    near = max(floor, at - _AROUND)
    line = text.rfind("\n", near, at)
    space = text.find(" ", near, at)
    return line + 1 if line >= 0 else near if near == floor or space < 0 else space + 1


def _reach(text: str, at: int) -> int:
    far = min(len(text), at + _AROUND)
    line = text.find("\n", at, far)
    space = text.rfind(" ", at, far)
    return line if line >= 0 else far if far == len(text) or space < 0 else space


def tokens_of(text: str, low: int, high: int) -> list[tuple[str, int, int, bool]]:
    out, last = [], low
    for m in TOKEN.finditer(text, low, high):
        out.append((m.group(), m.start(), m.end(), m.start() > last))
        last = m.end()
    return out


def labelled_stretches(text: str, spans: list[Span]) -> Iterator[tuple[list[str], list[bool], list[str]]]:
    """Tokens, gaps and tags of each stretch; a phone also in the forms its own pattern does not know."""
    for low, high in stretches(text):
        own = [s for s in spans if s[1] < high and s[2] > low]
        found = tokens_of(text, low, high)
        tags = []
        for _, a, b, _ in found:
            over = next((s for s in own if s[1] <= a and b <= s[2]), None)
            tags.append("O" if over is None else ("B-" if a == over[1] else "I-") + over[0])
        words, gaps = [t[0] for t in found], [t[3] for t in found]
        yield words, gaps, tags
        if "B-phone" in tags:
            at = tags.index("B-phone")
            if words[at : at + 1] == ["+"] and len(words) > at + 3 and tags[at + 2] == "I-phone":
                yield words[:at] + words[at + 2 :], gaps[:at] + gaps[at + 2 :], tags[:at] + ["B-phone"] + tags[at + 3 :]


def labelled_table(docs: DataFrame, bound: int = LABELLED_TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(words, gaps, tags) of stretches from about ``bound`` documents, chosen by a hash, tagged by the exact patterns."""
    own = id_and_text(docs, id_col, text_col, "string").filter("text IS NOT NULL")
    share = min(1.0, bound / max(1, docs.count()))
    some = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    kind = pa.schema([("words", pa.list_(pa.string())), ("gaps", pa.list_(pa.bool_())), ("tags", pa.list_(pa.string()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches((x for (text,) in rows_of(batches, "text") for x in labelled_stretches(text, base_spans(text))), kind)

    return some.select("text").mapInArrow(run, "words array<string>, gaps array<boolean>, tags array<string>")


def train(labelled: DataFrame, bound: int = LABELLED_STRETCHES) -> Crf:
    """Fit on at most ``bound`` stretches with and ``bound`` without personal data, first by a hash of their words."""
    order = labelled.withColumn("_any", F.exists("tags", lambda t: t != "O")).withColumn("_h", F.xxhash64("words"))
    order = order.filter("size(words) BETWEEN 1 AND 200")
    rows = []
    for some in (True, False):
        rows += order.filter(F.col("_any") == some).orderBy("_h", "words", "tags").limit(bound).collect()
    tags = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
    chains = [contexts(list(zip(r.words, r.gaps, strict=True))) for r in rows]
    return Crf(tags).fit(chains, [list(r.tags) for r in rows])


def plausible(kind: str, span: str) -> bool:
    """What a span of the field must hold besides its shape: the checks that the exact kinds have."""
    digits = _SIGN.sub("", span)
    if kind == "email":
        return "@" in span and "." in span.partition("@")[2]
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return bool(_IP.fullmatch(span)) and all(len(p) <= 3 and int(p) <= 255 for p in span.split("."))
    return 7 <= len(digits) <= 15


def field_spans(crf: Crf, texts: list[str], known: list[list[Span]]) -> list[list[Span]]:
    """Plausible spans on the best tag paths that no exact span touches."""
    where, chains, places = [], [], []
    for k, text in enumerate(texts):
        for low, high in stretches(text):
            found = tokens_of(text, low, high)
            where.append(k)
            places.append(found)
            chains.append(contexts([(t[0], t[3]) for t in found]))
    out: list[list[Span]] = [[] for _ in texts]
    for k, found, tags in zip(where, places, crf.decode(chains), strict=True):
        at = 0
        while at < len(tags):
            if tags[at] == "O":
                at += 1
                continue
            kind, stop = tags[at][2:], at + 1
            while stop < len(tags) and tags[stop] == f"I-{kind}":
                stop += 1
            a, b = found[at][1], found[stop - 1][2]
            enough = plausible(kind, texts[k][a:b])
            if enough and not any(s[1] < b and a < s[2] for s in known[k]):
                out[k].append((f"crf_{kind}", a, b))
            at = stop
    return out


SPANS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))),
        ("masked", pa.string()),
        ("carry", pa.string()),
    ]
)
SPANS_DDL = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>, masked string, carry string"


def find_personal_data(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", mask: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Spans of personal data in every whole text, one row per document: (doc_id, spans, masked) and the columns to ``carry``.

    The exact patterns give email, ip, card and phone spans (leftmost, not
    overlapping within a kind). The field tags the tokens around every digit
    and ``@`` and adds ``crf_*`` spans where no exact span is. Spans come by
    kind, then start, in code points, end exclusive; ``base`` marks exact ones.
    ``masked`` is the text with each span replaced by its kind in brackets, or
    null unless ``mask``.

    Documents are taken a few at a time: a batch of stretches shares the numpy
    Viterbi steps, and memory is that of the texts at hand. Null and empty
    texts have no spans; equal rows give equal rows; an empty table gives none;
    further columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: list[tuple] = []
            size = 0
            for doc_id, text, rest in rows_of(batches, "doc_id", "text", "carry"):
                held.append((doc_id, text, rest))
                size += len(text or "")
                if size > 1 << 20 or len(held) >= 500:
                    yield from _of_some(crf, held, mask)
                    held, size = [], 0
            yield from _of_some(crf, held, mask)

        return in_batches(rows(), SPANS, 500)

    found = id_and_text(docs, id_col, text_col, "string", carry).mapInArrow(run, SPANS_DDL)
    return found.select("doc_id", "spans", "masked", *carried(docs, carry))


def _of_some(crf: Crf, held: list[tuple], mask: bool) -> Iterator[tuple]:
    texts = [t or "" for _, t, _ in held]
    known = [base_spans(t) for t in texts]
    for (doc_id, text, rest), own, more in zip(held, known, field_spans(crf, texts, known), strict=True):
        more.sort(key=lambda s: (KINDS.index(s[0][4:]), s[1]))
        spans = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in own]
        spans += [{"kind": k, "start": a, "end": b, "base": False} for k, a, b in more]
        yield doc_id, spans, masked(text, own + more) if mask and text is not None else None, rest


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.removeprefix('crf_').upper()}]"]
        at = max(at, b)
    return "".join((*out, text[at:]))
