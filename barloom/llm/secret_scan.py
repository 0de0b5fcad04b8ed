"""Secret scans: exact patterns, and character Markov models for random strings the patterns miss."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import let
from barloom.session import persist_table

KINDS = ("assign", "access", "hex")
# A position mark for regexp_replace: outside every pattern below. A text's own marks become another such character.
_MARK, _OTHER = "\ue000", "\ue001"
_NAME = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_ASSIGN = _NAME + r"([A-Za-z0-9+/_.=-]+)"
# Runs that stay below the wanted length cannot match later in the same run either, so the length is in the pattern.
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
_CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"

#: Characters of candidates in the order of their codes; all signs share the last code.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CODES = len(ALPHABET) + 1
_BLOCK = 256


def _prefix_sums(sizes: Column) -> Column:
    """Sum before each place, in blocks so that long arrays are not copied for each element."""
    none = F.array().cast("array<bigint>")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    total = F.lit(0).cast("bigint")

    def sums(values: Column, start: Column) -> Column:
        grown = F.aggregate(
            values,
            F.struct(start.alias("at"), none.alias("out")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )
        return grown["out"]

    def of_blocks(b: Column) -> Column:
        totals = F.transform(b, lambda v: F.aggregate(v, total, lambda a, x: a + x))
        starts = let(totals, lambda t: sums(t, total))
        return let(starts, lambda s: F.flatten(F.transform(b, lambda v, k: sums(v, F.get(s, k)))))

    return let(blocks, of_blocks)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, match) of each leftmost non-overlapping match, in code points.

    The text is cut at marks put around every match: the pieces alternate
    between what is outside and what matched, and their lengths add up to the
    places. Texts without a match take no part in that.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint,word:string>>")
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def of_parts(p: Column) -> Column:
        sizes = F.transform(p, lambda x: F.char_length(x).cast("bigint"))

        def at(before: Column) -> Column:
            rows = F.transform(
                p,
                lambda x, i: F.struct(
                    F.get(before, i).alias("start"), (F.get(before, i) + F.char_length(x)).alias("end"), x.alias("word")
                ),
            )
            return F.filter(rows, lambda r, i: i % 2 == 1)

        return let(let(sizes, _prefix_sums), at)

    return F.when(text.rlike(pattern), let(parts, of_parts)).otherwise(none)


def _kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["word"].alias("word")))


def _in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = F.create_map(*[x for k, name in enumerate((*KINDS, "markov")) for x in (F.lit(name), F.lit(k))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["word"].alias("word")))
    return F.sort_array(keyed)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, candidates): exact spans by start and kind, and long words outside them, in one scan."""
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def of_text(t: Column) -> Column:
        assign = F.filter(matches(t, _ASSIGN), lambda m: F.char_length(F.regexp_extract(m["word"], f"^{_ASSIGN}$", 1)) >= 6)
        base = F.concat(_kind(assign, "assign"), _kind(matches(t, _ACCESS), "access"), _kind(matches(t, _HEX), "hex"))
        return F.struct(_in_order(base).alias("base"), matches(t, _CANDIDATE).alias("candidates"))

    own = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.inline(F.array(let(F.replace(raw, F.lit(_MARK), F.lit(_OTHER)), of_text))),
    )

    def free(b: Column, c: Column) -> Column:
        return F.filter(c, lambda m: ~F.exists(b, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))

    return own.select("doc_id", "base", let(F.struct("base", "candidates"), lambda s: free(s["base"], s["candidates"])).alias("candidates"))


def _codes(word: Column) -> Column:
    """Character codes of a word; the letter tables are looked up by position."""
    return F.transform(F.split(word, ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(CODES)) - 1)


def _pairs(word: Column) -> Column:
    return let(_codes(word), lambda c: F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda x, i: F.get(c, i) * CODES + x))


@dataclass
class MarkovModels:
    """Log-likelihood ratio of each character pair: random strings against ordinary identifiers."""

    ratios: list[float]

    def score(self, word: Column) -> Column:
        """Mean ratio over the pairs of a word, positive for random strings."""
        table = F.array(*[F.lit(x) for x in self.ratios])

        def mean(pairs: Column) -> Column:
            total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.get(table, p))
            return total / F.greatest(F.size(pairs), F.lit(1))

        return let(_pairs(word), mean)


def train(samples: DataFrame, backoff: float = 8.0, spread: tuple[float, float] = (50.0, 0.5)) -> MarkovModels:
    """Transition counts of labelled samples (word, random): all of them, merged before each shuffle.

    The driver gets one count for each label and pair of characters, of which
    there is a fixed number. A transition's share leans on the share of its
    second character with weight ``backoff``, and that on the uniform share
    with weight ``spread`` (random, ordinary): a random string may use any
    character, an identifier hardly one that identifiers do not use. Without
    samples of a kind its model is uniform.
    """
    pairs = samples.filter("word IS NOT NULL AND random IS NOT NULL").select(F.col("random"), F.explode(_pairs(F.col("word"))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}

    def log_share(kind: bool) -> list[float]:
        table = [[counts.get((kind, a * CODES + b), 0) for b in range(CODES)] for a in range(CODES)]
        weight = spread[0] if kind else spread[1]
        single = [sum(row[b] for row in table) + weight for b in range(CODES)]
        share = [x / sum(single) for x in single]
        return [math.log((x + backoff * share[b]) / (sum(row) + backoff)) for row in table for b, x in enumerate(row)]

    return MarkovModels([round(a - b, 6) for a, b in zip(log_share(True), log_share(False), strict=True)])


def samples_of(scanned: DataFrame) -> DataFrame:
    """Labelled samples of a corpus: values of exact secrets are random, words outside them that have no digit are not."""
    secret = F.transform("base", lambda s: F.regexp_replace(s["word"], f"^{_NAME}", ""))
    plain = F.filter(F.transform("candidates", lambda m: m["word"]), lambda w: ~w.rlike("[0-9]"))
    return scanned.select(F.explode(secret).alias("word"), F.lit(True).alias("random")).union(
        scanned.select(F.explode(plain).alias("word"), F.lit(False).alias("random"))
    )


def find_secrets(
    docs: DataFrame,
    models: MarkovModels | None = None,
    threshold: float = 0.7,
    least: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Secret spans of every whole text: (doc_id, spans with ``base`` marks), with Spark functions only.

    One scan finds the exact spans (assign, access, hex) and the long words
    outside them, and writes both to the shared folder; only these small rows
    are read again. If no models are given they are trained from them: values
    of exact secrets against digit-free words, counted over all documents.
    A long word of ``least`` characters or more with a digit becomes a
    ``markov`` span if its mean log-likelihood ratio exceeds ``threshold``.

    Spans are in code points, end exclusive, by start and then kind. Null
    texts count as empty; equal rows give equal rows; ids may be null; an empty
    table gives no rows; further columns are ignored. Texts of any length are
    scanned whole, and many matches in one text take linear time.
    """
    found = persist_table(scan(docs, id_col, text_col), "secrets")
    models = models or train(samples_of(found))
    likely = F.filter(
        "candidates",
        lambda m: (F.char_length(m["word"]) >= least) & m["word"].rlike("[0-9]") & (models.score(m["word"]) > threshold),
    )
    more = F.when(F.size("candidates") > 0, _kind(likely, "markov")).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:string,word:string>>"))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["word"].alias("word")))
    spans = F.transform(
        _in_order(F.concat(base, more)),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["kind"] != "markov").alias("base"), s["word"].alias("word")),
    )
    return found.select("doc_id", spans.alias("spans"))
