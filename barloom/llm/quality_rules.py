"""Quality rules: a decision list learned from labelled statistics, applied as ordered conditional expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import let
from barloom.session import persist_table

LABELLED_ROWS = 20_000
THRESHOLDS = 32
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"

#: What rules may test; every one is a rate or a count of the whole text.
FEATURES = {
    "words": lambda s: s["n_words"].cast("double"),
    "word_length": lambda s: _rate(s["word_chars"], s["n_words"]),
    "symbols_per_word": lambda s: _rate(s["n_symbols"], s["n_words"]),
    "exclamations_per_word": lambda s: _rate(s["n_exclaim"], s["n_words"]),
    "capitals_per_char": lambda s: _rate(s["n_capitals"], s["word_chars"]),
    "repeated_lines": lambda s: _rate(s["n_dup_lines"], s["n_lines"]),
    "repeated_words": lambda s: _rate(s["n_repeat_words"], s["n_words"]),
    "distinct_words": lambda s: _rate(s["n_distinct"], s["n_words"]),
}


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _repeated(words: Column) -> Column:
    """Words inside five-word windows that stand twice or more, counted without rows leaving the document.

    Window hashes are compared first; only a text with equal ones sorts them
    with their places, keeps places whose neighbour in the order has the same
    hash, and adds up what the five-word stretches from there cover.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of_hashes(h: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            return F.xxhash64(x, *(F.get(h, i + k) for k in range(1, 5)))

        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 4, F.lit(0))), window)

    def of_windows(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = F.filter(
                s,
                lambda p, k: F.coalesce(F.get(s, k - 1)["h"] == p["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == p["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(same, lambda p: p["i"]))

        def covered(at: Column) -> Column:
            gaps = F.transform(at, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - p, F.lit(5))))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        some = let(let(ordered, twins), covered)
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(some)

    return let(let(hashes, of_hashes), of_windows)


def statistics(text: Column) -> Column:
    """Counts of one whole text as a struct; null counts as empty."""

    def of_text(t: Column) -> Column:
        words = F.filter(F.split(t, _SPACE), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(_WORD))

        def of_words(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                _repeated(w).alias("n_repeat_words"),
                F.regexp_count(t, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
                F.regexp_count(t, F.lit("!")).cast("bigint").alias("n_exclaim"),
                (F.regexp_count(t, F.lit("\n")) + 1).cast("bigint").alias("n_lines"),
                F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
            )

        return let(words, of_words)

    return let(F.coalesce(text, F.lit("")), of_text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, s: Column) -> Column:
        value = FEATURES[self.feature](s)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, s: Column) -> Column:
    return reduce(lambda a, b: a & b, (c.column(s) for c in rule), F.lit(True))


def rule_number(rules: list[Rule], s: Column) -> Column:
    """1-based number of the first rule that holds, 0 if none does: one ordered conditional expression."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_holds(rule, s), F.lit(k)).otherwise(out)
    return out


def _training_rows(docs: DataFrame, labels: DataFrame, bound: int, id_col: str, text_col: str) -> DataFrame:
    """Statistics of at most about ``bound`` labelled documents that pass the base rules, 2 of 3 to grow on."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    share = min(1.0, bound / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    chosen = chosen.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "bad", F.inline(F.array(statistics(F.col("text")))))
    s = F.struct("*")
    flat = rows.select("doc_id", "bad", s.alias("s")).filter(~base_failed(F.col("s")))
    grow = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2
    table = flat.select("bad", grow.alias("grow"), *[f(F.col("s")).alias(n) for n, f in FEATURES.items()])
    return persist_table(table, "labelled")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    bound: int = LABELLED_ROWS,
    max_rules: int = 12,
    max_conditions: int = 3,
    precision: float = 0.9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[Rule]:
    """Sequential covering: conjunctions of thresholds that pick out documents labelled ``quality`` 0.

    A rule grows by the threshold of highest information gain over the rows it
    still covers, until it covers no good row or has ``max_conditions``; it is
    then pruned to the beginning with the best precision on rows it did not grow
    on, and kept if that reaches ``precision``. Covered rows leave, and the next
    rule grows on the rest. Candidate thresholds are quantiles, so each step
    is one small aggregation; the driver sees only counts by feature and bin.

    Training reads at most about ``bound`` labelled rows, chosen by a hash of
    their id. Without labelled rows of both kinds the list is empty.
    """
    rows = _training_rows(docs, labels, bound, id_col, text_col)
    names = list(FEATURES)
    at = [k / (THRESHOLDS + 1) for k in range(1, THRESHOLDS + 1)]
    cuts = rows.agg(*[F.percentile_approx(n, at, 10_000).alias(n) for n in names]).first().asDict()
    cuts = {n: sorted(set(v)) for n, v in cuts.items() if v}
    if not cuts:
        return []
    bins = [
        F.struct(F.lit(n).alias("feature"), sum((F.col(n) >= c).cast("int") for c in cuts[n]).alias("bin")) for n in cuts
    ]
    rules: list[Rule] = []
    while len(rules) < max_rules:
        s = F.struct(*names)
        left = rows
        for done in rules:
            left = left.filter(~_on_columns(done))
        rule: Rule = ()
        while len(rule) < max_conditions:
            inside = left.filter("grow").filter(_on_columns(rule))
            counts = inside.select("bad", F.inline(F.array(*bins))).groupBy("feature", "bin").agg(
                F.sum(F.col("bad").cast("bigint")).alias("p"), F.sum((~F.col("bad")).cast("bigint")).alias("n")
            )
            best = _best_condition(counts.collect(), cuts)
            if best is None:
                break
            rule, pure = (*rule, best[0]), best[1]
            if pure:
                break
        if not rule:
            break
        heads = [rule[: k + 1] for k in range(len(rule))]
        scores = left.filter("NOT grow").agg(
            *[F.sum((_on_columns(h) & F.col("bad")).cast("bigint")).alias(f"p{k}") for k, h in enumerate(heads)],
            *[F.sum((_on_columns(h) & ~F.col("bad")).cast("bigint")).alias(f"n{k}") for k, h in enumerate(heads)],
        ).first()
        worth = [((scores[f"p{k}"] or 0) / ((scores[f"p{k}"] or 0) + (scores[f"n{k}"] or 0) or 1), -k) for k in range(len(heads))]
        value, k = max(worth)
        if value < precision:
            break
        rules.append(heads[-k])
        del s
    return rules


def _on_columns(rule: Rule) -> Column:
    tests = (F.col(c.feature) >= c.threshold if c.at_least else F.col(c.feature) < c.threshold for c in rule)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _best_condition(counts: list, cuts: dict[str, list[float]]) -> tuple[Condition, bool] | None:
    """The threshold with the highest gain p * (log2 precision after - log2 precision before)."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r.feature, {})[r.bin] = (r.p, r.n)
    best = None
    for feature, bins in sorted(by.items()):
        p_all, n_all = sum(p for p, _ in bins.values()), sum(n for _, n in bins.values())
        if not p_all or not n_all:
            return None
        before = math.log2(p_all / (p_all + n_all))
        for k, cut in enumerate(cuts[feature], 1):
            p = sum(v[0] for b, v in bins.items() if b >= k)
            n = sum(v[1] for b, v in bins.items() if b >= k)
            for at_least, pp, nn in ((True, p, n), (False, p_all - p, n_all - n)):
                gain = pp * (math.log2(pp / (pp + nn)) - before) if pp else 0.0
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, Condition(feature, at_least, cut), nn == 0)
    return best and best[1:]


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every document, in one scan without a shuffle.

    Columns: ``doc_id``, the counts of :func:`statistics`, ``base_failed``,
    ``rule`` (number of the first rule that holds, 0: none) and ``kept``.

    A null or empty text has no words and fails the base. Equal rows give equal
    rows, ids may be null, further columns are ignored, an empty table gives no
    rows. Texts of any length are counted whole.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = own.select("doc_id", F.inline(F.array(statistics(F.col("text")))))
    s = F.struct(*[c for c in counted.columns if c != "doc_id"])
    names = [c for c in counted.columns if c != "doc_id"]
    judged = counted.select("*", base_failed(s).alias("base_failed"), rule_number(rules, s).alias("rule"))
    return judged.select(
        "doc_id", *names, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept")
    )


def passing(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows whose text passes the base and every rule, with all their columns."""
    good = let(statistics(F.col(f"`{text_col}`").cast("string")), lambda s: ~base_failed(s) & (rule_number(rules, s) == 0))
    return docs.filter(good)
