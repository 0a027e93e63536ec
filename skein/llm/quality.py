"""Quality rules: a learned decision list over text statistics, applied as one Spark conditional expression.

Statistics are column expressions.  The list is learned by sequential covering on a bounded sample of labelled documents:
Spark sums the sample into cells of binned statistics, label and fold; each rule grows by the threshold condition of best
information gain on two thirds of it, is pruned on the other third, and stays while it is precise there.  A rule names low
quality; a document that no rule names is kept.

Defined cases: a null or empty text has no words, lines or symbols and fails the base rules; labels that are null, of one
class or absent give no rules, so that the base rules alone decide; an empty table gives an empty result; repeated rows
are judged alike; other columns pass through `filter_documents` and are ignored elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table

#: Labelled documents that the list is learned from at most, chosen by the hash of their id.
TRAIN_ROWS = 20_000
BINS = 24
MAX_RULES, MAX_CONDITIONS = 12, 4
#: Share of low-quality documents among those that a rule names, on the pruning third and overall.
MIN_PRECISION = 0.97
MIN_COVER = 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The statistics that conditions may test, as shares, so that one threshold fits texts of any length.
FEATURES = ["symbol_share", "upper_share", "stress_share", "digit_share", "repeat_share", "dup_line_share", "distinct_share", "mean_word"]


#: White space, as characters to trim and as the contracts' class.
_WHITE = " \t\n\x0b\f\r"
#: Marks and letters that the statistics count; all else is dropped once, so each count reads few characters.
_COUNTED = {"n_symbols": r"#*$%&|<>", "__upper": r"\p{Lu}", "__stress": "!?", "__digits": "0-9"}


def _windows(words: Column) -> Column:
    """64-bit hashes of the 3-word windows, by place."""
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _covered(placed: Column, words: Column) -> Column:
    """Number of words inside windows that occur twice or more, from sorted (hash, place); equal hashes are confirmed on the words."""

    def same(a: Column, b: Column) -> Column:
        out = a["h"] == b["h"]
        for k in range(3):
            out = out & (F.get(words, a["i"] + k) == F.get(words, b["i"] + k))
        return out

    following = F.slice(placed, F.lit(2), F.size(placed))
    twice = F.filter(F.zip_with(placed, following, lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    places = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(twice)), lambda i: F.array(i, i + 1, i + 2))))
    return F.size(places).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five base counts and FEATURES; columns of these names are replaced."""
    made = {*BASE, *FEATURES}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in made]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    inner = F.btrim(t, F.lit(_WHITE))
    few = F.regexp_replace(t, "[^" + "".join(_COUNTED.values()) + "]++", "")
    first = docs.select(
        row, F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE, -1)).alias("words"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), few.alias("few"),
    )
    second = first.select(
        "row", "words", _windows(F.col("words")).alias("windows"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).alias("__distinct"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("__n_lines"),
        *[F.length(F.regexp_replace("few", f"[^{marks}]++", "")).cast("long").alias(name) for name, marks in _COUNTED.items()],
    )
    names = [c for c in second.columns if c != "windows"]
    # most texts repeat no window, which a hash set tells; only the others are sorted
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    third = second.select(*names, F.when(repeats, placed).alias("placed"))
    names = [c for c in names if c != "words"]
    fourth = third.select(*names, F.when(F.col("placed").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("placed"), F.col("words"))).alias("n_repeat_words"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 6)
    shares = [
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("__upper", "word_chars").alias("upper_share"),
        share("__stress", "n_words").alias("stress_share"),
        share("__digits", "word_chars").alias("digit_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "__n_lines").alias("dup_line_share"),
        share("__distinct", "n_words").alias("distinct_share"),
        share("word_chars", "n_words").alias("mean_word"),
    ]
    # one generated row: filters on the statistics stay above it, else they would repeat the whole computation below
    return fourth.select("row", F.inline(F.array(F.struct(*BASE, *shares)))).select(*kept, *BASE, *FEATURES)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[Rule]:
    """The rules for low quality, in the order in which they apply; docs has doc_id and text, labels doc_id and quality."""
    # of labels that differ the lower one counts, and of rows with one id the least text
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # bounded by train_rows
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    train = with_statistics(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")))
    train = train.where(~base_failed()).select("doc_id", "quality", *FEATURES).persist()
    try:
        steps = [i / BINS for i in range(1, BINS)]
        low = F.col("quality") == 0
        cuts = train.agg(*[F.percentile_approx(f, steps, 1000).alias(f) for f in FEATURES],
                         *[F.percentile_approx(F.when(low, F.col(f)), steps, 1000).alias(f"low_{f}") for f in FEATURES]).first()
        edges = {f: sorted({*(cuts[f] or ()), *(cuts[f"low_{f}"] or ())}) for f in FEATURES}
        if not any(edges.values()):
            return []
        bins = [_bin(f, edges[f]).alias(f) for f in FEATURES]
        fold = (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)) == 0).alias("prune")
        cells = train.select(*bins, fold, low.alias("low")).groupBy(*FEATURES, "prune", "low").count().collect()  # at most train_rows
    finally:
        train.unpersist()
    return _cover([(tuple(c[f] for f in FEATURES), c["prune"], c["low"], c["count"]) for c in cells], edges)


def _bin(feature: str, edges: list[float]) -> Column:
    """How many edges lie below the feature."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(feature)))


def _holds(rule: list[tuple[int, bool, int]], bins: tuple) -> bool:
    return all((bins[f] > k) == above for f, above, k in rule)


def _counts(rule, cells) -> tuple[int, int]:
    p = n = 0
    for bins, _, low, count in cells:
        if _holds(rule, bins):
            p, n = (p + count, n) if low else (p, n + count)
    return p, n


def _grow(cells: list, edges: dict) -> list[tuple[int, bool, int]]:
    """Adds the condition of best gain until no document of good quality is covered."""
    rule: list[tuple[int, bool, int]] = []
    inside = cells
    while len(rule) < MAX_CONDITIONS:
        p, n = _counts([], inside)
        if not p or not n:
            break
        best, best_gain = None, 1e-9
        for f, name in enumerate(FEATURES):
            size = len(edges[name]) + 1
            pos, neg = [0] * size, [0] * size
            for bins, _, low, count in inside:
                (pos if low else neg)[bins[f]] += count
            cp = cn = 0
            for k in range(size - 1):
                cp, cn = cp + pos[k], cn + neg[k]
                for above, (a, b) in ((True, (p - cp, n - cn)), (False, (cp, cn))):
                    if a >= MIN_COVER:
                        gain = a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))
                        if gain > best_gain:
                            best, best_gain = (f, above, k), gain
        if best is None:
            break
        rule.append(best)
        inside = [c for c in inside if _holds([best], c[0])]
    return rule


def _cover(cells: list, edges: dict) -> list[Rule]:
    """Sequential covering: grows, prunes and keeps rules until one is not precise enough."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _grow([c for c in cells if not c[1]], edges)
        held_out = [c for c in cells if c[1]]

        def worth(r, held_out=held_out) -> float:
            p, n = _counts(r, held_out)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            break
        p, n = _counts(rule, held_out)
        ap, an = _counts(rule, cells)
        if ap < MIN_COVER or ap < MIN_PRECISION * (ap + an) or p < MIN_PRECISION * (p + n):
            break
        rules.append(tuple(Condition(FEATURES[f], above, edges[FEATURES[f]][k]) for f, above, k in rule))
        cells = [c for c in cells if not _holds(rule, c[0])]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null where none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        held = F.lit(True)
        for c in rules[k - 1]:
            held = held & c.column()
        out = F.when(held, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with statistics, base_failed, rule (the first that names the document) and kept; columns of these names are replaced."""
    rules = learn(docs, labels, train_rows)
    kept = [c for c in docs.columns if c not in ("base_failed", "rule", "kept")]
    out = with_statistics(docs.select(*[F.col(f"`{c}`") for c in {*kept, "text"}])).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    made = [*BASE, *FEATURES, "base_failed", "rule", "kept"]
    return out.select(*[F.col(f"`{c}`") for c in kept if c not in made], *made)


def filter_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are kept, with their own columns."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id"), F.col("text"))
    return judge(own, labels, train_rows).where("kept").select("whole.*")


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from at most TRAIN_ROWS of the labelled ones."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "rule")


QUERIES = {"op7_decision_list": op7_decision_list}
ORACLE_SQL: dict[str, str] = {}
