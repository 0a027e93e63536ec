"""Deterministic quality scores of short summaries: six dimensions, a weighted sum, a category, flags in rule order.

Pure column expressions over the trimmed text; no shuffle and no Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, WORD, trim_white

#: Weights, least score to publish, category limits (fixed values).
WEIGHTS = {"clarity": 0.25, "cohesion": 0.25, "anchoring": 0.20, "noise": 0.10, "coverage": 0.10, "alignment": 0.10}
MIN_PUBLISH = 60.0
CATEGORIES = (("Excellent", 85), ("Good", 70), ("Fair", 60), ("Poor", 40))
VERBS = ("provision", "register", "embed", "index")
ROLES = ("manager", "service", "tool", "primitive")


def model_in_text(text: Column, name: str) -> Column:
    """Whether the name stands in the lower-case text as a word; the name is taken literally."""
    return F.lower(text).rlike(rf"(?:^|[^{WORD}]){re.escape(name.lower())}(?:[^{WORD}]|$)")


def score_sections(
    df: DataFrame, models: Sequence[str] = (), verbs: Sequence[str] = VERBS, roles: Sequence[str] = ROLES, text: str = "text"
) -> DataFrame:
    """df with dimensions, composite, category, flags array and matched_models array."""
    names = df.columns
    t = F.coalesce(trim_white(F.col(text)), F.lit(""))
    base = df.withColumns({"__t": t}).withColumns({
        "__n": F.length("__t"),
        "__lines": F.size(F.split("__t", "\n", -1)),
        "__sent": F.greatest(F.regexp_count("__t", F.lit("[.!?]")), F.lit(1)),
        "__code": F.regexp_count("__t", F.lit(r"[{};()\[\]<>]")),
        "__tokens": F.filter(F.split("__t", f"[{WHITE}]+"), lambda x: x != ""),
    })
    base = base.withColumns({
        "__words": F.filter(F.transform("__tokens", lambda x: F.regexp_replace(F.lower(x), "[^a-z]", "")), lambda x: F.length(x) >= 4),
        "__lower": F.array_distinct(F.transform("__tokens", lambda x: F.lower(x))),
        "__noisy": F.size(F.filter("__tokens", lambda x: x.rlike(r"//|/\*|\*/|\p{Nd}|;|=>|namespace|class"))),
        "matched_models": F.array_compact(F.array(*[F.when(model_in_text(F.col("__t"), m), F.lit(m)) for m in models])) if models else F.array().cast("array<string>"),
    })
    n, sent = F.col("__n"), F.col("__sent")
    short, single = n < 40, (sent <= 1) & (n > 120)
    block, code = (F.col("__lines") == 1) & (n > 120), F.try_divide(F.col("__code").cast("double"), n) > 0.15
    ratio = F.try_divide(F.size(F.array_distinct("__words")).cast("double"), F.size("__words"))
    n_models = F.size("matched_models")
    noise = F.try_divide(F.col("__noisy").cast("double"), F.size("__tokens"))
    any_of = lambda xs: F.arrays_overlap("__lower", F.array(*[F.lit(x.strip().lower()) for x in xs if x.strip()]))
    verb, role = any_of(verbs), any_of(roles)
    points = lambda test, k: F.when(test, F.lit(float(k))).otherwise(0.0)
    empty = n == 0
    clarity = F.greatest(100.0 - points(short, 40) - points(single, 15) - points(block, 10) - points(code, 25), F.lit(0.0))
    cohesion = F.when(ratio.isNull(), 60.0).when(ratio > 0.7, 55.0).when(ratio > 0.4, 75.0).otherwise(90.0)
    anchoring = F.when(n_models == 0, 40.0).when(n_models == 1, 80.0).otherwise(95.0)
    coverage = 40.0 + points(n >= 80, 15) + points(n >= 160, 15) + points(sent >= 2, 10) + points(n_models > 0, 10) + points(verb, 10)
    alignment = 50.0 + points(verb, 15) + points(role, 15)
    scores = {
        "clarity": clarity, "cohesion": cohesion, "anchoring": anchoring, "noise": (1.0 - noise) * 100.0, "coverage": coverage, "alignment": alignment,
    }
    out = base.withColumns({k: F.when(~empty, v) for k, v in scores.items()})
    composite = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("composite", F.when(empty, 0.0).otherwise(F.least(F.greatest(composite, F.lit(0.0)), F.lit(100.0))))
    category = F.lit("Reject")
    for name, least in reversed(CATEGORIES):
        category = F.when(F.col("composite") >= least, name).otherwise(category)
    rules = [
        ("VeryShortText", short), ("SingleLongSentence", single), ("SingleLineBlock", block), ("CodeLikeStructure", code),
        ("NoContentWords", ratio.isNull()), ("HighWordDiversity", ratio > 0.7), ("NoDomainModelsDetected", n_models == 0),
        ("HighNoise", noise > 0.3), ("LowCoverage", coverage < 60), ("LowQueryAlignment", alignment < 60),
    ]
    flags = F.array_compact(F.array(*[F.when(test, F.lit(flag)) for flag, test in rules]))
    flags = F.when(empty, F.array(F.lit("EmptyText"))).otherwise(flags)
    out = out.withColumns({"category": category, "flags": flags})
    return out.select(*[F.col(f"`{c}`") for c in names], *WEIGHTS, "composite", "category", "flags", "matched_models")


def publish_gate(composite: Column | str, least: float = MIN_PUBLISH) -> Column:
    c = F.col(composite) if isinstance(composite, str) else composite
    return F.when(c >= least, "Accepted").otherwise("RejectedLowScore")
