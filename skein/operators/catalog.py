"""Catalog joins and entity lists: routes, domains, models, samples, paging, votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_white

#: Patterns of a catalogue of workflows at most.
MOST_PATTERNS = 2000


def route_join_stats(pickers: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: pickers, with_url, matched (a picker counts once per route), unmatched."""
    p = pickers.withColumn("__url", F.nullif("picker_url_norm", F.lit("")))
    r = routes.where("full_route_norm IS NOT NULL AND full_route_norm <> ''").groupBy("full_route_norm").agg(F.count("*").alias("__k"))
    j = p.join(r, p["__url"] == r["full_route_norm"], "left")
    return j.agg(
        F.count("*").alias("pickers"), F.count("__url").alias("with_url"), F.coalesce(F.sum("__k"), F.lit(0)).cast("long").alias("matched"),
        F.count_if(F.col("__url").isNotNull() & F.col("__k").isNull()).alias("unmatched"),
    )


def domains_with_classes(domains: DataFrame, classes: DataFrame, key: str, class_key: str, name: str) -> DataFrame:
    """domains with the sorted names of their classes, an empty array where there are none; keys compare ignoring case."""
    own = classes.groupBy(F.lower(F.col(class_key).cast("string")).alias("__k")).agg(F.array_sort(F.collect_list(name)).alias("classes"))
    out = domains.withColumn("__k", F.lower(F.col(key).cast("string"))).join(own, "__k", "left").drop("__k")
    return out.withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))


def domain_for_class(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """asked (name) with the domain of a class (simple, qualified, domain) by either name: two equi-joins, not one with OR."""
    by = classes.select(F.lower("simple").alias("__n"), "domain").unionByName(classes.select(F.lower("qualified").alias("__n"), "domain")).distinct()
    first = by.groupBy("__n").agg(F.min("domain").alias("domain"))
    return asked.withColumn("__n", F.lower("name")).join(first, "__n", "left").drop("__n")


def model_for_fact(facts: DataFrame, models: DataFrame) -> DataFrame:
    """facts (fact_id, entity) with the model (model, domain) of that name, else of the least name that ends with it.

    Suffixes are looked up by equality: each model is listed under all suffixes that start after a dot.
    """
    parts = F.split("model", r"\.")
    tails = models.select("model", "domain", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("__tail"))
    ranked = tails.groupBy("__tail").agg(F.min_by(F.struct("model", "domain"), F.struct(F.col("model") != F.col("__tail"), F.col("model"))).alias("m"))
    return facts.join(ranked, facts["entity"] == ranked["__tail"], "left").select(*facts.columns, "m.model", "m.domain")


def most_frequent(df: DataFrame, group: str, value: str) -> DataFrame:
    """The value that a group has most often, the least of equals, and how often."""
    n = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    best = n.groupBy(group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b"))
    return best.select(group, f"b.{value}", "b.n")


def page(df: DataFrame, order: Sequence[Column], size: int = 50, index: int = 1) -> DataFrame:
    """Page `index` (from 0) in a total order."""
    return df.orderBy(*order).offset(index * size).limit(size)


def page_after(df: DataFrame, keys: Sequence[str], last: Sequence, size: int = 50) -> DataFrame:
    """The page after the keys `last`: a filter that reaches the scan, whatever the depth."""
    test = F.lit(False)
    for i in range(len(keys)):
        same = F.lit(True)
        for k, v in zip(keys[:i], last[:i], strict=True):
            same = same & (F.col(k) == v)
        test = test | (same & (F.col(keys[i]) > last[i]))
    return df.where(test).orderBy(*keys).limit(size)


def key_in_use(probes: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """probes with in_use: whether an entity has the key."""
    used = entities.select(F.col(key).alias("__k")).distinct().withColumn("in_use", F.lit(True))
    out = probes.join(used, probes[key] == used["__k"], "left").drop("__k")
    return out.withColumn("in_use", F.coalesce("in_use", F.lit(False)))


def next_in_sequence(df: DataFrame, group: str, identifier: str, pattern: str, shape: str) -> DataFrame:
    """Per group the next identifier: one more than the largest number that the pattern finds."""
    found = F.max(F.regexp_extract(identifier, pattern, 1).try_cast("long"))
    return df.groupBy(group).agg((F.coalesce(found, F.lit(0)) + 1).alias("next_number")).withColumn("next_id", F.format_string(shape, F.col(group), F.col("next_number")))


def distinct_tags(df: DataFrame, tags: Column) -> DataFrame:
    """Distinct tags ignoring case, in their least casing."""
    each = df.select(F.explode(tags).alias("tag")).withColumn("tag", trim_white("tag")).where("tag <> ''")
    return each.groupBy(F.lower("tag").alias("key")).agg(F.min("tag").alias("tag"), F.count("*").alias("n"))


def authoritative_lookup(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """questions (question_id, question_hash) with status NotFound, Conflict or Answered, the answer and where it is from.

    entries: entry_id, question_hash, model_answer, human_answer, identifier, source_ref, confidence, is_active.  The answer
    is the model's unless that is null; a blank one counts, but is no answer for conflicts.
    """
    answer = F.coalesce("model_answer", "human_answer")
    active = entries.where("is_active").withColumn("answer", answer)
    said = F.lower(F.nullif(trim_white(F.col("answer")), F.lit("")))
    first = F.struct(
        "answer", F.coalesce("source_ref", F.concat(F.lit("ref:"), "identifier")).alias("source_ref"), F.coalesce("confidence", F.lit("high")).alias("confidence")
    )
    per = active.groupBy("question_hash").agg(F.count_distinct(said).alias("__answers"), F.min_by(first, "entry_id").alias("__f"), F.count("*").alias("matches"))
    out = questions.join(per, "question_hash", "left")
    status = F.when(F.col("matches").isNull(), "NotFound").when(F.col("__answers") > 1, "Conflict").otherwise("Answered")
    answered = lambda c: F.when(status == "Answered", F.col(f"__f.{c}"))
    return out.select(
        *questions.columns, status.alias("status"), F.coalesce("matches", F.lit(0)).alias("matches"), answered("answer").alias("answer"),
        answered("source_ref").alias("source_ref"), answered("confidence").alias("confidence"),
    )


def resolver_score(name: Column, identity: Column, asked: str, aliases: Column | None = None, keywords: Column | None = None) -> Column:
    """1.0 for the identity, 0.95 an alias, 0.8 a name that contains the input, 0.6 a keyword that does, else 0."""
    a = asked.strip().lower()
    has = lambda c: F.exists(c, lambda x: F.contains(F.lower(x), F.lit(a)))
    out = F.when(F.lower(identity) == a, 1.0)
    if aliases is not None:
        out = out.when(F.exists(aliases, lambda x: F.lower(x) == a), 0.95)
    out = out.when(F.contains(F.lower(name), F.lit(a)), 0.8)
    if keywords is not None:
        out = out.when(has(keywords), 0.6)
    return out.otherwise(0.0)


def intent_matches(texts: DataFrame, workflows: DataFrame, text: str = "text") -> DataFrame:
    """texts with the workflows (workflow, patterns array, status) of which the lower-case text contains a pattern.

    Workflows are a catalogue: more than MOST_PATTERNS patterns are an error; disabled ones are left out.  Each text is tested
    where it lies, and of the patterns of a workflow that it contains the least counts.
    """
    each = workflows.where("status <> 'Disabled'").select("workflow", F.explode("patterns").alias("pattern")).where("trim(pattern) <> ''")
    listed = each.limit(MOST_PATTERNS + 1).collect()
    if len(listed) > MOST_PATTERNS:
        raise ValueError("more patterns than a catalogue holds")
    found: dict[str, Column] = {}
    for workflow, pattern in sorted(((r["workflow"], r["pattern"]) for r in listed), reverse=True):
        hit = F.when(F.contains(F.lower(F.col(text)), F.lit(pattern.lower())), F.struct(F.lit(workflow).alias("workflow"), F.lit(pattern).alias("pattern")))
        found[workflow] = F.coalesce(hit, found[workflow]) if workflow in found else hit
    if not found:
        return texts.where("1 = 0").select("*", F.lit("").alias("workflow"), F.lit("").alias("pattern"), F.lit(1.0).alias("score"))
    return texts.select("*", F.inline(F.array_compact(F.array(*found.values())))).withColumn("score", F.lit(1.0))
