"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct 5-word shingles.  Register i of a SetSketch holds the least of the set's exponential
hash values, on a scale of powers of `BASE` and truncated, so sketches of parts merge by maximum and equal registers tell
similar sets.  The steps:

1. Texts become sketches, sizes and set digests; documents of equal sets are one class, so copies meet nowhere below.
2. Bands of registers are bucket keys.  In each bucket the least class is the hub; the others are paired with it alone.
3. A pair whose sizes exclude the threshold is dropped; so is one whose joint likelihood, with both sizes known, speaks
   against the threshold by far (CUT; about seven standard deviations).  The rest are verified on their full shingle sets.
4. Verified links give components.  In buckets that still hold several components, pairs across these are tested too, as a
   hub need not be like two classes that are like each other.  Buckets of up to SMALL classes form those pairs.  Of larger
   ones, such as of documents that share a long passage, a class is left out that has less than three quarters of its
   shingles in common with the classes of other components there, all together: it cannot have a link to any.  What is
   left is compared by sketch in blocks of bounded size; what may be linked there falls into families, and these are
   verified on full sets, in blocks bounded in rows and in shingles.  A block returns only the links that join components.

So a class travels once for each band and each shingle, but in a large bucket of classes that have three quarters of their
shingles in common and still are of several components: there it travels once more for each BLOCK of others.

With 40 bands of 4 registers a pair of similarity 0.75 shares no bucket with probability 2.5e-7.

Defined cases: a null or empty text, or one of white space, has no shingles and is linked with nothing; fewer than five
words are one shingle; a null doc_id counts as the largest, 2 ** 63 - 1, which comes back as null; repeated rows are copies; an empty table gives an empty result;
other columns pass through `keep_one` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_memos, materialize, table
from .components import components
from .hashing import Words, batches, mix, shingles

#: Least similarity of a link in hundredths, and words of a shingle.
SIMILARITY, WORDS = 75, 5
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: SetSketch: base, rate and number of levels.
BASE, RATE, LEVELS = 1.001, 20.0, (1 << 16) - 2
#: Largest bucket whose pairs across components become rows; classes in a block of sketches and of full sets, and shingles there.
SMALL, SKETCH_BLOCK, SET_BLOCK, SET_SHINGLES = 16, 2048, 1024, 1 << 18
#: Equal registers at least of a pair that may be linked; 7 standard deviations below those of the threshold.
LEAST_EQUAL = 80
#: Log-likelihood that the threshold may lie below the best similarity.
CUT = 24.0
_NO_ID = (1 << 63) - 1
_seeds = np.random.default_rng(40_961)
_FLIP = _seeds.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_FACTOR = _seeds.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(elements), 512):  # the working set stays in the cache
            part = elements[at : at + 512, None] ^ _FLIP
            part *= _FACTOR
            np.minimum(least, part.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    value = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LEVELS + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _log_likelihood(j: np.ndarray, greater, less, equal, u, v) -> np.ndarray:
    """Of similarity j for two sketches, by how many registers of the first are greater, less and equal; u + v = 1."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return greater * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))


def plausible(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the threshold is plausible for pairs of sketches, by the numbers of registers of the first that are greater
    and less and the known sizes of the sets."""
    out = REGISTERS - greater - less >= LEAST_EQUAL
    for at in range(0, len(out), 4096):
        part = np.flatnonzero(out[at : at + 4096]) + at
        up, down = greater[part].astype(float)[:, None], less[part].astype(float)[:, None]
        equal = REGISTERS - up - down
        # shares of each set in the joint size; the similarity can be min / max at most
        u, v = (n_a[part] / (n_a[part] + n_b[part]))[:, None], (n_b[part] / (n_a[part] + n_b[part]))[:, None]
        top = np.minimum(u / v, v / u)
        grid = np.linspace(0.4, 1, 31)[None, :] * top
        best = _log_likelihood(grid, up, down, equal, u, v)
        goal = _log_likelihood(np.minimum(SIMILARITY / 100, top), up, down, equal, u, v)[:, 0]
        peak = grid[np.arange(len(grid)), best.argmax(axis=1)]
        out[part] = (peak >= SIMILARITY / 100) | (best.max(axis=1) - goal <= CUT)
    return out


def _digest(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        a, b = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), mix(s ^ np.uint64(0x14057B7EF767814F)).sum()
    return a.tobytes() + b.tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """id, body (a hash of the text), n_shingles, set_id (a digest; null for an empty set) and registers of each row of docs (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_memos()
        cut = Words()
        for pdf in batches(frames):
            sets = [shingles(w, WORDS) for w in cut.of(pdf["text"].tolist())]
            yield pd.DataFrame({
                "id": pdf["id"].to_numpy(), "body": pdf["body"].to_numpy(), "n_shingles": [len(s) for s in sets], "set_id": [_digest(s) if len(s) else None for s in sets],
                "registers": [registers(s).tobytes() if len(s) else None for s in sets],
            })

    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("body"), "text")
    return rows.mapInPandas(run, "id long, body long, n_shingles long, set_id binary, registers binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and elements, the shingles of each class in wanted (node, rep, body, set_id): a text is found by its id and its hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_memos()
        cut = Words()
        for pdf in batches(frames, 256):
            sets = [shingles(w, WORDS).view(np.int64) for w in cut.of(pdf["text"].tolist())]
            same = [len(s) > 0 and _digest(s.view(np.uint64)) == bytes(d) for s, d in zip(sets, pdf["set_id"], strict=True)]
            yield pd.DataFrame({"node": pdf["node"].to_numpy()[same], "elements": [s for s, ok in zip(sets, same, strict=True) if ok]})

    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("rep"), F.xxhash64("text").alias("body"), "text")
    texts = rows.join(wanted.hint("shuffle_hash"), ["rep", "body"]).select("node", "set_id", "text")
    return texts.mapInPandas(run, "node long, elements array<bigint>").dropDuplicates(["node"])


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches do not exclude a link."""
    left = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a"))
    right = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b"))

    @F.pandas_udf("boolean")
    def likely(r_a: pd.Series, r_b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        greater, less = [], []
        for at in range(0, len(r_a), 2048):
            a, b = (np.frombuffer(b"".join(r.iloc[at : at + 2048]), "<u2").reshape(-1, REGISTERS) for r in (r_a, r_b))
            greater.append((a > b).sum(axis=1))
            less.append((a < b).sum(axis=1))
        if not greater:
            return pd.Series([], dtype=bool)
        return pd.Series(plausible(np.concatenate(greater), np.concatenate(less), n_a.to_numpy(float), n_b.to_numpy(float)))

    near = pairs.join(left, "a").join(right, "b")
    near = near.where(100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b"))
    return near.where(likely("r_a", "r_b", "n_a", "n_b")).select("a", "b", "n_a", "n_b")


def _linked(shared: Column, n_a: Column, n_b: Column) -> Column:
    return 100 * shared >= SIMILARITY * (n_a + n_b - shared)


def _linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that are links on their full sets; a is the side that many pairs share, so b's sets travel."""
    moved = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("e_b")), "b")
    met = moved.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("e_a")), "a")
    shared = F.size(F.array_intersect("e_a", "e_b")).cast("long")
    return met.where(_linked(shared, F.col("n_a"), F.col("n_b"))).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _block_pairs(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """rows (group, node), of a group in so many blocks, once for each pair of blocks i <= j that its own block is in."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def _within_reach(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those nodes (node, comp, n_shingles) of which three quarters of the shingles are in sets of other components, each somewhere.

    A link has three quarters of the shingles of either side in common, so the others have none.  Two rounds, as those that
    go take their shingles along.
    """
    for k in range(2):
        each = sets.join(nodes, "node").select("node", "comp", "n_shingles", F.explode("elements").alias("x"))
        common = each.groupBy("x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("x")
        met = each.join(common, "x").groupBy("node", "comp", "n_shingles").agg(F.count("*").alias("m"))
        nodes = materialize(met.where(F.col("m") * 100 >= F.col("n_shingles") * SIMILARITY).drop("m"), f"within_reach{k}")
    return nodes


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two blocks that a group of _block_pairs compares."""
    own, i, j = pdf["own"].to_numpy(), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def _open_pairs(pdf: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows a and b are across components, of sizes that allow a link, and not the mirror of another."""
    comp, size = pdf["comp"].to_numpy(), pdf["n_shingles"].to_numpy(np.int64)
    least, most = np.minimum(size[a][:, None], size[b]), np.maximum(size[a][:, None], size[b])
    ok = (comp[a][:, None] != comp[b]) & (100 * least >= SIMILARITY * most)
    same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    return ok & (a[:, None] < b) if same else ok


def _joining(labels: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those pairs of rows that join different labels, one after the other: a forest."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for x, y in pairs.tolist():
        p, q = top(int(labels[x])), top(int(labels[y]))
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _edges(pdf: pd.DataFrame, pairs: list[tuple[int, int]]) -> pd.DataFrame:
    node = pdf["node"].to_numpy()
    return pd.DataFrame({"a": [node[x] for x, _ in pairs], "b": [node[y] for _, y in pairs]}, dtype="int64")


def _maybe_linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Classes of two blocks that may be linked, directly or not, by their sketches: pairs with the least of each family.

    Many buckets hold the same family; as its least class is mostly the same too, their pairs coincide.
    """
    pdf = pdf.sort_values("node", ignore_index=True)
    a, b = _sides(pdf)
    top = list(range(len(pdf)))
    sketch = np.frombuffer(b"".join(pdf["registers"]), "<u2").reshape(-1, REGISTERS)
    size = pdf["n_shingles"].to_numpy(float)
    for t in range(0, len(a), 256):  # the counts of a tile stay in the cache
        part = a[t : t + 256]
        open_ = _open_pairs(pdf, part, b)
        if not open_.any():
            continue
        greater, less = np.zeros(open_.shape, np.int16), np.zeros(open_.shape, np.int16)
        for k in range(REGISTERS):
            x, y = sketch[part, k][:, None], sketch[b, k]
            greater += x > y
            less += x < y
        at = np.argwhere(open_)
        ok = plausible(greater[open_], less[open_], size[part[at[:, 0]]], size[b[at[:, 1]]])
        for x, y in zip(part[at[ok, 0]].tolist(), b[at[ok, 1]].tolist(), strict=True):
            p, q = _root(top, x), _root(top, y)
            top[max(p, q)] = min(p, q)
    return _edges(pdf, [(p, x) for x in range(len(pdf)) if (p := _root(top, x)) != x])


def _root(top: list[int], x: int) -> int:
    while top[x] != x:
        top[x] = x = top[top[x]]
    return x


def _surely_linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """The links between two blocks of full sets that join components."""
    a, b = _sides(pdf)
    open_ = _open_pairs(pdf, a, b)
    if not open_.any():
        return _edges(pdf, [])
    sets = [np.asarray(x, np.int64) for x in pdf["elements"]]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = owner[times[column] > 1], column[times[column] > 1]  # only elements of two sets or more
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros(open_.shape, np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        holds = np.zeros((len(sets), 4096), np.float32)  # SET_BLOCK bounds the sets
        holds[owner[lo:hi], column[lo:hi] - at] = 1
        shared += holds[a] @ holds[b].T
    size = pdf["n_shingles"].to_numpy(np.int64)
    shared = shared.astype(np.int64)
    at = np.argwhere(open_ & (100 * shared >= SIMILARITY * (size[a][:, None] + size[b] - shared)))
    return _edges(pdf, _joining(pdf["comp"].to_numpy(), np.column_stack([a[at[:, 0]], b[at[:, 1]]])))


def _across(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a bucket; members has key, node and hub."""
    rows = members.join(labels, "node", "left").select("key", "node", "hub", F.coalesce("comp", "node").alias("comp"))
    rows = materialize(rows, "labelled")
    mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    rows = rows.join(mixed.select("key", "n"), "key")

    few = rows.where(F.col("n") <= SMALL).where("node <> hub")  # hubs have met all others
    x, y = few.select("key", F.col("node").alias("x"), F.col("comp").alias("cx")), few.select("key", F.col("node").alias("y"), F.col("comp").alias("cy"))
    pairs = x.join(y, "key").where("cx < cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = materialize(_alike(pairs, classes), "cross_pairs")

    many = rows.where(F.col("n") > SMALL).select("key", "node", "comp")
    nodes = many.select("node", "comp").distinct().join(classes.select("node", "n_shingles"), "node")
    wanted = materialize(_ends(pairs).unionByName(nodes.select("node")).distinct(), "cross_nodes")
    sets = materialize(_sets(docs, classes.join(wanted, "node").select("node", "rep", "body", "set_id")), "cross_sets")
    nodes = _within_reach(sets, nodes)

    many = materialize(many.join(nodes.select("node"), "node", "left_semi"), "cross_many")
    left = many.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "n")
    many = many.join(left, "key").join(classes.select("node", "n_shingles", "registers"), "node")
    maybe = _block_pairs(many, "key", F.ceil(F.col("n") / SKETCH_BLOCK)).groupBy("key", "i", "j").applyInPandas(_maybe_linked, "a long, b long")
    families = materialize(components(materialize(maybe.distinct(), "cross_maybe")), "cross_families").withColumnRenamed("comp", "family")

    families = families.join(nodes, "node")
    count = families.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n_shingles") / SET_SHINGLES)).alias("blocks"))
    full = families.join(count, "family").join(sets, "node")
    joined = _block_pairs(full, "family", F.col("blocks")).groupBy("family", "i", "j").applyInPandas(_surely_linked, "a long, b long")
    return _linked_pairs(pairs, sets).unionByName(joined)


def _classified(docs: DataFrame) -> DataFrame:
    """id, body, n_shingles, comp (null without shingles) and component, the least id there, for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = materialize(sketches(docs), "sketches")
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("set_id").agg(F.min(F.struct("id", "body")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = classes.select("set_id", F.col("least.id").alias("rep"), F.col("least.body").alias("body"), "n_shingles", "registers")
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = classes.select("node", F.explode(key).alias("key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(bands.join(hubs, "key"), "members")

    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = materialize(_alike(stars, classes), "star_pairs")
    sets = materialize(_sets(docs, classes.join(_ends(pairs), "node").select("node", "rep", "body", "set_id")), "star_sets")
    links = materialize(_linked_pairs(pairs, sets), "star_links")
    labels = components(links)
    more = materialize(_across(members, labels, classes, docs), "cross_links")
    if more.take(1):
        labels = components(links.unionByName(more))

    named = classes.select("node", "rep", "set_id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = materialize(named.select("set_id", "rep", "comp"), "named")
    first = named.groupBy("comp").agg(F.min("rep").alias("component"))
    of_set = named.join(first, "comp").select("set_id", "comp", "component")
    joined = full.select("id", "body", "n_shingles", "set_id").join(of_set, "set_id").drop("set_id")
    alone = rows.where("n_shingles = 0").select("id", "body", "n_shingles", F.lit(None).cast("long").alias("comp"), F.col("id").alias("component"))
    return joined.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    return _classified(docs).select(
        F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "n_shingles", F.nullif("component", F.lit(_NO_ID)).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, one of least doc_id and of these the one of least hash of its text, with its own
    columns, whatever their names; rows of one id and text count as one.  Columns that cannot be ordered, such as maps, pass through."""
    found = _classified(docs).where("id = component")
    first = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("id", "body")).alias("x")).select("x.*")
    kept = first.unionByName(found.where("comp IS NULL").select("id", "body")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("body"))
    return rows.join(kept.hint("shuffle_hash"), ["id", "body"], "left_semi").dropDuplicates(["id", "body"]).select("row.*")


def op1_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, five words, 75 hundredths."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op1_setsketch_dedup": op1_setsketch_dedup}
ORACLE_SQL: dict[str, str] = {}
