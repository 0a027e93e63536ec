"""Ranked lexical search by a bit-sliced impact index.

Rows are indexed in blocks of at most BLOCK_ROWS rows and about BLOCK_BYTES of text.  For each term of a block the index has the
places of the rows that hold it and the bits of their impacts, one bitmap per bit.  An impact is what a term's occurrences add
to a row's score for each unit of the term's weight; it needs the number of rows and terms in all the corpus, so a first pass
writes the terms of each block, and a second, over that compact table, their impact bits.

A search multiplies and adds by bitwise arithmetic on the bitmaps alone.  Impacts are multiplied by an item's weight of a term by
shifted addition, spread to bitmaps over the block's rows, and added by carry-save steps of three to two; the best rows are
found by descending from the most significant bitmap, and so no score is computed for any other row.  A block sends at most k
rows of an item on, and a task merges those of its blocks, so little is left to rank.

The items of a search go in turns: groups of at most ITEM_TERMS terms (one item, if it alone has more) are broadcast, one group
after the other, and each reads the index once.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case.  Inside a block they are told apart
by 64-bit hashes, across blocks by their text.

Defined cases: a text that is null, empty or without terms counts nowhere and is found by no item; an item without terms finds
nothing; only scores above 0 count; equal scores go by ascending doc_id, null last; rows with equal doc_id are found each; items
that repeat in id and text are one, and of two texts with one id each has ranks of its own; texts of any length are indexed
whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, materialize, table
from .hashing import CHUNK, MARKS, Words

#: A term (fixed by the contract).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20
#: Terms of items that are broadcast together, and those whose bitmaps a task holds at a time.
ITEM_TERMS, HELD_TERMS = 65_536, 1024
#: Impacts are below 10 ** 6.
BITS = 20
#: Share of a text's length in the norm, per cent, and the scale of impacts (fixed by the contract).
LENGTH_SHARE, SCALE = 75, 1_000_000_000
_BLOCKS = "n_docs long, n_terms long, ids binary, absent binary, lengths binary, terms array<string>, dfs array<int>, places binary, counts binary"
_INDEX = "n_docs long, ids binary, absent binary, terms array<string>, dfs array<int>, places binary, slices binary"


class _Block:
    """Gathers the terms of rows until it is full."""

    def __init__(self, words: Words, most_rows: int, most_bytes: int):
        self._words, self._most_rows, self._most_bytes = words, most_rows, most_bytes
        self.rows: list[tuple[bool, int]] = []  # absent, doc_id
        self.size = self._waiting = 0
        self._found: tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]] = [], [], []  # term hashes, rows, counts
        self._names: dict[int, bytes] = {}
        self._held: list[bytes] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.rows.append((doc_id is None, doc_id or 0))
        self._held.append(text)
        self.size += len(text) + 1
        self._waiting += len(text)
        if self._waiting >= CHUNK:
            self._count()

    @property
    def full(self) -> bool:
        return len(self.rows) >= self._most_rows or self.size >= self._most_bytes

    def _count(self) -> None:
        held, first = self._held, len(self.rows) - len(self._held)
        self._held, self._waiting = [], 0
        data = b"\n".join(held) + b"\n"
        ends = np.cumsum([len(t) + 1 for t in held])
        for at, end in _slices(data, self._words):
            h, starts, stops = self._words.located(np.frombuffer(data, np.uint8)[at:end])
            if not len(h):
                continue
            row = np.searchsorted(ends, starts + at, "right") + first
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.flatnonzero((np.diff(h, prepend=~h[:1]) != 0) | (np.diff(row, prepend=-1) != 0))
            counts = np.diff(new, append=len(h))
            for k in new[np.diff(h[new], prepend=~h[new[:1]]) != 0].tolist():
                if (x := int(h[k])) not in self._names:
                    n = order[k]
                    self._names[x] = data[at + starts[n] : at + stops[n]].lower()
            for own, x in zip(self._found, (h[new], row[new].astype(np.int32), counts.astype(np.int32)), strict=True):
                own.append(x)

    def record(self) -> pa.RecordBatch | None:
        """The block as a row of _BLOCKS; none if no row has a term.  The block lets go of what it holds."""
        if self._held:
            self._count()
        if not self._found[0]:
            return None
        lengths = np.zeros(len(self.rows), np.int64)
        for row, counts in zip(*self._found[1:], strict=True):
            lengths += np.bincount(row, counts, len(lengths)).astype(np.int64)
        live = np.flatnonzero(lengths)
        order = sorted(live.tolist(), key=self.rows.__getitem__)  # places in order of doc_id: ties go to the first
        at = np.zeros(len(self.rows), np.uint16)
        at[order] = np.arange(len(order))
        h, place, counts = self._joined(0), at[self._joined(1)], self._joined(2)
        by = np.lexsort((place, h))
        h, place, counts = h[by], place[by], counts[by]
        del by
        new = np.flatnonzero(_changes(h) | _changes(place))  # a long text may have a term in several slices
        h, place, counts = h[new], place[new], np.add.reduceat(counts, new, dtype=np.int32)
        first = np.flatnonzero(_changes(h))
        names = pa.array([self._names[x] for x in h[first].tolist()], pa.binary()).cast(pa.string())
        self._names = {}
        dfs = pa.array(np.diff(first, append=len(h)).astype(np.int32))
        each = [
            pa.array([len(order)]), pa.array([int(lengths.sum())]), _blob(np.array([self.rows[r][1] for r in order], np.int64)), _blob(np.array([self.rows[r][0] for r in order], np.uint8)),
            _blob(lengths[order]), pa.ListArray.from_arrays([0, len(names)], names), pa.ListArray.from_arrays([0, len(dfs)], dfs), _blob(place), _blob(counts),
        ]
        return pa.RecordBatch.from_arrays(each, _names(_BLOCKS))

    def _joined(self, i: int) -> np.ndarray:
        out = np.concatenate(self._found[i])
        self._found[i].clear()
        return out


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first does."""
    return np.concatenate([[True], x[1:] != x[:-1]])


def _blob(x: np.ndarray) -> pa.Array:
    """The bytes of an array as one binary value, not copied."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), pa.py_buffer(x)])


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _slices(data: bytes, words: Words) -> Iterator[tuple[int, int]]:
    """Ranges of data of about CHUNK bytes that end between terms."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and data[end] not in MARKS:
            end += 1
        yield at, end
        at = end


def term_blocks(docs: DataFrame, most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The terms of docs (doc_id, text) by blocks: which rows hold each, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(MARKS)
        block = _Block(words, most_rows, most_bytes)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for at in range(0, len(texts), 256):
                for doc_id, text in zip(batch.column("doc_id").slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist(), strict=True):
                    block.add(doc_id, text)
                    if block.full:
                        yield from filter(None, [block.record()])
                        block = _Block(words, most_rows, most_bytes)
        yield from filter(None, [block.record()])

    rows = docs.select("doc_id", "text").where(F.length("text") > 0)
    return rows.mapInArrow(run, _BLOCKS)


def impact_index(blocks: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The impact bits of the terms of blocks, given the number of rows with terms and of all their terms."""

    def bits(lengths: np.ndarray, dfs: np.ndarray, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        most = LENGTH_SHARE * int(lengths.max()) * n_docs
        exact = lengths if most < 1 << 63 else lengths.astype(object)
        norm = (100 - LENGTH_SHARE + (LENGTH_SHARE * exact * n_docs) // n_terms).astype(np.int64)
        counts = counts.astype(np.int64)
        impact = (SCALE * counts) // (1000 * counts + 8 * norm[places])
        spread = np.zeros(int(_padded(dfs).sum()) * 8, np.uint32)
        spread[_slots(dfs)] = impact
        return np.concatenate([np.packbits((spread >> np.uint32(b)) & np.uint32(1), bitorder="little") for b in range(BITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n).slice(r, 1) for n in batch.schema.names}
                lengths, places, counts = (np.frombuffer(row[n][0].as_buffer(), kind) for n, kind in (("lengths", np.int64), ("places", np.uint16), ("counts", np.int32)))
                row["slices"] = _blob(bits(lengths, row["dfs"][0].values.to_numpy(), places, counts))
                yield pa.RecordBatch.from_arrays([row[n] for n in _names(_INDEX)], _names(_INDEX))

    return blocks.mapInArrow(run, _INDEX)


def _padded(dfs: np.ndarray) -> np.ndarray:
    """Bytes of a term's bitmap over its own rows."""
    return (dfs.astype(np.int64) + 7) >> 3


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of n numbers each, one range after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _slots(dfs: np.ndarray) -> np.ndarray:
    """The bit of each row of each term, where a term's bitmap begins at a whole byte."""
    dfs = dfs.astype(np.int64)
    return _ranges(np.cumsum(_padded(dfs) * 8) - _padded(dfs) * 8, dfs)


def multiplied(slices: np.ndarray, factors: np.ndarray, width: int) -> np.ndarray:
    """Bit-sliced numbers (bits, bytes) times a factor per byte, as `width` slices: shifted additions with carry."""
    out = np.zeros((width, slices.shape[1]), np.uint8)
    for b in range(int(factors.max(initial=0)).bit_length()):
        chosen = np.where((factors >> b) & 1, 0xFF, 0).astype(np.uint8)
        carry = np.zeros(slices.shape[1], np.uint8)
        for p in range(b, width):
            if p - b < len(slices):
                more = slices[p - b] & chosen
                half = out[p] ^ more
                out[p], carry = half ^ carry, (out[p] & more) | (half & carry)
            elif carry.any():
                out[p], carry = out[p] ^ carry, out[p] & carry
            else:
                break
    return out


def added(numbers: np.ndarray) -> np.ndarray:
    """The sum of bit-sliced numbers (number, bit, word), which must fit their bits: three become two until two are left."""
    while len(numbers) > 2:
        t = len(numbers) // 3
        a, b, c = numbers[:t], numbers[t : 2 * t], numbers[2 * t : 3 * t]
        half = a ^ b
        carry = np.zeros_like(a)
        carry[:, 1:] = ((a & b) | (half & c))[:, :-1]
        numbers = np.concatenate([half ^ c, carry, numbers[3 * t :]])
    if len(numbers) == 1:
        return numbers[0]
    out, carry = np.empty_like(numbers[0]), np.zeros_like(numbers[0][0])
    for p, (a, b) in enumerate(zip(numbers[0], numbers[1], strict=True)):
        half = a ^ b
        out[p], carry = half ^ carry, (a & b) | (half & carry)
    return out


def best(scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k greatest of bit-sliced scores (bit, word) above 0 as (place, score), the lower place of equal ones, in no order."""
    candidates = np.bitwise_or.reduce(scores, axis=0)
    sure, need = np.zeros_like(candidates), k
    if int(np.bitwise_count(candidates).sum()) > k:
        for plane in scores[::-1]:
            high = candidates & plane
            n = int(np.bitwise_count(high).sum())
            if n > need:
                candidates = high
            elif n:
                sure |= high
                need -= n
                candidates = candidates & ~plane
                if not need:
                    break
    chosen = [*_places(sure), *_places(candidates)[:need].tolist()] if need else _places(sure).tolist()
    out = []
    for place in map(int, chosen):
        word, bit = place >> 6, np.uint64(place & 63)
        column = ((scores[:, word] >> bit) & np.uint64(1)).tolist()
        out.append((place, sum(x << p for p, x in enumerate(column))))
    return out


def _places(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little"))


def _spread(planes: np.ndarray, places: np.ndarray, owner: np.ndarray, slots: np.ndarray, n: int, width: int, words: int) -> np.ndarray:
    """Bitmaps over the rows of a block (term, bit, word) of planes over the rows of each term."""
    out = np.zeros((n, width, words), np.uint64)
    if not len(places):
        return out
    word = owner * words + (places >> 6)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    at_term, at_word = np.divmod(word[first], words)
    shift = (places & 63).astype(np.uint64)
    for p in range(len(planes)):
        bit = np.unpackbits(planes[p], bitorder="little")[slots].astype(np.uint64) << shift
        out[at_term, p, at_word] = np.bitwise_or.reduceat(bit, first)
    return out


def _search_block(row: dict, items: list[tuple[int, list[str], list[int]]], vocabulary: pa.Array, k: int, held_terms: int = HELD_TERMS) -> Iterator[tuple[int, int, bool, int]]:
    """(item, doc_id, absent, score) of the best rows of a block for each item; items have a number, terms and factors."""
    dfs, places = row["dfs"].values.to_numpy(), np.frombuffer(row["places"].as_buffer(), np.uint16)
    slices = np.frombuffer(row["slices"].as_buffer(), np.uint8).reshape(BITS, -1)
    ids, absent = np.frombuffer(row["ids"].as_buffer(), np.int64), row["absent"].as_py()
    at = pc.index_in(vocabulary, row["terms"].values)  # where the block has each term of the items
    where = dict(zip(vocabulary.to_pylist(), at.to_pylist(), strict=True))
    first_row, first_byte = np.cumsum(dfs) - dfs, np.cumsum(_padded(dfs)) - _padded(dfs)
    words = -(-len(ids) // 64)

    def sums(pairs: list[tuple[int, int]], most: int) -> tuple[dict[tuple[int, int], int], np.ndarray]:
        """Bitmaps of the products of pairs (term of the block, factor), with room for the sum of `most` of them, and where each is."""
        terms, factors = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        df, size = dfs[terms].astype(np.int64), _padded(dfs[terms])
        width = BITS + int(factors.max()).bit_length()
        planes = multiplied(slices[:, _ranges(first_byte[terms], size)], np.repeat(factors, size), width)
        rows = places[_ranges(first_row[terms], df)].astype(np.int64)
        bitmaps = _spread(planes, rows, np.repeat(np.arange(len(pairs)), df), _slots(df), len(pairs), width + most.bit_length(), words)
        return {p: n for n, p in enumerate(pairs)}, bitmaps

    def answer(group: list[tuple[int, list[tuple[int, int]]]]) -> Iterator[tuple[int, int, bool, int]]:
        if len(group) == 1 and len(group[0][1]) > held_terms:  # an item of very many terms: sums of parts of it
            own = group[0][1]
            parts = [added(sums(own[i : i + held_terms], len(own))[1]) for i in range(0, len(own), held_terms)]
            width = max(map(len, parts))
            scores = [(group[0][0], added(np.stack([np.pad(x, ((0, width - len(x)), (0, 0))) for x in parts])))]
        else:
            number, bitmaps = sums(sorted({p for _, own in group for p in own}), max(len(own) for _, own in group))
            scores = ((item, added(bitmaps[[number[p] for p in own]])) for item, own in group)
        for item, score in scores:
            for place, x in best(score, k):
                yield item, int(ids[place]), bool(absent[place]), x

    group, held = [], 0
    for item, terms, factors in items:
        own = [(where[t], f) for t, f in zip(terms, factors, strict=True) if f and where[t] is not None]
        if not own:
            continue
        if group and held + len(own) > held_terms:
            yield from answer(group)
            group, held = [], 0
        group.append((item, own))
        held += len(own)
    if group:
        yield from answer(group)


def item_terms(items: DataFrame, blocks: DataFrame, n_docs: int) -> DataFrame:
    """item (a number), item_id, terms and factors of items (item_id, text): a term's weight times its occurrences in the item."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id())
    asked = materialize(asked, "search_items")
    each = asked.select("item", "item_id", F.explode(F.regexp_extract_all(lower, F.lit(f"({TERM})"), 0)).alias("term"))
    each = materialize(each.groupBy("item", "item_id", "term").agg(F.count("*").alias("times")), "search_terms")
    found = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    found = found.join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2.0 * F.col("df") + 1))).cast("long")
    found = materialize(found.withColumn("weight", weight), "search_weights")
    pairs = each.join(found, "term").groupBy("item", "item_id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("weight") * F.col("times")).alias("factor")))).alias("x"))
    return pairs.select("item", "item_id", F.col("x.term").alias("terms"), F.col("x.factor").alias("factors"))


def _turns(items: DataFrame) -> Iterator[list[tuple[int, list[str], list[int]]]]:
    """The items in groups of bounded size, one after the other."""
    group, held = [], 0
    for r in items.toLocalIterator():
        if group and held + len(r.terms) > ITEM_TERMS:
            yield group
            group, held = [], 0
        group.append((r.item, r.terms, r.factors))
        held += len(r.terms)
    if group:
        yield group


def _asked(index: DataFrame, group: list[tuple[int, list[str], list[int]]], k: int) -> DataFrame:
    """The k best rows of each task for each item of a group."""
    sent = index.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, found = sent.value, {}
        vocabulary = pa.array(sorted({t for _, terms, _ in items for t in terms}), pa.string())
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in batch.schema.names}
                for item, doc_id, absent, score in _search_block(row, items, vocabulary, k):
                    found.setdefault(item, []).append((-score, absent, doc_id))
                for item, own in found.items():
                    if len(own) > k:
                        found[item] = sorted(own)[:k]
        rows = [(item, None if absent else doc_id, -score) for item, own in found.items() for score, absent, doc_id in own]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def build(docs: DataFrame, **sizes: int) -> tuple[DataFrame, DataFrame, int]:
    """Term blocks and impact index of docs (doc_id, text) as tables of the shared folder, and the number of rows with terms."""
    blocks = materialize(term_blocks(docs, **sizes), "term_blocks", **LARGE_ROWS)
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return blocks, materialize(impact_index(blocks, n_docs, n_terms), "impact_index", **LARGE_ROWS), n_docs


def search(blocks: DataFrame, index: DataFrame, n_docs: int, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of what build made, for each of items (item_id, text)."""
    asked = materialize(item_terms(items, blocks, n_docs), "search_asked")
    found = None
    for group in _turns(asked):
        own = materialize(_asked(index, group, k), "search_found")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = asked.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    blocks, index, n_docs = build(table(spark, sf_dir, "documents", "doc_id", "text"))
    return search(blocks, index, n_docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {"op13_impact_search": op13_impact_search}
ORACLE_SQL = {
    "op13_impact_search": r"""
WITH lower_docs AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
terms AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lower_docs),
tf AS (SELECT doc_id, term, count(*)::bigint AS tf FROM terms GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf)::bigint AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::bigint AS n_docs, sum(n)::bigint AS n_terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * count(*) + 1)))::bigint AS w FROM tf, total GROUP BY term, n_docs),
norms AS (SELECT doc_id, 25 + ((75 * n * n_docs) // n_terms) AS m FROM lengths, total),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}
