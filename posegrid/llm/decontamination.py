"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items are compared as lower-cased words (runs of ASCII letters and digits and
of non-ASCII characters), each known by a 64-bit hash. A seed is a fixed mask laid over neighbouring
words: words at its 0s are ignored, so a substituted word there does no harm. The masks are chosen
so that however a fifth of an overlap's words is substituted between its equal ends, one mask at one
place misses them all; a test enumerates this for 12 to 24 words. Shorter overlaps or a lower
identity are refused, as the masks would miss some. The seeds of both sides are joined by Spark, and
each (text, item, diagonal) that meets is verified on all its words.

Equal seeds of one text at even distances, as repeated words or phrases make, are one row with a
step and a number, on both sides. Two such rows of one step meet in a range of diagonals, so that
repetition in a text and in an item adds up and doesn't multiply.

Before the join, seeds of texts pass a bitmap of the benchmark's seeds of at most 2^MAX_BITS bits,
whatever the benchmark's size; it saves shuffling seeds without a partner and changes no result.
Texts are known by their SHA-256, so copies of one text are verified once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posegrid.llm import kernels as K
from posegrid.session import materialise, ship

MASKS = ("11101011", "101100111", "1111011", "11100100011")
MIN_WORDS, IDENTITY, MAX_BITS = 12, 0.8, 28
U = np.uint64
_ALNUM = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def _words(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the row of each."""
    data, offs = K.bytes_of(pc.utf8_lower(column))
    starts, ends, row = K.split_words(data, offs, _ALNUM)
    return K.word_hashes(data, starts, ends), row


def _seeds(h: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the mask at every place where it lies within one row, and the places."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return h[:0], np.zeros(0, np.int64)
    out = np.full(n, K.mix64(np.array([int(mask, 2) + (len(mask) << 40)], U))[0])
    for i, c in enumerate(mask):
        if c == "1":
            out = out * K.MULT + h[i : i + n]
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return K.mix64(out[at]), at


def _first(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin, and the end of all."""
    return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))


def longest_overlap(text: np.ndarray, item: np.ndarray, diagonal: int, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> tuple[int, int, int, int] | None:
    """The longest verified overlap of two word lists on a diagonal (place in text less place in
    item): start in text, start in item, words, equal words. It begins and ends with equal words,
    `identity` of them are equal, and it has min_words words, or is all of a shorter item,
    unchanged. The first of equals is taken. Time and memory are in proportion to the item."""
    a, b = max(0, -diagonal), min(len(item), len(text) - diagonal)
    same = item[a:b] == text[a + diagonal : b + diagonal]
    if len(item) < min_words:
        n = len(item)
        return (diagonal, 0, n, n) if b - a == n > 0 and same.all() else None
    at = np.flatnonzero(same)
    if not len(at):
        return None
    share = Fraction(str(identity))
    num, den = share.numerator, share.denominator
    # from the i-th to the j-th equal word: den (j - i + 1) >= num (at[j] - at[i] + 1)
    height = den * np.arange(len(at)) - num * at
    lowest = np.minimum.accumulate(height)  # falls, so the first i at most so high is found by bisection
    i = np.searchsorted(-lowest, -(height + den - num), "left")
    size = at - at[i] + 1
    long = int(size.max())
    if long < min_words:
        return None
    j = int(np.argmax(size))
    return int(a + at[i[j]] + diagonal), int(a + at[i[j]]), long, int(j - i[j] + 1)


def _runs(group: np.ndarray, key: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Progressions of the places p (below 2^40) of one key in one group: which place they begin
    with, their step (0 for a place alone) and number."""
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((p, key, group))
    g, k, q = group[order], key[order], p[order]
    gap = np.zeros(len(q), np.int64)  # to the place before, if that is of the same key
    same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    gap[1:] = np.where(same, q[1:] - q[:-1], 0)
    # a place begins a run if it is the first of its key, or its gap is another one than that before
    begins = np.ones(len(q), bool)
    begins[1:] = ~same
    begins[2:] |= same[1:] & (gap[2:] != gap[1:-1]) & same[:-1]
    at = np.flatnonzero(begins)
    count = np.diff(np.append(at, len(q)))
    step = np.where(count > 1, gap[np.minimum(at + 1, len(q) - 1)], 0)
    return order[at], step, count


def _item_seeds(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.chunks(batches, text="t"):
            h, row = _words(table["t"])
            first = _first(row, table.num_rows)
            n = np.diff(first)
            short = sorted({int(k) for k in n if 0 < k < min_words})
            for mask, fits in [*((m, n >= min_words) for m in MASKS), *(("1" * k, n == k) for k in short)]:
                key, p = _seeds(h, row, mask)
                whole = fits[row[p]]
                key, p = key[whole], p[whole]
                at, step, count = _runs(row[p], key, p)
                key, p = key[at], p[at]
                of = pa.array(row[p])
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "i": table["i"].combine_chunks().take(of), "th": table["th"].combine_chunks().take(of), "p": p - first[row[p]], "p_step": step, "p_count": count})

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in K.chunks(batches, text="t"):
        h, row = _words(table["t"])
        lists = pa.LargeListArray.from_arrays(_first(row, table.num_rows), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict({"i": table["i"].combine_chunks(), "th": table["th"].combine_chunks(), "words": lists})


def _probes(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    k = key.view(U)
    return (k >> U(64 - bits)).astype(np.int64), (k & U((1 << bits) - 1)).astype(np.int64)


def _bitmap(keys: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bitmap in which two bits stand for each key: 256 bits for a key up to 2^MAX_BITS bits."""
    bits = min(MAX_BITS, max(16, int(256 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"b": pa.array([own.tobytes()], pa.binary())})

    all_ = np.zeros(1 << bits >> 3, np.uint8)
    for r in keys.select("key").coalesce(8).mapInArrow(run, "b binary").toLocalIterator():
        all_ |= np.frombuffer(r.b, np.uint8)
    return all_, bits


def _text_seeds(shared, masks: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = shared.value
        for table in K.chunks(batches):
            h, row = _words(table["text"])
            first = _first(row, table.num_rows)
            d = table["d"].combine_chunks()
            for mask in masks:
                key, p = _seeds(h, row, mask)
                for probe in range(2):
                    at = _probes(key, bits)[probe]
                    some = np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    key, p = key[some], p[some]
                if len(p):
                    at, step, count = _runs(row[p], key, p)
                    key, p = key[at], p[at]
                    yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "d": d.take(pa.array(row[p])), "q": p - first[row[p]], "q_step": step, "q_count": count})

    return run


def _verify(min_words: int, identity: float):
    """Rows come by text: first the text itself, then the items it meets, with their words and the
    diagonals. Of an item's overlaps the longest is sent, on the least diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(0, U)
        for table in K.chunks(batches):
            out: list[tuple] = []
            texts, ds, items, ths = (table[c].to_pylist() for c in ("text", "d", "i", "th"))
            many = table["diagonals"].combine_chunks()
            met, ends = many.values.to_numpy(), many.offsets.to_numpy()
            lists = table["words"].combine_chunks()
            flat, offs = lists.values.to_numpy().view(U), lists.offsets.to_numpy()
            for k, text in enumerate(texts):
                if text is not None:
                    words = _words(pa.array([text]))[0]
                    continue
                best = None
                for diagonal in np.sort(met[ends[k] : ends[k + 1]]).tolist():
                    found = longest_overlap(words, flat[offs[k] : offs[k + 1]], diagonal, min_words, identity)
                    if found and (best is None or found[2] > best[2]):
                        best = found
                if best:
                    out.append((ds[k], items[k], ths[k], *best))
            if out:
                kinds = [pa.binary(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["d", "i", "th", "a", "b", "n", "equal"])

    return run


#: Diagonals of two progressions: a range if they have one step or one is a place alone, else all pairs.
_DIAGONALS = """CASE
  WHEN q_count = 1 AND p_count = 1 THEN array(q - p)
  WHEN q_count = 1 THEN sequence(q - p - (p_count - 1) * p_step, q - p, p_step)
  WHEN p_count = 1 THEN sequence(q - p, q - p + (q_count - 1) * q_step, q_step)
  WHEN q_step = p_step THEN sequence(q - p - (p_count - 1) * p_step, q - p + (q_count - 1) * q_step, q_step)
  ELSE flatten(transform(sequence(0L, q_count - 1), i -> transform(sequence(0L, p_count - 1), j -> q + i * q_step - p - j * p_step))) END"""

OVERLAPS = "array<struct<item_id:bigint,text_start:int,item_start:int,n_words:int,n_equal:int>>"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _overlaps(texts: DataFrame, benchmark: DataFrame, item_id_col: str, item_text_col: str, min_words: int, identity: float) -> DataFrame:
    """d and overlaps of the texts (d, text; copies of a text share d) that have any."""
    if min_words < MIN_WORDS or identity < IDENTITY:
        raise ValueError(f"the masks find all overlaps of at least {MIN_WORDS} words with {IDENTITY} of them equal; not of {min_words} with {identity}")
    spark = texts.sparkSession
    ship(spark)
    items = benchmark.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).cast("long").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    items = items.withColumn("th", F.xxhash64("t")).distinct()
    seeds = materialise(items.mapInArrow(_item_seeds(min_words), "key long, i long, th long, p long, p_step long, p_count long"), "benchmark-seeds")
    words = materialise(items.mapInArrow(_item_words, "i long, th long, words array<long>"), "benchmark-words")
    short = sorted(r.n for r in words.select(F.size("words").alias("n")).where(f"n > 0 AND n < {min_words}").distinct().collect())  # at most min_words - 1 numbers
    shared = spark.sparkContext.broadcast(_bitmap(seeds, seeds.count()))
    masks = [*MASKS, *("1" * n for n in short)]
    own = texts.mapInArrow(_text_seeds(shared, masks), "key long, d binary, q long, q_step long, q_count long")
    pairs = own.join(seeds, "key").select("d", "i", "th", F.explode(F.expr(_DIAGONALS)).alias("diagonal"))
    hits = pairs.groupBy("d", "i", "th").agg(F.collect_set("diagonal").alias("diagonals"))
    hits = materialise(hits, "benchmark-hits")
    met = materialise(hits.select("d").distinct(), "benchmark-texts")  # a table of its own: its size is known, so few go to every task
    held = texts.join(met, "d", "left_semi").dropDuplicates(["d"])
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = held.select("d", "text", none("long", "i"), none("long", "th"), F.array().cast("array<long>").alias("diagonals"), F.array().cast("array<long>").alias("words"))
    rows = rows.unionByName(hits.join(words, ["i", "th"]).select("d", none("string", "text"), "i", "th", "diagonals", "words"))
    rows = rows.repartition("d").sortWithinPartitions("d", F.col("text").isNull())
    found = rows.mapInArrow(_verify(min_words, identity), "d binary, i long, th long, a long, b long, n long, equal long")
    one = F.struct(F.col("i").alias("item_id"), F.col("a").cast("int").alias("text_start"), F.col("b").cast("int").alias("item_start"), F.col("n").cast("int").alias("n_words"), F.col("equal").cast("int").alias("n_equal"))
    return materialise(found.groupBy("d").agg(F.sort_array(F.collect_list(one)).cast(OVERLAPS).alias("o")), "benchmark-overlaps")


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", out_col: str = "overlaps", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """The rows of docs with out_col: for each benchmark item met in the row's whole text, its
    longest verified overlap (the earliest diagonal on ties), by item_id.

    An overlap is two equally long runs of words, in text and item, that begin and end with equal
    words, of which at least `identity` are equal place by place, of at least min_words words;
    items with fewer words count where all their words stand unchanged. Items longer than the
    text are compared as far as they overlap. Null or empty texts and items without words have no
    overlaps; items with a null id are passed over. Repeated items count once; different texts of
    one id give one overlap each. A column called out_col is replaced, other names may clash with
    any used here. Empty tables on either side give empty lists.
    """
    rest = docs.drop(out_col)
    mark = _unused(docs, "_digest")
    found = _overlaps(rest.select(_digest(F.col(text_col)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), benchmark, item_id_col, item_text_col, min_words, identity)
    out = rest.withColumn(mark, _digest(F.col(text_col))).join(found.toDF(mark, out_col), mark, "left").drop(mark)
    return out.withColumn(out_col, F.coalesce(out_col, F.array().cast(OVERLAPS)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """The rows of docs, same columns, whose text has no verified overlap with any item. Rows
    with null or empty text have none and stay."""
    mark = _unused(docs, "_digest")
    found = _overlaps(docs.select(_digest(F.col(text_col)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), benchmark, item_id_col, item_text_col, min_words, identity)
    return docs.withColumn(mark, _digest(F.col(text_col))).join(found.select(F.col("d").alias(mark)), mark, "left_anti").drop(mark)
