"""Substring dedup by seed and extend.

A window is `min_words` consecutive words of one text. Seeds are winnowed anchors: of the
k-word grams in a window the one with the least hash (leftmost on ties), so two equal windows
always share their anchor at the same place. Neighbouring windows with one anchor form a run;
an anchor is extended both ways to the words its run covers, the run's context.

1. Count anchors over the corpus. An anchor met once matches nothing.
2. Where all occurrences of an anchor have one context, each after the first is a repeat as far
   as it was extended.
3. Where contexts differ, a context's occurrences after its first are repeats too. The first ones,
   and no others, are compared window by window, as extension stops within the run.
Overlapping repeats of a text are merged to maximal ones, all of at least min_words words.

Only keys and aggregates of keys meet in one place: counts are combined before the shuffle, and
occurrences come back by a join that AQE may split, so a passage in a third of all texts is no
hot task. Repeats within one document are found where it is read. Texts are shuffled once, by id,
for the steps that need what was found about them.

Keys are an anchor's 64-bit hash with its context's, or a window's with half its anchor's; results
are exact but for collisions of 96 bits or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm import kernels as K
from posegrid.session import materialise, ship

GRAM = 5
U = np.uint64
_INV = U(pow(int(K.MULT), -1, 1 << 64))


def _power(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = U(1)
    return np.multiply.accumulate(p)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of n neighbouring words, by doubling."""
    parts, size, cur, out, done = [], 1, h, None, 0
    while n:
        if n & 1:
            if out is None:
                out, done = cur, size
            else:  # the words of out, then those of cur
                m = min(len(out) - done, len(cur) - done)
                out = out[: max(0, len(cur) - done)] * U(pow(int(K.MULT), size, 1 << 64)) + cur[done : done + len(out)]
                done += size
        n >>= 1
        if n:
            cur = cur[:-size] * U(pow(int(K.MULT), size, 1 << 64)) + cur[size:] if len(cur) > size else cur[:0]
            size *= 2
    return out


class _Chunk:
    """Words, anchors and runs of some texts. Rows with one id count as parts of one document."""

    def __init__(self, table: pa.Table, min_words: int):
        self.ids = table["id"].to_numpy()
        self.data, offs = K.bytes_of(table["text"])
        self.starts, self.ends, self.row = K.split_words(self.data, offs)
        self.n_rows, n = table.num_rows, len(self.starts)
        first = np.searchsorted(self.row, np.arange(self.n_rows))  # a row's first word
        self.first, self.n_words = first, np.diff(np.append(first, n))
        fresh = np.ones(self.n_rows, bool)
        fresh[1:] = self.ids[1:] != self.ids[:-1]
        self.base = first[fresh][np.cumsum(fresh) - 1]  # the first word of the row's document
        self.words = K.word_hashes(self.data, self.starts, self.ends)
        self.w = min_words

    def runs(self):
        """For each run: anchor hash, context hash, anchor word, first and last window."""
        w, h = self.w, self.words
        span = w - GRAM + 1
        if len(h) < w:
            z = np.zeros(0, np.int64)
            return z.astype(U), z.astype(U), z, z, z
        v = K.mix64(_grams(h, GRAM))
        i, size = np.arange(len(v)), 1
        anchors = v
        while size < span:
            step = min(size, span - size)
            less = v[step:] < v[:-step]
            v = np.where(less, v[step:], v[:-step])
            i = np.where(less, i[step:], i[:-step])
            size += step
        starts = np.flatnonzero(self.row[: len(h) - w + 1] == self.row[w - 1 :])
        if not len(starts):
            z = np.zeros(0, np.int64)
            return z.astype(U), z.astype(U), z, z, z
        at = i[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (self.row[starts[1:]] != self.row[starts[:-1]])
        k = np.flatnonzero(new)
        a, b, p = starts[k], starts[np.append(k[1:] - 1, len(starts) - 1)], at[k]
        prefix = np.concatenate((np.zeros(1, U), np.cumsum(h * _power(K.MULT, len(h)), dtype=U)))
        context = (prefix[b + w] - prefix[a]) * _power(_INV, len(h))[a]
        context = K.mix64(context ^ K.mix64(((b - a) * 1024 + (p - a)).astype(U)))
        return anchors[p], context, p, a, b


def _seen(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where a document has the key at an earlier place; rows come by place."""
    own = K.mix64(key ^ K.mix64(doc.astype(U)))
    order = np.argsort(own, kind="stable")
    out = np.zeros(len(own), bool)
    out[order[1:]] = own[order][1:] == own[order][:-1]
    return out


def _emit_runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.chunks(batches, together="id"):
            c = _Chunk(table, min_words)
            anchor, context, _, a, b = c.runs()
            new = ~_seen(c.base[c.row[a]], context)
            anchor, context, a, b = anchor[new], context[new], a[new], b[new]
            row = c.row[a]
            base = c.base[row]
            cols = {"anchor": anchor.astype(np.int64), "context": context.astype(np.int64), "id": c.ids[row], "a": (a - base).astype(np.int32), "more": (b - a).astype(np.int32)}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _emit_windows(min_words: int):
    """Windows of the runs asked for (by first window), with the anchor's and the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.chunks(batches, together="id"):
            c = _Chunk(table, min_words)
            anchor, _, _, a, b = c.runs()
            row = c.row[a]
            base = c.base[row]
            wanted = table["wanted"].combine_chunks()
            of = np.repeat(np.arange(c.n_rows), np.diff(wanted.offsets.to_numpy()))
            asked = np.unique(c.base[of] + wanted.flatten().to_numpy())
            hit = np.isin(a, asked)
            a, b, anchor, row, base = a[hit], b[hit], anchor[hit], row[hit], base[hit]
            n = b - a + 1
            at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(a) else a
            window = K.mix64(_grams(c.words, min_words)[at]) if len(at) else at.astype(U)
            new = ~_seen(np.repeat(base, n), window)
            cols = {"anchor": np.repeat(anchor >> U(32), n).astype(np.uint32).view(np.int32), "window": window.astype(np.int64), "id": np.repeat(c.ids[row], n), "a": (at - np.repeat(base, n)).astype(np.int32)}
            yield pa.RecordBatch.from_pydict({k: v[new] for k, v in cols.items()})

    return run


def _cut(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.chunks(batches, together="id"):
            c = _Chunk(table, min_words)
            repeats = table["repeats"].combine_chunks()
            of = np.repeat(np.arange(c.n_rows), np.diff(repeats.offsets.to_numpy()))
            packed = repeats.flatten().to_numpy()
            change = np.zeros(len(c.starts) + 1, np.int32)
            a, e = c.base[of] + (packed >> 32), c.base[of] + (packed & 0xFFFFFFFF)
            np.add.at(change, a, 1)
            np.add.at(change, e, -1)
            # repeats within one document need no join
            if len(c.words) >= min_words:
                at = np.flatnonzero(c.row[: len(c.row) - min_words + 1] == c.row[min_words - 1 :])
                at = at[_seen(c.base[c.row[at]], K.mix64(_grams(c.words, min_words)[at]))]
                change[at] += 1
                change[at + min_words] -= 1
            gone = np.cumsum(change[:-1]) > 0
            data, offs = K.joined(c.data, c.starts, c.ends, c.row, c.n_rows, ~gone)
            edge = np.flatnonzero(gone & ~(np.append(False, gone[:-1]) & (np.append(-1, c.row[:-1]) == c.row)))
            stop = np.flatnonzero(gone & ~(np.append(gone[1:], False) & (np.append(c.row[1:], -1) == c.row))) + 1
            spans = pa.StructArray.from_arrays([pa.array((edge - c.first[c.row[edge]]).astype(np.int32)), pa.array((stop - c.first[c.row[edge]]).astype(np.int32))], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(c.row[edge], np.arange(c.n_rows + 1)).astype(np.int32)), spans)
            removed = np.bincount(c.row[gone], minlength=c.n_rows).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"id": c.ids, "n_words": c.n_words.astype(np.int64), "n_removed": removed, "kept_text": K.strings(data, offs), "removed": spans})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """Remove every word covered by a window of min_words words that also starts earlier
    (smaller id, or same id and earlier start). Words are maximal runs of bytes other than
    space and \\t \\n \\v \\f \\r.

    Returns id, n_words, n_removed, kept_text (kept words, single spaces) and removed (word
    ranges of the maximal repeats, end exclusive), one row per input row.

    Null or empty text: no words, empty kept_text. Fewer than min_words words: nothing removed.
    Rows with one id are parts of one document, in order of their text; windows don't cross
    rows. A row with a null id has no place in the order: it is compared with itself only.
    Other columns are not read, whatever their names. An empty table gives an empty result.
    min_words is at least 8.
    """
    if min_words < 8:
        raise ValueError("min_words must be at least 8")
    ship(docs.sparkSession)
    kind = "id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = rows.where("id IS NOT NULL").repartition("id")
    # rows of one id must meet; where there are none, which ids alone tell, runs are found as texts are scanned
    unique = rows.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty()
    first = rows.where("id IS NOT NULL") if unique else texts.sortWithinPartitions("id", "text")
    found = first.mapInArrow(_emit_runs(min_words), "anchor long, context long, id long, a int, more int")
    # the first document of an anchor and whether it has one context; anchors met once match nothing
    known = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1"), F.min("id").alias("first_id"))
    known = known.where("n > 1").select("anchor", "first_id", (F.col("c0") == F.col("c1")).alias("one"))
    # joined by a key of its own, the hash with its bits turned over, so that both sides are shuffled for the join alone and AQE can split it
    turned = lambda df, c: df.withColumn("key", F.bitwise_not(c)).drop(c)
    runs = turned(found, "anchor").join(turned(known, "anchor"), "key").where("NOT one OR id <> first_id")
    # where there is one context, a later document's run is a repeat as a whole
    runs = runs.select(F.expr("IF(one, NULL, key)").alias("key"), F.expr("IF(one, NULL, context)").alias("context"), "id", "a", "more", "one")
    runs = materialise(runs, "substring-runs")
    # so it is where a document before has the same context, among several
    several = runs.where("NOT one")
    leads = turned(several.groupBy("context", "key").agg(F.min("id").alias("lead")).withColumnRenamed("key", "anchor"), "context")
    several = turned(several.withColumnRenamed("key", "anchor"), "context").join(leads, ["key", "anchor"]).select("id", "a", "more", "lead")
    whole = runs.where("one").select("id", "a", "more").unionByName(several.where("id <> lead").drop("lead"))
    repeat = whole.select("id", F.expr(f"a * 4294967296L + a + more + {min_words}").alias("repeat"), F.lit(None).cast("int").alias("wanted"))
    packed = repeat.unionByName(several.where("id = lead").select("id", F.lit(None).cast("long").alias("repeat"), F.col("a").alias("wanted")))
    asked = packed.groupBy("id").agg(F.collect_list("repeat").alias("repeats"), F.collect_list("wanted").alias("wanted"))
    both = texts.join(asked, "id", "left").select("id", "text", F.coalesce("repeats", F.array().cast("array<long>")).alias("repeats"), F.coalesce("wanted", F.array().cast("array<int>")).alias("wanted"))
    windows = both.where("size(wanted) > 0").select("id", "text", "wanted").sortWithinPartitions("id", "text")
    windows = windows.mapInArrow(_emit_windows(min_words), "anchor int, window long, id long, a int")
    least = windows.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
    late = turned(windows, "window").join(turned(least, "window").drop("n"), ["key", "anchor"]).where("id <> first_id")
    late = late.groupBy("id").agg(F.collect_list(F.expr(f"a * 4294967296L + a + {min_words}")).alias("more_repeats"))
    marked = both.join(late, "id", "left").select("id", "text", F.when(F.col("more_repeats").isNull(), F.col("repeats")).otherwise(F.concat("repeats", "more_repeats")).alias("repeats"))
    out = marked.sortWithinPartitions("id", "text").mapInArrow(_cut(min_words), kind)
    nowhere = rows.where("id IS NULL").withColumn("repeats", F.array().cast("array<long>"))
    lone = nowhere.withColumn("id", F.monotonically_increasing_id()).mapInArrow(_cut(min_words), kind).withColumn("id", F.lit(None).cast("long"))
    return out.unionByName(lone).withColumnRenamed("id", id_col)
