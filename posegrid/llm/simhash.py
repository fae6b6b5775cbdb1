"""SimHash near-dedup with deletion-variant signatures.

Texts are reduced to 64-bit fingerprints of their word shingles. Two fingerprints that differ in
at most 3 bits are cut into 2 segments; in one of them they differ in at most one bit. Each
segment is indexed under its 32 one-wildcard variants (one bit blanked), so such a pair always
meets in an equality of keys; what meets is verified on all 64 bits.

Only distinct fingerprints are indexed; copies are members of their fingerprint's class. In a
bucket, links are found and reduced to a spanning forest, so no set of all pairs leaves a task.
Buckets of more than HOT fingerprints are cut again: the 33 bits that their key leaves open form
two segments with wildcards of their own, after which a bucket has 18 open bits, at most 2^18 members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm import kernels as K
from posegrid.operators.components import connected_components
from posegrid.session import materialise, ship

HOT = 2000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _shingles(column: pa.ChunkedArray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 values of all shingles, the row of each, and the number of each row's shingles."""
    data, offs = K.bytes_of(column)
    data = K.lower_ascii(data)
    starts, ends, row = K.split_words(data, offs)
    n = len(offs) - 1
    flat, to = K.joined(data, starts, ends, row, n)
    size = ends - starts
    # in `flat` a row's words are joined by single spaces, without one after the row's last word
    inner = np.append(row[1:] == row[:-1], False) if len(size) else np.zeros(0, bool)
    begin = np.cumsum(size + inner) - size - inner
    words = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(words)[:-1]))
    many = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    of = np.repeat(np.arange(n), many)
    lead = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    tail = np.minimum(lead + shingle - 1, (first + words - 1)[of])
    view, digest = memoryview(np.ascontiguousarray(flat)).cast("B"), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[a:b], seed) for a, b in zip(begin[lead].tolist(), (begin + size)[tail].tolist())), np.uint64, len(lead)) if len(lead) else np.zeros(0, np.uint64)
    return h, of, many


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.chunks(batches):
            n = table.num_rows
            h, of, many = _shingles(table["text"], shingle, seed)
            lanes = h.view(np.uint8).reshape(-1, 8)
            print_ = np.zeros(n, np.uint64)
            for j in range(8):
                seen = np.bincount(of * 256 + lanes[:, j], minlength=n * 256).reshape(n, 256) @ _BITS
                print_ |= ((seen * 2 > many[:, None]) @ (1 << np.arange(8))).astype(np.uint64) << np.uint64(8 * j)
            yield pa.RecordBatch.from_pydict({"id": table["id"].combine_chunks(), "bits": print_.view(np.int64)})

    return run


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """id and bits (the fingerprint as a signed 64-bit integer), one row per input row.

    A to Z are lower-cased; shingles are `shingle` words joined by single spaces, repeats
    included; a text of fewer words is one shingle, one without words has fingerprint 0. A bit
    is set where it is set in over half the shingles' XXH64 values.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle, seed), "id long, bits long")


def _forest(keys: list[str], reach: int):
    """Edges (member, root) of a spanning forest of the links in each run of equal keys."""

    def linked(bits: np.ndarray) -> Iterator[tuple[int, int]]:
        left = np.arange(len(bits))
        while len(left):
            root, left = left[0], left[1:]
            front = [root]
            while front and len(left):
                near = np.bitwise_count(bits[left] ^ bits[front.pop()]) <= reach
                found, left = left[near], left[~near]
                for x in found.tolist():
                    yield x, int(root)
                front += found.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def solve(t: pa.Table) -> pa.RecordBatch:
            bits = t["bits"].to_numpy().view(np.uint64)
            new = np.ones(len(bits) + 1, bool)
            new[1:-1] = np.any([t[k].to_numpy()[1:] != t[k].to_numpy()[:-1] for k in keys], axis=0)
            at = np.flatnonzero(new)
            size = np.diff(at)
            two = at[:-1][size == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= reach]
            u, v = [two], [two + 1]
            for a, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
                pairs = np.array(list(linked(bits[a : a + n])), np.int64).reshape(-1, 2) + a
                u.append(pairs[:, 0])
                v.append(pairs[:, 1])
            u, v = (bits[np.concatenate(x)].view(np.int64) for x in (u, v))
            return pa.RecordBatch.from_pydict({"src": u, "dst": v})

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if t.num_rows == 0:
                continue
            if held and any(held[-1][k][-1].as_py() != t[k][0].as_py() for k in keys):
                yield solve(pa.concat_tables(held))
                held = []
            last = np.all([t[k].to_numpy() == t[k][-1].as_py() for k in keys], axis=0)
            cut = int(np.argmax(last))
            if cut:
                yield solve(pa.concat_tables([*held, t.slice(0, cut)]))
                held = []
            held.append(t.slice(cut))
        if held:
            yield solve(pa.concat_tables(held))

    return run


def hamming_links(prints: DataFrame, reach: int = 3, hot: int = HOT) -> DataFrame:
    """Edges src, dst whose connected components are those of all links of at most `reach`
    (1 to 3) differing bits among the distinct 64-bit values in column bits."""
    if not 1 <= reach <= 3:
        raise ValueError("two segments with one wildcard reach 1 to 3 bits")
    ship(prints.sparkSession)
    seg = "shiftright(bits, 32 * s) & 4294967295L"
    halves = prints.select("bits", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).withColumn("v", F.expr(seg))
    blank = lambda v: f"(s * 32L + j) * 4294967296L + ({v} & ~shiftleft(1L, j))"
    wild = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j")
    keyed = halves.select("bits", "s", "v", wild).withColumn("key", F.expr(blank("v"))).withColumn("sub", F.lit(0).cast("long"))
    # a bucket holds the fingerprints of two segment values, so one of more than `hot` shows in the values' counts
    crowded = halves.groupBy("s", "v").count().where(f"count > {hot // 2}").select("s", "v").cache()
    if crowded.isEmpty():
        split = keyed.select("bits", "key", "sub")
    else:
        big = crowded.select("s", "v", wild).select(F.expr(blank("v")).alias("key")).distinct().withColumn("big", F.lit(True))
        known = keyed.join(big, "key", "left")
        # open bits: the wildcard bit and the other segment, 33 in all, cut into 16 and 17
        rest = known.where("big").withColumn("open", F.expr("shiftleft(shiftright(v, j) & 1L, 32) | (shiftright(bits, 32 * (1 - s)) & 4294967295L)"))
        rest = rest.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(32))))
        part = "CASE WHEN i < 16 THEN open & 65535L ELSE shiftright(open, 16) END & ~shiftleft(1L, CASE WHEN i < 16 THEN i ELSE i - 16 END)"
        split = known.where("big IS NULL").select("bits", "key", "sub").unionByName(rest.select("bits", "key", F.expr(f"(1L + i) * 1048576L + ({part})").alias("sub")))
    return split.repartition("key", "sub").sortWithinPartitions("key", "sub", "bits").mapInArrow(_forest(["key", "sub"], reach), "src long, dst long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, reach: int = 3, hot: int = HOT) -> DataFrame:
    """id, fingerprint (16 lowercase hex digits) and component_id (the smallest id reachable over
    links of at most `reach` differing bits, the row's own included), one row per input row.

    Null text is read as empty; texts without words share fingerprint 0 and are linked like any
    others. Rows with a null id get a fingerprint and the component of equal fingerprints, null if
    no row there has an id. Repeated ids are rows of their own. Empty tables give empty results;
    other columns are not read.
    """
    own = materialise(simhash(docs, id_col, text_col, shingle, seed), "simhash")
    classes = materialise(own.groupBy("bits").agg(F.min("id").alias("least")), "simhash-classes")
    links = materialise(hamming_links(classes, reach, hot), "simhash-links")
    parts = connected_components(links)
    # components are named by fingerprints; the name asked for is the least id of all their classes
    named = classes.join(parts.select(F.col("node").alias("bits"), "component"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("bits", "component_id")
    out = own.join(named, "bits")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
