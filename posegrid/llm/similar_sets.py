"""Near copies by the exact Jaccard similarity of shingle sets, on top of SimHash.

64 bits can't tell texts that are 0.8 alike from strangers by 3 bits: about 10 differ. SimHash's
deletion variants find what is nearly equal. The rest meets by prefixes: with all shingles in one
fixed order, two sets at least t alike share one of the first n - ceil(t n) + 1 of their n shingles.
What meets is compared by a second, longer SimHash of 128 bits (at most REACH may differ, where 0.8
alike gives 19.4 +- 4.1; for sets under FEW shingles REACH_FEW). So but for a chance of about 1e-9 a
pair no link is missed. The order puts shingles often seen in a sample last, which keeps buckets
small; any order gives the same result.

Equal sets are one class from the start. A bucket gives a spanning forest of what meets in it, not
its pairs; the components of all forests are families, which no link leaves. The texts of a family
come together once, and all its pairs are compared on the sets: intersections are counted by a
matrix product over its commonest shingles and by lists of holders for the others. Only a forest of
the links leaves a task.

Buckets of more than HOT classes are cut into blocks, and each two blocks meet in a task of their
own. A family of more than BLOCK shingles is cut into blocks too, each with the same few pivots,
which joins most of it; then what is outside of the family's largest group meets every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm import kernels as K
from posegrid.llm import simhash
from posegrid.operators.components import connected_components
from posegrid.session import materialise, ship

SAMPLE, OFTEN, LISTED, SLICE = 2_000, 4, 200_000, 1 << 16
REACH, REACH_FEW, FEW, HOT = 44, 56, 64, 10_000
BLOCK, PIVOTS, DENSE, CELLS = 1 << 20, 64, 1024, 1 << 22


def _sets(column: pa.ChunkedArray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes row by row, and n + 1 offsets."""
    h, of, many = simhash._shingles(column, shingle, seed)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=len(many)))))


def _names(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A name of each row's set: the hash of its hashes."""
    return np.fromiter((xxhash.xxh64_intdigest(h[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())), np.uint64, len(offs) - 1).view(np.int64)


def _print(h: np.ndarray, of: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash of each row's set: the bits set in over half of its hashes."""
    lanes, out = h.view(np.uint8).reshape(-1, 8), np.zeros(len(size), np.uint64)
    for j in range(8):
        seen = np.bincount(of * 256 + lanes[:, j], minlength=len(size) * 256).reshape(len(size), 256) @ simhash._BITS
        out |= ((seen * 2 > size[:, None]) @ (1 << np.arange(8))).astype(np.uint64) << np.uint64(8 * j)
    return out.view(np.int64)


def _prefixes(shingle: int, seed: int, t: float, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.chunks(batches):
            h, offs = _sets(table["text"], shingle, seed)
            size = np.diff(offs)
            of = np.repeat(np.arange(table.num_rows), size)
            last = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h if len(often) else np.zeros(len(h), bool)
            ranked = h[np.lexsort((h, last, of))]
            many = np.where(size > 0, size - np.ceil(t * size - 1e-9).astype(np.int64) + 1, 0)
            keep = np.arange(len(h)) - offs[:-1][of] < many[of]
            keys = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(many))), pa.array(ranked[keep].view(np.int64))).cast(pa.list_(pa.int64()))
            prints = {"bits": _print(h, of, size), "more": _print(K.mix64(h), of, size)}
            yield pa.RecordBatch.from_pydict({"id": table["id"].combine_chunks(), "cls": _names(h, offs), "n": size.astype(np.int64), **prints, "keys": keys})

    return run


def _sampled(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.chunks(batches):
            yield pa.RecordBatch.from_pydict({"h": _sets(table["text"], shingle, seed)[0].view(np.int64)})

    return run


def _met(t: float):
    """Edges src, dst of a forest of what meets in each bucket (rows sorted by key and sub): classes
    whose sizes and prints allow a similarity of t. dst is the least class of its tree."""

    def near(n: np.ndarray, bits: np.ndarray, more: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(bits[i] ^ bits[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j])
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        return (apart <= np.where(low >= FEW, REACH, REACH_FEW)) & (low >= t * high - 1e-9)

    def trees(m: int, n: np.ndarray, bits: np.ndarray, more: np.ndarray) -> Iterator[list[int]]:
        left = np.arange(m)
        while len(left) > 1:
            front, left = [int(left[0])], left[1:]
            tree = list(front)
            while front and len(left):
                hit = near(n, bits, more, np.array([front.pop()]), left)
                found, left = left[hit].tolist(), left[~hit]
                tree += found
                front += found
            if len(tree) > 1:
                yield tree

    def buckets(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, sub, n, cls, bits, more = rows
        bits, more = bits.view(np.uint64), more.view(np.uint64)  # bits of signed numbers are counted by absolute value
        at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]), [True])))
        size = np.diff(at)
        two = at[:-1][size == 2]
        two = two[near(n, bits, more, two, two + 1)]
        src, dst = [np.maximum(cls[two], cls[two + 1])], [np.minimum(cls[two], cls[two + 1])]
        for a, m in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
            for tree in trees(m, n[a : a + m], bits[a : a + m], more[a : a + m]):
                ids = np.sort(cls[a : a + m][tree])
                src.append(ids[1:])
                dst.append(np.full(len(ids) - 1, ids[0]))
        u, v = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)]), axis=1)
        yield from pa.Table.from_pydict({"src": u, "dst": v}).to_batches(SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in range(6)])
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            cut = int(np.argmax(last))
            if held and (cut or (held[-1][:2, -1] != rows[:2, 0]).any()):
                yield from buckets(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            elif cut:
                yield from buckets(rows[:, :cut])
            held.append(rows[:, cut:])
        if held:
            yield from buckets(np.concatenate(held, axis=1))

    return run


def _joined(sets: list[np.ndarray], t: float) -> np.ndarray:
    """A label for each set: the first set it is joined with over pairs at least t alike."""
    m, n = len(sets), np.array([len(x) for x in sets], np.int64)
    label = np.arange(m)
    row = np.repeat(label, n)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, col = row[count[col] > 1], col[count[col] > 1]
    # the commonest shingles are columns of a matrix; each other has a list of its holders
    common = np.argsort(-count, kind="stable")[:DENSE]
    common = common[count[common] > 64]
    place = np.full(len(count), -1)
    place[common] = np.arange(len(common))
    dense = place[col] >= 0
    x = np.zeros((m, len(common)), np.float32)
    x[row[dense], place[col[dense]]] = 1
    row, col = row[~dense], col[~dense]
    holders, many = row[np.argsort(col, kind="stable")], np.bincount(col, minlength=len(count))
    start = np.cumsum(many) - many
    work = np.cumsum(np.bincount(row, weights=many[col], minlength=m) + m) // CELLS
    ends = np.append(np.flatnonzero(work[1:] != work[:-1]) + 1, m)
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        own = slice(*np.searchsorted(row, [a, b]))
        times = many[col[own]]
        other = holders[np.repeat(start[col[own]] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        shared = np.bincount(np.repeat(row[own] - a, times) * m + other, minlength=(b - a) * m).reshape(b - a, m) + x[a:b] @ x.T
        alike = shared >= t * (n[a:b, None] + n - shared) - 1e-9
        for i in range(a, b):
            met = label[alike[i - a]]
            if (met != label[i]).any():
                label[np.isin(label, met)] = met.min()
    return label


def _links(shingle: int, seed: int, t: float):
    """Edges src, dst of a forest of the pairs of classes at least t alike in each block of a family
    (rows sorted by family and sub)."""

    def forest(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        names = np.array([x for x, _ in held], np.int64)
        root = names[_joined([x for _, x in held], t)] if len(held) > 1 else names
        return names[names != root], root[names != root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for table in K.chunks(batches):
            h, offs = _sets(table["text"], shingle, seed)
            names, out = _names(h, offs).tolist(), []
            for i, at in enumerate(zip(table["family"].to_pylist(), table["sub"].to_pylist())):
                if at != last:
                    out.append(forest(held))
                    held, last = [], at
                held.append((names[i], h[offs[i] : offs[i + 1]].copy()))
            src, dst = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_pydict({"src": src, "dst": dst})
        src, dst = forest(held)
        yield pa.RecordBatch.from_pydict({"src": src, "dst": dst})

    return run


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, seed: int = 42, sample: int = SAMPLE, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """id and component_id: the smallest id reachable over pairs whose sets of shingles have a
    Jaccard similarity of at least `least`, the row's own included, one row per row with an id.

    Shingles are those of `simhash.simhash`, as a set of 64-bit hashes. Null text is read as
    empty; texts without words are alike. Rows with a null id are passed over.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = max(1, rows.count() // sample)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("text").mapInArrow(_sampled(shingle, seed), "h long")
    seen = some.groupBy("h").count().where(f"count >= {OFTEN}").orderBy(F.desc("count"), "h").limit(LISTED)
    often = np.sort(np.array([r.h for r in seen.collect()], np.int64).view(np.uint64))
    own = materialise(rows.mapInArrow(_prefixes(shingle, seed, least, often), "id long, cls long, n long, bits long, more long, keys array<long>"), "sets")
    one = F.first(F.struct("n", "bits", "more", "keys")).alias("x")
    classes = materialise(own.groupBy("cls").agg(F.min("id").alias("least"), one).select("cls", "least", "x.*"), "set-classes")
    names = classes.select("cls", "least", "n")

    # what SimHash's deletion variants link
    first = classes.groupBy("bits").agg(F.min("cls").alias("rep"))
    star = classes.join(first, "bits").where("cls <> rep").select(F.col("cls").alias("src"), F.col("rep").alias("dst"))
    near = simhash.hamming_links(first.select("bits"))
    near = near.join(first.toDF("src", "a"), "src").join(first.toDF("dst", "b"), "dst").select("a", "b")
    # what meets in a prefix
    keyed = classes.select(F.explode("keys").alias("key"), "n", "cls", "bits", "more")
    large = materialise(keyed.groupBy("key").count().where(f"count > {hot}").selectExpr("key", f"cast(ceil(count / {hot}) as int) AS blocks"), "set-hot")
    if large.isEmpty():
        keyed = keyed.withColumn("sub", F.lit(0).cast("long"))
    else:
        keyed = keyed.join(large, "key", "left").withColumn("own", F.expr("pmod(xxhash64(cls), coalesce(blocks, 1))"))
        keyed = keyed.withColumn("sub", F.expr("explode(transform(sequence(0, coalesce(blocks, 1) - 1), j -> least(own, j) * coalesce(blocks, 1) + greatest(own, j)))"))
    dealt = keyed.select("key", "sub", "n", "cls", "bits", "more").repartition("key", "sub").sortWithinPartitions("key", "sub")
    met = dealt.mapInArrow(_met(least), "src long, dst long")
    edges = materialise(star.unionByName(near.toDF("src", "dst")).unionByName(met).distinct(), "set-edges")
    families = materialise(names.join(connected_components(edges).toDF("cls", "family"), "cls"), "set-families")

    def links(members: DataFrame) -> DataFrame:
        """Links of the texts of members (least, family, sub) that come together."""
        texts = rows.join(members.select(F.col("least").alias("id"), "family", "sub"), "id").select("family", "sub", "text")
        return materialise(texts.repartition("family", "sub").sortWithinPartitions("family", "sub").mapInArrow(_links(shingle, seed, least), "src long, dst long"), "set-links")

    sizes = families.groupBy("family").agg(F.sum("n").alias("_n"), F.count("*").alias("many")).selectExpr("family", "many", f"cast(greatest(1, ceil(_n / {block})) as int) AS blocks")
    sizes = materialise(sizes.where("blocks > 1"), "set-sizes")
    if sizes.isEmpty():
        parts = links(families.withColumn("sub", F.lit(0).cast("long"))).distinct().toDF("cls", "part")
    else:
        cut = families.join(sizes, "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.expr("pmod(xxhash64(cls), blocks)"))
        pivot = f"blocks > 1 AND pmod(xxhash64(cls, 1), many) < {PIVOTS}"
        found = links(cut.withColumn("sub", F.expr(f"explode(CASE WHEN {pivot} THEN sequence(0L, blocks - 1L) ELSE array(own) END)")))
        parts = connected_components(found).toDF("cls", "part")
        # what is outside of a family's largest group meets all of the family
        cut = materialise(cut.where("blocks > 1").join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls")), "set-cut")
        most = cut.groupBy("family", "part").count().groupBy("family").agg(F.max_by("part", F.struct("count", "part")).alias("most"))
        stray = cut.join(most, "family").where("part <> most")
        lots = stray.groupBy("family").agg(F.sum("n").alias("_n")).selectExpr("family", f"cast(ceil(_n / {block}) as long) AS lots")
        every = "explode(transform(sequence(0L, {} - 1), j -> {}))"
        one = stray.join(lots, "family").withColumn("sub", F.expr(every.format("blocks", "pmod(xxhash64(cls, 2), lots) * blocks + j")))
        two = cut.join(lots, "family").withColumn("sub", F.expr(every.format("lots", "j * blocks + own")))
        again = links(one.select("least", "family", "sub").unionByName(two.select("least", "family", "sub")).distinct())
        parts = connected_components(found.unionByName(again)).toDF("cls", "part")
    named = names.join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    named = named.join(named.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("cls", "component_id")
    return own.select("id", "cls").join(named, "cls").select(F.col("id").alias(id_col), "component_id")
