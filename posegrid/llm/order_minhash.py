"""Document fingerprints by order MinHash.

A text's k-mers are runs of `k` code points, each numbered by how often it came before. For each
of `size` hash functions the `PICK` k-mers with the least values are selected (the earlier of two
with one 32-bit value), put back into text order, and hashed as a tuple: two texts share a signature entry only if they share these k-mers
in the same order, so likeness follows edit distance, not only common content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posegrid.llm import kernels as K
from posegrid.llm.bpe import _field, _with
from posegrid.session import ship

MER, SIZE, PICK, RANGES = 8, 64, 2, 8
U = np.uint64
_SALT = K.mix64(np.arange(2 * SIZE, dtype=U) + U(4242))
_XOR, _MUL = (_SALT[:SIZE] >> U(32)).astype(np.uint32), (_SALT[SIZE:] >> U(32)).astype(np.uint32) | np.uint32(1)


def signature(text: str, k: int = MER) -> np.ndarray:
    """SIZE entries of 16 bits. All are 0 for an empty text; a text of fewer than k code points
    is one k-mer; where there are fewer k-mers than PICK all are taken."""
    h = K.mix64(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U))
    if not len(h):
        return np.zeros(SIZE, np.uint16)
    step, mult = 1, K.MULT
    if len(h) < k:
        acc = U(len(h))
        for x in h:
            acc = (acc * K.MULT) + x
        h = np.array([acc], U)
    else:
        while step < k:
            more = min(step, k - step)
            h = h[:-more] * U(pow(int(mult), more, 1 << 64)) + h[more:]
            step += more
    bits = max(1, int(len(h) - 1).bit_length())
    sorted_ = np.sort(h >> U(bits) << U(bits) | np.arange(len(h), dtype=U))
    at = (sorted_ & U((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = sorted_[1:] >> U(bits) != sorted_[:-1] >> U(bits)
    run = np.flatnonzero(new)
    times = np.empty(len(h), U)
    times[at] = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    mer = K.mix64(h + times * U(0xD1B54A32D192ED03))
    x = (mer >> U(32)).astype(np.uint32)
    out = np.empty(SIZE, np.uint16)
    block = max(1, min(SIZE, (1 << 18) // len(x)))
    for a in range(0, SIZE, block):
        y = (x[None, :] ^ _XOR[a : a + block, None]) * _MUL[a : a + block, None]
        rows = np.arange(len(y))
        picks = []
        for _ in range(min(PICK, len(x))):
            p = y.argmin(1)
            picks.append(p)
            y[rows, p] = 0xFFFFFFFF
        picks = np.sort(np.stack(picks), axis=0)
        acc = np.full(len(y), U(7))
        for p in picks:
            acc = K.mix64(acc * K.MULT + mer[p])
        out[a : a + block] = (acc >> U(48)).astype(np.uint16)
    return out


def _hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two fingerprints; null if either is null."""
    same = F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: (F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4))).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.lit(float(SIZE))


def order_minhash(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", k: int = MER) -> DataFrame:
    """The rows of docs with out_col, the whole text's fingerprint as 4 * SIZE hex digits.

    Null texts are read as empty, whose fingerprint is all zeros. Equal texts have equal
    fingerprints. A column called out_col is replaced; empty tables stay empty.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.chunks(batches, text=text_col):
            prints = [_hex(signature(t or "", k)) for t in part[text_col].to_pylist()]
            yield from _with(part, out_col, pa.array(prints, pa.string())).combine_chunks().to_batches()

    return docs.mapInArrow(run, _field(docs, out_col, "string"))


def _neighbours(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows part, key, id, text, extra, dealt by ranges of the id, RANGES of them for each of `parts`
    partitions. Each range ends with an extra row, a copy of the row that follows its last one
    (after the last of all, the first). The driver sees two numbers for each range."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(-(2**63))))
    many = parts * RANGES
    cuts = rows.agg(F.percentile_approx("key", [i / many for i in range(1, many)] or [0.5], max(10_000, 4 * many))).first()[0] or []
    shared = spark.sparkContext.broadcast(np.unique(np.array(cuts, np.int64)))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(shared.value, batch["key"].to_numpy(), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    firsts = rows.select("key").mapInArrow(ranged, "key long, part int").groupBy("part").agg(F.min("key").alias("key"))
    begins = sorted((r.part, r.key) for r in firsts.collect())
    follows = [(p, k) for (p, _), (_, k) in zip(begins, begins[1:] + begins[:1])]
    after = spark.createDataFrame(follows, "part int, key long")
    heads = rows.join(F.broadcast(after), "key").groupBy("part", "key").agg(F.min("text").alias("text"))
    extra = heads.select("part", "key", F.lit(None).cast("long").alias("id"), "text", F.lit(1).alias("extra"))
    dealt = rows.select("id", "text", "key").mapInArrow(ranged, "id long, text string, key long, part int").select("part", "key", "id", "text", F.lit(0).alias("extra"))
    # whole ranges, in order: hashing their numbers would give some tasks several and others none
    return dealt.unionByName(extra).repartitionByRange(parts, "part").sortWithinPartitions("part", "extra", "key", "text")


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = MER) -> DataFrame:
    """Fingerprints of texts, and of their edits, as a probe of the method.

    The edited text has its last n_chars DIV 4 code points replaced by the first as many (or all)
    of the next row's text; next is by id, null ids first, then by text, and the first row follows
    the last. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next, one row per input row. A lone row is its own next. Null texts are read as empty.
    """
    ship(docs.sparkSession)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: part, id, text, signature

        for table in K.chunks(batches):
            out = []
            for part, id_, extra, text in zip(*(table[c].to_pylist() for c in ("part", "id", "extra", "text"))):
                own = signature(text, k)
                if held is not None and held[0] == part:
                    n = len(held[2])
                    cut = n // 4
                    edited = held[2][: n - cut] + text[:cut]
                    sig = signature(edited, k)
                    out.append((held[1], n, hashlib.sha256(edited.encode()).hexdigest(), _hex(held[3]), _hex(sig), float((sig == held[3]).mean()), float((own == held[3]).mean())))
                held = None if extra else (part, id_, text, own)
            names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    kind = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _neighbours(docs, id_col, text_col, parts).mapInArrow(run, kind).withColumnRenamed("id", id_col)
