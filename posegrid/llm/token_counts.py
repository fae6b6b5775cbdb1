"""Token counts of whole texts by overlap resynchronisation.

A text of more than `chunk` code points is encoded in chunks that overlap. Two encodings are spliced
at a token that both have at the same place. That such a splice is the encoding of the whole text
follows from how byte-pair merging works:

- Merges are taken by (score, place from the left), an order that doesn't depend on what else is in
  the text. Take the first merge across a border of two neighbouring tokens: up to then each side
  went the same way as it goes alone, so the two tokens' own text would merge there as well.
- So a sequence of tokens is the encoding of its text exactly if each two neighbours are the
  encoding of theirs. Neighbours that stand side by side in the encoding of any chunk are.
- A token that both chunks have joins the neighbours on its left, from one chunk, to those on its
  right, from the other: all pairs of the splice have been met.

Where the overlap has no common token it is widened, at last to the start of the text, and then
the next chunk is longer too, so that a text which never aligns costs a few times its length.
Only identity-normalised byte-pair models are cut; texts of others are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm import kernels as K
from posegrid.llm.bpe import _with
from posegrid.session import ship

#: Code points of a chunk, and by how many two neighbours overlap at first.
CHUNK, OVERLAP = 8_000, 160
LIMIT = 4096


class Counter:
    """Counts tokens with a sentencepiece model, given as the bytes of its file."""

    def __init__(self, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm, self.chunk, self.overlap = spec.normalizer_spec, max(1, chunk), max(1, overlap)
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.splits = plain and spec.trainer_spec.model_type == spec.trainer_spec.BPE and spec.trainer_spec.byte_fallback
        self.prefix = int(norm.add_dummy_prefix)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.byte = np.array([p.type == kinds.BYTE for p in spec.pieces])
        # Code points of a piece's text. A code point that is spelled in bytes belongs to its first byte.
        self.size = np.array([(0x80 > (b := int(p.piece[3:5], 16)) or b >= 0xC0) if p.type == kinds.BYTE else len(p.piece) for p in spec.pieces], np.int64)

    @staticmethod
    @lru_cache(2)
    def of(model: bytes, chunk: int, overlap: int) -> Counter:
        return Counter(model, chunk, overlap)

    def _encoded(self, text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text where the tokens of text[a:b] begin, with its end, and which of the
        tokens may be shared: not spelled in bytes, and not the first of a chunk amid the text,
        which the library's leading space belongs to."""
        ids = self.library.encode(text[a:b], return_type="numpy")
        ids = np.asarray(ids, np.int64)
        at = np.empty(len(ids) + 1, np.int64)
        at[0] = 0
        np.cumsum(self.size[ids], out=at[1:])
        at[1:] -= self.prefix
        at += a
        firm = ~self.byte[ids]
        if a:
            firm[:1] = False
        return at, firm

    def count(self, text: str) -> int:
        """Tokens of the text."""
        if len(text) <= self.chunk or not self.splits:
            return len(self.library.encode(text, return_type="numpy"))
        length, done, live = self.chunk, 0, 0
        end = min(len(text), length)
        at, firm = self._encoded(text, 0, end)
        # tokens from `live` on of the chunk at hand count, `done` are those before them
        while end < len(text):
            to, wide, turn = min(len(text), end + length), self.overlap, 0
            while True:
                start = max(0, end - wide)
                new_at, new_firm = self._encoded(text, start, to)
                if not start:
                    at, firm, done, live, length = new_at, new_firm, 0, 0, 2 * length
                    break
                old = live + np.flatnonzero(firm[live:] & (at[live:-1] >= start))
                new = np.flatnonzero(new_firm & (new_at[1:] <= end))
                _, i, j = np.intersect1d(at[old], new_at[new], assume_unique=True, return_indices=True)
                same = np.flatnonzero(at[old[i] + 1] == new_at[new[j] + 1])
                if len(same):
                    pick = same[len(same) // 2]
                    done, live = done + int(old[i[pick]]) - live, int(new[j[pick]])
                    at, firm = new_at, new_firm
                    break
                turn += 1
                wide += wide + turn
            end = to
        return done + len(firm) - live


def token_counts(docs: DataFrame, model: bytes, text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The rows of docs, without text_col, with n_bytes (UTF-8), n_tokens (as the model's library encodes the whole
    text, without begin, end or added special tokens) and over_limit (more than `limit` tokens).

    model: the bytes of a sentencepiece model file. Null texts count as empty: 0 bytes, 0 tokens.
    Columns called n_bytes, n_tokens or over_limit are replaced, all others passed on; repeated rows
    stay, each with its counts; empty tables stay empty. One narrow pass: nothing is shuffled, and a
    worker holds the tokens of one chunk of a text at a time.
    """
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(model)
    fresh = ("n_bytes", "n_tokens")
    own = docs.drop(*fresh, "over_limit")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(content.value, chunk, overlap)
        for part in K.chunks(batches, text=text_col):
            texts = part[text_col].combine_chunks().fill_null("")
            n_tokens = pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            out = _with(_with(part.drop_columns([text_col]), "n_bytes", n_bytes), "n_tokens", n_tokens)
            yield from out.combine_chunks().to_batches()

    out = own.mapInArrow(run, ", ".join([*kept, "`n_bytes` bigint", "`n_tokens` bigint"]))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
