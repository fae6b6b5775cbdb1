"""Byte-level BPE as a tokenization automaton.

The automaton reads tokens. It starts as one state with a loop for each byte. Merges are compiled
in order, each by a gadget: for the merge (u, v) -> w, the state q that arcs labelled u lead to is
copied without its arc v, arcs u are led to the copy, and every state with an arc u gets an arc w
to where v led. What is left accepts exactly the token sequences that BPE makes. All arcs with one
label lead to one state.

States are numbered: those of a token in the order of its copies. A state's arcs are those of the
state it was copied from (its link) less the one lost, and the arcs of later tokens wherever it has
an arc to their left part; so (state, token) is looked up in the table of lost arcs and else handed
on by links, and what was found is kept in a table of transitions.

Words are read byte by byte through a trie of the tokens with failure links, whose node names the
longest token that ends there, and each token the next shorter one. The longest of these that the
state before it has an arc for is the prefix's one last token; walking these back gives the arcs.
Decoding emits the arcs' labels, the tokens' bytes.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posegrid.llm import kernels as K
from posegrid.session import ship

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pre-split of byte-level BPE vocabularies of this kind.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Entries of a worker's tables before they are begun anew; they only save time.
TABLE = 300_000
#: Longer words walk the tables one by one, as few go side by side.
LONG = 48


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for
    themselves, the others by code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges. Tokens are known by their ids, bytes by the ids of one-byte tokens."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: t for t, i in vocab.items()}
        self.rank: dict[int, int] = {}  # merge that made a token, -1 for bytes
        self.left: dict[int, int] = {}
        self.base: dict[int, tuple[int, int] | None] = {}  # a token's first state: another token's, as it was
        self.when: dict[int, list[int]] = {}  # merges that copied the token's state
        self.lost: dict[int, dict[int, int]] = {}  # arcs lost by these copies, and when
        self.known: dict[tuple[int, int], bool] = {}
        for b in range(256):
            if (i := vocab.get(bytes([b]))) is not None:
                self.rank[i], self.base[i], self.when[i], self.lost[i] = -1, None, [], {}
        for m, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in self.rank or u not in self.rank or v not in self.rank or not self._arc(u, len(self.when[u]), v):
                continue  # made before, or never met
            self.rank[w], self.left[w] = m, u
            self.base[w], self.when[w], self.lost[w] = (v, len(self.when[v])), [], {}
            self.when[u].append(m)
            self.lost[u][v] = m
        self._number()
        self._trie()

    def _number(self) -> None:
        """Arrays of the numbered states: owner (the token whose arcs lead there, or did), created
        (the merge that copied it, -2 for a token's first), link and, by token, the last state."""
        ids = sorted(self.rank)
        n = np.array([len(self.when[i]) + 1 for i in ids])
        offs = dict(zip(ids, (np.cumsum(n) - n).tolist()))
        many = max(self.label) + 1
        self.owner = np.repeat(np.array(ids, np.int64), n)
        self.created = np.array([m for i in ids for m in (-2, *self.when[i])], np.int64)
        self.order = self.owner << 32 | (self.created + 2)
        self.link = np.full(len(self.owner), -1, np.int64)
        self.state, self.made, self.before = np.full(many, -1, np.int32), np.full(many, -1, np.int64), np.full(many, -1, np.int64)
        for i in ids:
            self.state[i], self.made[i], self.before[i] = offs[i] + len(self.when[i]), self.rank[i], self.left.get(i, -1)
            if self.base[i] is not None:
                self.link[offs[i]] = offs[self.base[i][0]] + self.base[i][1]
        lost = sorted((u << 32 | v, m) for u, arcs in self.lost.items() for v, m in arcs.items())
        self.lost_arc = np.array([x for x, _ in lost] + [1 << 62], np.int64)
        self.lost_at = np.array([m for _, m in lost] + [1 << 62], np.int64)
        self.length = np.zeros(many, np.int64)
        self.length[list(self.label)] = [len(t) for t in self.label.values()]
        self.pair = np.full(1 << 21, -1, np.int64)
        self.pair_arc = np.zeros(1 << 21, bool)

    def _trie(self) -> None:
        """The trie of the tokens' bytes: edges by (node, byte), failure links, and the tokens that end at a node."""
        edges: dict[int, int] = {}
        node_of: dict[int, int] = {}
        above = [0]  # (node, byte) that leads to each node; nodes come after those they hang on
        for i in sorted(self.rank, key=lambda i: len(self.label[i])):
            node = 0
            for byte in self.label[i]:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(above)
                    above.append(key)
                node = edges[key]
            node_of[node] = i
        if any(b not in edges for b in range(256)):
            raise ValueError("a token for each byte is needed")
        depth = [0] * len(above)
        for k in range(1, len(above)):
            depth[k] = depth[above[k] >> 8] + 1
        fail, ends = [0] * len(above), [-1] * len(above)
        shorter = [-1] * (max(self.label) + 1)
        for k in sorted(range(1, len(above)), key=depth.__getitem__):
            if depth[k] > 1:
                at, byte = fail[above[k] >> 8], above[k] & 255
                while (at << 8 | byte) not in edges:
                    at = fail[at]
                fail[k] = edges[at << 8 | byte]
            ends[k] = ends[fail[k]]
            if k in node_of:
                shorter[node_of[k]], ends[k] = ends[k], node_of[k]
        self.edges, self.failed, self.ended, self.next = edges, fail, ends, shorter
        keys = sorted(edges)
        self.edge, self.to = np.array([*keys, 1 << 62], np.int64), np.array([*(edges[k] for k in keys), 0], np.int64)
        self.fail, self.ends, self.shorter = np.array(fail, np.int64), np.array(ends, np.int64), np.array(shorter, np.int64)

    def _advance(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's node after each node and byte; the root has an edge for each byte."""
        out, rest, byte = np.empty(len(node), np.int64), np.arange(len(node)), byte.astype(np.int64)
        while len(rest):
            key = node << 8 | byte
            at = np.searchsorted(self.edge, key)
            hit = self.edge[at] == key
            out[rest[hit]] = self.to[at[hit]]
            rest, node, byte = rest[~hit], self.fail[node[~hit]], byte[~hit]
        return out

    def _has(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether each state has an arc of the token beside it, by lost arcs and links."""
        out, rest = np.zeros(len(s), bool), np.arange(len(s))
        while len(rest):
            u, made = self.owner[s], self.made[t]
            arc = u << 32 | t
            at = np.searchsorted(self.lost_arc, arc)
            gone = (self.lost_arc[at] == arc) & (self.lost_at[at] <= self.created[s])
            # the state as it was when t was made
            s = np.minimum(s, np.searchsorted(self.order, u << 32 | (made + 2), "right") - 1)
            link = self.link[s]
            root = (self.created[s] < 0) & (link < 0) & (made < 0) & ~gone
            out[rest[root]] = True
            s, t = np.where(link >= 0, link, s), np.where(link >= 0, t, self.before[t])
            go = ~(gone | root)
            rest, s, t = rest[go], s[go], t[go]
        return out

    def step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The state that each state's arc of the token beside it leads to, or -1, by a table that
        is filled as pairs are first met."""
        pair = state.astype(np.int64) << 32 | token
        j = (K.mix64(pair.view(np.uint64)) >> np.uint64(43)).astype(np.int64)
        out, new = self.pair_arc[j], np.flatnonzero(self.pair[j] != pair)
        if len(new):
            fresh, back = np.unique(pair[new], return_inverse=True)
            out[new] = self._has(fresh >> 32, fresh & 0xFFFFFFFF)[back]
            self.pair[j[new]], self.pair_arc[j[new]] = pair[new], out[new]
        return np.where(out, self.state[token], -1)

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """Ids (as int32 bytes) of many words at once, place by place."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        far = int((size > LONG).sum())
        out: list[bytes] = [b""] * len(words)
        for k in order[:far].tolist():
            out[k] = np.array(self.encode(words[k]), np.int32).tobytes()
        order = order[far:]
        size = size[order]
        if not len(order) or not size[0]:
            return out
        width = int(size[0])
        flat = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in order.tolist()), np.uint8).reshape(-1, width)
        byte = np.ascontiguousarray(flat.T)
        state = np.full((width + 1, len(order)), -1, np.int32)
        node = np.zeros(len(order), np.int64)
        alive = np.searchsorted(-size, -np.arange(width + 1), "right")  # words that reach a place
        for i in range(1, width + 1):
            node = self._advance(node[: alive[i]], byte[i - 1, : alive[i]])
            rest, token = np.arange(len(node)), self.ends[node]
            while len(rest):
                n = self.length[token]
                to = self.state[token]
                ask = (n > 1) & (n < i)  # the start has all arcs, and one token ends each prefix
                to[ask] = self.step(state[i - n[ask], rest[ask]], token[ask])
                state[i, rest] = to
                rest, token = rest[to < 0], self.shorter[token[to < 0]]
        at, steps, which = size.copy(), [], np.flatnonzero(size)
        while len(which):
            t = self.owner[state[at[which], which]]
            steps.append((which, t))
            at[which] -= self.length[t]
            which = which[at[which] > 0]
        of = np.concatenate([w for w, _ in steps[::-1]])
        ids = np.concatenate([t for _, t in steps[::-1]])
        ids = ids[np.argsort(of, kind="stable")]
        ends = np.cumsum(np.bincount(of, minlength=len(order))) * 4
        raw, begin = ids.astype(np.int32).tobytes(), 0
        for k, end in zip(order.tolist(), ends.tolist()):
            out[k] = raw[begin:end]
            begin = end
        return out

    def _arc(self, u: int, copies: int, t: int) -> bool:
        """Whether the state of token u after so many copies has an arc labelled t, while merges are compiled."""
        while True:
            at, made = self.lost[u].get(t), self.rank[t]
            if at is not None and at <= (self.when[u][copies - 1] if copies else -1):
                return False
            copies = min(copies, bisect.bisect_right(self.when[u], made))
            if copies:  # the arc t was made after the last of these copies: wherever there was an arc to its left part
                t = self.left[t]
                continue
            if self.base[u] is None:
                if made < 0:
                    return True
                t = self.left[t]
                continue
            u, copies = self.base[u]

    def arc(self, u: int, t: int) -> bool:
        key = (u, t)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 4 * TABLE:
                self.known.clear()
            found = self.known[key] = self._arc(u, len(self.when[u]), t)
        return found

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word, by the same tables."""
        last, node = [-1], 0
        for i, byte in enumerate(word, 1):
            while (key := node << 8 | byte) not in self.edges:
                node = self.failed[node]
            node = self.edges[key]
            t = self.ended[node]
            while (n := len(self.label[t])) > 1 and n < i and not self.arc(last[i - n], t):
                t = self.next[t]
            last.append(t)
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= len(self.label[last[i]])
        return out[::-1]


class Coder:
    """A vocabulary file's automaton, its special strings, and tables of what a worker has seen."""

    loaded: dict[str, Coder] = {}

    def __init__(self, content: str):
        spec = json.loads(content)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer is needed")
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.automaton = Automaton(vocab, [(to_bytes(a), to_bytes(b)) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT).findall
        self.units = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        after, before = re.compile(f" [{SPACE}]").search, re.compile(f"[{SPACE.replace(' ', '')}] ").search
        self.loose = lambda text: after(text) or before(text)
        labels = [self.automaton.label.get(i, b"") for i in range(max([*vocab.values(), *self.special.values()]) + 1)]
        for s, i in self.special.items():
            labels[i] = s.encode()
        self.flat = np.frombuffer(b"".join(labels), np.uint8)
        self.size = np.array([len(x) for x in labels], np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.seen: dict[str, bytes] = {}

    @classmethod
    def of(cls, content: str) -> Coder:
        if content not in cls.loaded:
            cls.loaded.clear()
            cls.loaded[content] = cls(content)
        return cls.loaded[content]

    def _units(self, text: str) -> list[str]:
        """A text's runs between spaces, each with the space before it. Where single spaces stand
        between runs without spaces at their ends, cutting at spaces gives the same."""
        if self.loose(text):
            return self.units(text)
        units = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.units(text)
        return units if units[0] else units[1:]

    def _learn(self, units: set[str]) -> None:
        """Fill the table of units, with their words' ids."""
        new = [u for u in units if u not in self.seen]
        split = [[u] if u.isalpha() or u[0] == " " and u[1:].isalpha() else self.split(u) for u in new]
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, self.automaton.encode_many([w.encode() for w in words])))
        for u, ws in zip(new, split):
            self.seen[u] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids (as int32 bytes) of each text."""
        cut: list[list[str | bytes]] = []
        for text in texts:
            if not text:
                cut.append([])
            elif self.parts is None or not self.parts.search(text):
                cut.append(self._units(text))
            else:
                pieces = self.parts.split(text)
                cut.append([x for i, part in enumerate(pieces) if part for x in ([np.int32(self.special[part]).tobytes()] if i % 2 else self._units(part))])
        if len(self.seen) > TABLE:
            self.seen.clear()
        self._learn({u for units in cut for u in units if u not in self.seen and type(u) is str})
        seen = self.seen
        out = []
        for units in cut:
            try:
                out.append(b"".join([seen[u] for u in units]))
            except KeyError:  # ids of special strings among the units
                out.append(b"".join([u if type(u) is bytes else seen[u] for u in units]))
        return out

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        """Texts of several id lists at once; bytes that aren't UTF-8 become U+FFFD."""
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int64)
        place = np.repeat((self.start[ids] - ends + size).astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        data = self.flat[place]
        to = np.concatenate(([0], ends))[offs]
        out = K.strings(data, to)
        try:
            out.validate(full=True)
            return out
        except pa.ArrowInvalid:
            raw = data.tobytes()
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(to[:-1].tolist(), to[1:].tolist())], pa.string())


def _lists(ids: list[bytes]) -> pa.Array:
    values = np.frombuffer(b"".join(ids), np.int32)
    offs = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values))


def _with(table: pa.Table, name: str, column: pa.Array) -> pa.Table:
    table = table.drop_columns([name]) if name in table.column_names else table
    return table.append_column(name, column)


def _field(df: DataFrame, name: str, kind: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name]
    return ", ".join([*kept, f"`{name}` {kind}"])


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows of docs with ids_col, the list of token ids of the whole text: as the file's own
    library encodes it without adding special tokens; special strings within a text are one id.

    vocabulary: the JSON file's content (not its path: executors need not see the driver's files).
    Null and empty texts give an empty list. A column that is called ids_col is replaced; all
    others are passed on. Repeated rows and ids make no difference. Empty tables stay empty.
    """
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(content.value)
        for part in K.chunks(batches, text=text_col):
            yield from _with(part, ids_col, _lists(coder.encode(part[text_col].to_pylist()))).combine_chunks().to_batches()

    return docs.mapInArrow(run, _field(docs, ids_col, "array<int>"))


def bpe_decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with text_col, the text of the ids in ids_col, special tokens included. A null
    list gives an empty text; ids outside the vocabulary raise an error; a column that is called
    text_col is replaced."""
    ship(rows.sparkSession)
    content = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(content.value)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for a in range(0, table.num_rows, 1000):
                part = table.slice(a, 1000)
                lists = part[ids_col].combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                size = np.nan_to_num(np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()])).astype(np.int64)
                text = coder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(size))))
                yield from _with(part, text_col, text).combine_chunks().to_batches()

    return rows.mapInArrow(run, _field(rows, text_col, "string"))


def bpe_round_trip(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows of docs, without text_col, with ids_col and with out_col, the text decoded from
    those ids: bpe_encode and bpe_decode in one pass of one worker, so that a task holds the
    automaton once. Nulls and clashing names are treated as they are there."""
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(content.value)
        for part in K.chunks(batches, text=text_col):
            ids = _lists(coder.encode(part[text_col].to_pylist()))
            text = coder.decode(ids.values.to_numpy(), ids.offsets.to_numpy())
            yield from _with(_with(part.drop_columns([text_col]), ids_col, ids), out_col, text).combine_chunks().to_batches()

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in (text_col, ids_col, out_col)]
    return docs.mapInArrow(run, ", ".join([*kept, f"`{ids_col}` array<int>", f"`{out_col}` string"]))


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding each row's whole text."""
    back = bpe_round_trip(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), vocabulary)
    return back.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
