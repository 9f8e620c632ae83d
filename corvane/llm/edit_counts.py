"""Operator 2: token counts that follow edits.

A document is held as its pre-tokens (the pieces that the vocabulary's pattern splits it into; merges never
cross them) in blocks of `BLOCK` pieces, under a segment tree whose nodes sum characters and tokens
of the blocks below. Trees are a table (`build_trees`): it is made once, by splitting and encoding whole texts, and
edits are applied to its rows (`apply_edits`), which gives counts, or the rows of the table as they are afterwards.

An edit replaces a range of characters. The tree finds the blocks at its ends, and only their pieces are read; they
are split anew from two pieces and any white space before it (a piece depends on the text from its start
on, and looks ahead by no more than a run of white space) until a new piece ends where an old one ended,
after the edit; from there on all pieces are as before. Only pieces in between are encoded again, and sums
are updated on the paths to the root.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Automaton, automaton, split
from .common import arrow_map, materialise, require

BLOCK = 64
#: Characters after an edit that are split anew at first; doubled until pieces meet the old ones.
AHEAD = 256


class Block:
    """Some pieces: their characters and tokens, and the pieces with their counts once they have been read (else the block's number in the table)."""

    __slots__ = ("at", "chars", "counts", "pieces", "tokens")

    def __init__(self, chars: int, tokens: int, at: int = -1, pieces: list[str] | None = None, counts: list[int] | None = None):
        self.chars, self.tokens, self.at, self.pieces, self.counts = chars, tokens, at, pieces, counts

    @staticmethod
    def of(pieces: list[str], counts: list[int]) -> Block:
        return Block(sum(map(len, pieces)), sum(counts), -1, pieces, counts)


def node_sums(leaves: list[int]) -> list[int]:
    """The nodes of a segment tree over `leaves`: node i sums nodes 2i and 2i + 1, the root is node 1, leaves come last."""
    n = len(leaves)
    out = [0] * n + list(leaves)
    for i in range(n - 1, 0, -1):
        out[i] = out[2 * i] + out[2 * i + 1]
    return out


def tree_columns(lens: np.ndarray, counts: np.ndarray) -> tuple[list[int], list[int]]:
    """The nodes' characters and tokens for pieces of these lengths and counts."""
    cuts = np.arange(0, max(1, len(lens)), BLOCK)
    return tuple(node_sums(np.add.reduceat(x, cuts).tolist() if len(x) else [0]) for x in (lens, counts))


class Document:
    """A document under edits, from a row of the table. `tokens` is its count of tokens, `encoded` the number of pieces encoded since it was read."""

    def __init__(self, text: str, lens: np.ndarray, counts: np.ndarray, chars: list[int], tokens: list[int], a: Automaton):
        self.text, self.lens, self.piece_counts = text, lens, counts
        self.count = a.counts.__getitem__
        self.encoded = 0
        n = len(chars) // 2
        self.blocks = [Block(chars[n + i], tokens[n + i], i) for i in range(n)]
        self.chars, self.sums = list(chars), list(tokens)
        self.starts = [0, *accumulate(chars[n:])]  # of the blocks, in the text as it was read

    @staticmethod
    def parse(text: str, a: Automaton) -> Document:
        pieces = split(text)
        lens = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces))
        counts = np.fromiter(map(a.counts.__getitem__, pieces), dtype=np.int32, count=len(pieces))
        return Document(text, lens, counts, *tree_columns(lens, counts), a)

    @property
    def size(self) -> int:
        return self.chars[1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def read(self, i: int) -> Block:
        """Block i with its pieces."""
        b = self.blocks[i]
        if b.pieces is None:
            low = b.at * BLOCK
            ends = list(accumulate(self.lens[low : low + BLOCK].tolist(), initial=self.starts[b.at]))
            b.pieces = [self.text[x:y] for x, y in zip(ends, ends[1:])]
            b.counts = self.piece_counts[low : low + BLOCK].tolist()
        return b

    def pieces(self) -> list[str]:
        return [p for i in range(len(self.blocks)) for p in self.read(i).pieces]

    def columns(self) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
        """lens, counts, chars and tokens of the document as it is now; blocks that no edit read are copied."""
        lens, counts = [], []
        for b in self.blocks:
            if b.pieces is None:
                low = b.at * BLOCK
                lens.append(self.lens[low : low + BLOCK])
                counts.append(self.piece_counts[low : low + BLOCK])
            else:
                lens.append(np.fromiter(map(len, b.pieces), dtype=np.int32, count=len(b.pieces)))
                counts.append(np.array(b.counts, dtype=np.int32))
        lens, counts = np.concatenate(lens), np.concatenate(counts)
        return lens, counts, *tree_columns(lens, counts)

    def before(self, block: int) -> int:
        """Characters in the blocks before `block`."""
        n, out = len(self.blocks), 0
        a, b = n, n + block
        while a < b:
            if a & 1:
                out += self.chars[a]
                a += 1
            if b & 1:
                b -= 1
                out += self.chars[b]
            a, b = a // 2, b // 2
        return out

    def find(self, at: int) -> int:
        """The block that holds the character at offset `at` (the last one, at the end)."""
        low, high = 0, len(self.blocks) - 1
        while low < high:
            mid = (low + high + 1) // 2
            if self.before(mid) <= at:
                low = mid
            else:
                high = mid - 1
        return low

    def put(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        """Blocks first..last get these pieces instead of theirs."""
        n, leaves = last - first + 1, len(self.blocks)
        if len(pieces) > 2 * BLOCK * n or (not pieces and n < leaves):  # the number of blocks changes
            self.blocks[first : last + 1] = [Block.of(pieces[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(pieces), BLOCK)]
            self.chars, self.sums = node_sums([b.chars for b in self.blocks]), node_sums([b.tokens for b in self.blocks])
            return
        cut = [len(pieces) * i // n for i in range(n + 1)]
        for i in range(n):
            at = leaves + first + i
            b = self.blocks[first + i] = Block.of(pieces[cut[i] : cut[i + 1]], counts[cut[i] : cut[i + 1]])
            self.chars[at], self.sums[at] = b.chars, b.tokens
            at //= 2
            while at:
                self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
                self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]
                at //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts `new` in place of the characters start..end; offsets outside the text are held to its ends."""
        size = self.size
        start = min(max(0, start), size)
        end = min(max(start, end), size)
        first, last = self._back(self.find(start), start), self.find(end)
        base = self.before(first)
        held, counts = [], []
        for i in range(first, last + 1):
            held += self.read(i).pieces
            counts += self.blocks[i].counts
        ahead = AHEAD
        while True:
            ends = list(accumulate(map(len, held), initial=base))  # of old pieces, from the start on
            # the first piece to split anew: two before the one with the edit's start, and white space before those
            k = next((i for i in range(len(held)) if ends[i + 1] >= start), len(held))
            k = max(0, k - 2)
            while k and held[k - 1].isspace():
                k -= 1
            k = max(0, k - 1)
            line = "".join(held)
            right = line[end - base :]
            whole = last + 1 >= len(self.blocks)
            if whole or len(right) >= ahead:
                shift, after = len(new) - (end - start), start + len(new)
                old = {e + shift: i for i, e in enumerate(ends) if e >= end}
                # pieces near the end of what is held might depend on text beyond it
                limit = size + shift if whole else ends[-1] + shift - ahead // 2
                at, fresh, meet = ends[k], [], len(held) if whole else None
                for p in split(line[ends[k] - base : start - base] + new + right):
                    fresh.append(p)
                    at += len(p)
                    if after <= at <= limit and at in old:
                        meet = old[at]
                        break
                if meet is not None:
                    self.encoded += len(fresh)
                    self.put(first, last, held[:k] + fresh + held[meet:], counts[:k] + list(map(self.count, fresh)) + counts[meet:])
                    return
            ahead *= 2
            more = 0
            while more < ahead and last + 1 < len(self.blocks):
                last += 1
                held += self.read(last).pieces
                counts += self.blocks[last].counts
                more += self.blocks[last].chars

    def _back(self, block: int, start: int) -> int:
        """A block early enough for four pieces that aren't white space ahead of `start`."""
        offset, found = self.before(block), 0
        for p in self.read(block).pieces:
            offset += len(p)
            if offset >= start:
                break
            found += not p.isspace()
        while block and found < 4:
            block -= 1
            found += sum(not p.isspace() for p in self.read(block).pieces)
        return block


EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("new", T.StringType())]))
#: The columns of a tree: lengths and counts of its pieces, and its nodes' sums of characters and tokens.
TREE = ("lens", "counts", "chars", "tokens")
INTS = T.ArrayType(T.IntegerType())


def _lists(rows: list) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))).astype(np.int32)
    values = np.concatenate([np.asarray(r, dtype=np.int32) for r in rows]) if rows else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _rows(column: pa.Array):
    """A list column's values as one array, and its offsets."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False).tolist()


def _tokenizer(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def build_trees(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The table of trees: doc_id, text, lens, counts, chars, tokens, and the columns `carry`; one row per row of `docs`.

    A null text counts as empty and becomes so. Special tokens' strings count as plain text. Repeated rows stay; an
    empty table gives an empty result. `tokenizer` as in `bpe.encode_table`.
    """
    require(docs, doc_id, text, *carry)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carry)
    source = _tokenizer(docs, tokenizer)

    def run(batches):
        a = automaton(source.value)
        for batch in batches:
            trees = []
            for x in batch.column(1).to_pylist():
                d = Document.parse(x, a)
                trees.append((d.lens, d.piece_counts, d.chars, d.sums))
            made = [_lists([t[i] for t in trees]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *TREE])

    return arrow_map(rows, run, T.StructType([*rows.schema.fields, *[T.StructField(c, INTS) for c in TREE]]))


def apply_edits(trees: DataFrame, tokenizer: str, edits: str = "edits", keep: bool = False) -> DataFrame:
    """Applies a column of edits to the rows of `build_trees`' table.

    One row per row: doc_id, n_chars, n_tokens (before), n_tokens_edited, n_pieces, n_encoded (pieces encoded again),
    n_edits; with `keep` also the table's columns as they are after the edits. `edits`: array of (start, end, new),
    applied in order, offsets in code points of the text as it is then, held to its ends; a null array has none, a null
    `new` is empty, null offsets are 0 and the start.
    """
    require(trees, "doc_id", "text", *TREE, edits)
    rows = trees.select("doc_id", "text", *TREE, F.col(edits).cast(EDITS).alias("edits"))
    source = _tokenizer(trees, tokenizer)
    names = ["n_chars", "n_tokens", "n_tokens_edited", "n_pieces", "n_encoded", "n_edits"]

    def run(batches):
        a = automaton(source.value)
        for batch in batches:
            out, after, texts = [], [], []
            held = [_rows(batch.column(i)) for i in range(2, 6)]
            for i, (text, changes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(6).to_pylist())):
                lens, counts, chars, sums = (values[at[i] : at[i + 1]] for values, at in held)
                d = Document(text, lens, counts, chars.tolist(), sums.tolist(), a)
                before = d.tokens
                for e in changes or []:
                    at = (e or {}).get("start") or 0
                    end = (e or {}).get("end")
                    d.edit(at, at if end is None else end, (e or {}).get("new") or "")
                out.append((len(text), before, d.tokens, len(lens), d.encoded, len(changes or [])))
                if keep:
                    texts.append("".join(d.pieces()))
                    after.append(d.columns())
            arrays = [batch.column(0), *(pa.array([r[i] for r in out], pa.int64()) for i in range(6))]
            if keep:
                arrays += [pa.array(texts, pa.string()), *(_lists([t[i] for t in after]) for i in range(4))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, *(["text", *TREE] if keep else [])])

    fields = [rows.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names]]
    if keep:
        fields += [T.StructField("text", T.StringType()), *[T.StructField(c, INTS) for c in TREE]]
    return arrow_map(rows, run, T.StructType(fields))


def count_edits(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """`apply_edits` to a table of trees made of `docs` and written to the shared folder, where later edits could follow."""
    trees = build_trees(docs, tokenizer, doc_id, text, (edits,))
    return apply_edits(materialise(trees, "trees", "zstd"), tokenizer, edits)


def attach_edits(docs: DataFrame, edits: DataFrame, doc_id: str = "doc_id", name: str = "edits") -> DataFrame:
    """`docs` (or trees) and a column of their edits, from a table (doc_id, seq, start, end, new) in order of seq.

    A document's edits are held together, as its text is. Documents without edits get null.
    """
    one = F.struct("seq", F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "new").alias("e"))
    by = edits.groupBy(doc_id).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"]).alias(name))
    return docs.join(by, doc_id, "left")
