"""Operator 6: byte-pair encoding and decoding with a tokenization automaton.

Merges are compiled, in order, into a deterministic automaton over tokens whose accepted token sequences
are just the ones that the merges produce. It starts as one state with a loop for each byte. The gadget of
a merge (u, v) -> w, for every state q with an arc u whose target has an arc v:
  * w gets an arc from q, to where v led (w's state is a copy of v's at this time);
  * u's arc now leads to a state without the arc v.
A token's arcs all lead to one state, so states are named by the token last read, and a state differs from
the first one by the arcs it has lost: v itself by a merge (u, v), and every later token that begins with a
lost one. So the gadgets keep, for each token, its two parts and its time, and for each state the arcs it
lost at its own merges. A merge whose parts never meet (the automaton has no arc v from u at its time) does
nothing, and a token that only such merges make is in no arc. (Where a merge names a token that only a later one
makes, which training never does, merges take place out of order; such vocabularies are merged pair by pair.) The automaton is determinised as it is used: of
the square of the vocabulary's size of transitions, `arc` resolves one along the parts when it is first met
and puts it in the state's table, where all later steps find it.

To encode a pre-split word, states run along its bytes: from the state at each byte offset, every
vocabulary entry that the bytes spell there is a candidate arc. Every byte string has exactly one accepted
sequence, so each offset is reached once. The arcs' labels, read off the path and joined, decode it.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, at_task_end, require

#: Fixed value: the pattern that pre-splits text for this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
#: The same splits, by a faster engine, for texts of ASCII and Latin letters only: there [^\W\d_] is \p{L}, \d is \p{N}, and white space agrees.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ɏ]")
#: Words whose encoding, and words whose count a task keeps (in each of two generations), and transitions that a worker keeps until they start afresh.
CACHE, COUNTED, CELLS = 100_000, 250_000, 500_000
END = -1


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary file: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split(text: str) -> list[str]:
    return _FAST.findall(text) if _OTHER.search(text) is None else _SPLIT.findall(text)


class Recent(dict):
    """What was made of the words met lately: two generations of `most` words each, so that frequent ones stay."""

    def __init__(self, a: Automaton, most: int):
        super().__init__()
        self.a, self.most, self.before = a, most, {}

    def __missing__(self, text: str):
        if len(self) >= self.most:
            self.before = dict(self)
            super().clear()
        found = self.before.get(text)
        if found is None:
            found = self.make(text)
        self[text] = found
        return found

    def clear(self) -> None:
        super().clear()
        self.before = {}


class Words(Recent):
    """Encodings of words: the number of tokens, their ids joined by commas, and their labels joined."""

    def make(self, text: str) -> tuple[int, str, bytes]:
        ids, label = self.a.encode_word(text.encode("utf-8", "surrogatepass")), self.a.label
        return len(ids), ",".join(map(str, ids)), b"".join([label[i] for i in ids])


class Counts(Recent):
    """Words' numbers of tokens."""

    def make(self, text: str) -> int:
        return len(self.a.encode_word(text.encode("utf-8", "surrogatepass")))


class Automaton:
    """The automaton of a byte-level BPE vocabulary: `vocabulary` maps byte strings to ids, `merges` are pairs of byte strings in order."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.label = {i: b for b, i in vocabulary.items()}
        self.special = dict(special or {})
        self.label |= {i: s.encode() for s, i in self.special.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.time: dict[int, int] = {}
        self.lost: dict[tuple[int, int], int] = {}
        self.table: dict[int, dict[int, bool]] = {}
        for b in (bytes([x]) for x in range(256)):
            if b in vocabulary:
                self.time[vocabulary[b]] = -1
        pairs = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in merges]
        early: set[int] = set()
        for k, pair in enumerate(pairs):
            self._gadget(k, *pair, early)
        # merges of tokens that later ones make take place out of order, for which there is no gadget
        self.ranks = {(u, v): (k, w) for k, (u, v, w) in enumerate(pairs)} if early & set(self.time) else None
        self.reachable = {self.label[i]: i for i in self.time}
        # the vocabulary's bytes as a tree; END leads to the entry that ends there
        self.root: dict[int, dict | int] = {}
        for b, i in self.reachable.items():
            node = self.root
            for octet in b:
                node = node.setdefault(octet, {})
            node[END] = i
        self.cells = 0
        self.words, self.counts = Words(self, CACHE), Counts(self, COUNTED)
        self._specials = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _gadget(self, k: int, u: int, v: int, w: int, early: set[int]) -> None:
        """Merge k; tokens that it needs and that aren't made yet go to `early`."""
        if u not in self.time or v not in self.time:
            early |= {x for x in (u, v) if x not in self.time}
            return
        if not self._open(u, v, k):
            return
        self.lost.setdefault((u, v), k)
        if w not in self.time:
            self.left[w], self.right[w], self.time[w] = u, v, k

    def _open(self, q: int, x: int, before: int) -> bool:
        """Whether state q has arc x after the gadgets before time `before`."""
        while True:
            if self.lost.get((q, x), before) < before:
                return False
            a, b = self.time[q], self.time[x]
            if a < 0 and b < 0:
                return True
            if b >= a:  # x came later (or is its own neighbour): its arcs are where its first part's were, this gadget's cut included
                x, before = self.left[x], min(before, b + 1)
            else:  # q is a copy of its last part's state as it was before q's gadget
                q, before = self.right[q], min(before, a)

    def arc(self, q: int, x: int) -> bool:
        row = self.table.get(q)
        if row is None:
            row = self.table[q] = {}
        if (yes := row.get(x)) is None:
            yes = row[x] = self._open(q, x, 1 << 60)
        return yes

    def encode_word(self, word: bytes) -> list[int]:
        if self.ranks is not None:
            return self._merged(word)
        if (whole := self.reachable.get(word)) is not None:
            return [whole]  # an entry's own bytes are read as that entry
        n, root, table = len(word), self.root, self.table
        state: list[int] = [-1] * (n + 1)
        for at in range(n):
            q = state[at]
            row = table.get(q)
            if row is None:
                row = table[q] = {}
            node, end = root, at
            while end < n:
                node = node.get(word[end])
                if node is None:
                    break
                end += 1
                x = node.get(END)
                if x is None or state[end] >= 0:
                    continue
                if at == 0:
                    state[end] = x  # the first state has every arc
                    continue
                yes = row.get(x)
                if yes is None:
                    yes = row[x] = self._open(q, x, 1 << 60)
                    self.cells += 1
                if yes:
                    state[end] = x
        out, label = [], self.label
        while n:
            out.append(state[n])
            n -= len(label[state[n]])
        if self.cells > CELLS:
            self.table, self.cells = {}, 0
        return out[::-1]

    def _merged(self, word: bytes) -> list[int]:
        """Merges one by one, for the rare vocabularies that have no automaton."""
        ids = [self.reachable[bytes([b])] for b in word]
        while True:
            found = [(*self.ranks[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in self.ranks]
            if not found:
                return ids
            _, w, i = min(found, key=lambda x: (x[0], x[2]))
            ids[i : i + 2] = [w]

    def word(self, text: str) -> tuple[int, str, bytes]:
        """(number of tokens, ids in decimal joined by commas, labels joined) of a pre-split word."""
        return self.words[text]

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """Stretches of plain text, and special tokens that stand in it with their ids."""
        if self._specials is None:
            return [(text, None)]
        out, at = [], 0
        for m in self._specials.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)] if at else [(text, None)]

    def encoded(self, text: str) -> tuple[int, str, bytes]:
        """As `word`, of a whole text."""
        n, lines, labels = 0, [], []
        word = self.words.__getitem__
        for part, special in self.parts(text):
            if special is not None:
                n, lines, labels = n + 1, [*lines, str(special)], [*labels, self.label[special]]
            elif part:
                counts, ids, spelled = zip(*map(word, split(part)))
                n += sum(counts)
                lines += ids
                labels += spelled
        return n, ",".join(lines), b"".join(labels)

    def encode(self, text: str) -> list[int]:
        line = self.encoded(text)[1]
        return [int(x) for x in line.split(",")] if line else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.label[i] for i in ids]).decode("utf-8", "replace")


def compile_tokenizer(source: bytes) -> Automaton:
    """The automaton of a tokenizer file's content (JSON, byte-level BPE without normaliser)."""
    spec = json.loads(source)
    model, alphabet = spec["model"], byte_alphabet()
    if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("a byte-level BPE tokenizer without normaliser or prefix space is needed")

    def octets(x: str) -> bytes:
        return bytes([alphabet[c] for c in x])

    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    vocabulary = {octets(t): i for t, i in model["vocab"].items() if t not in special}
    pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
    return Automaton(vocabulary, [(octets(a), octets(b)) for a, b in pairs], special)


#: Automata of this worker, by their file's digest.
_held: dict[str, Automaton] = {}


def _forget() -> None:
    for a in _held.values():
        a.words.clear()
        a.counts.clear()


at_task_end(_forget)


def automaton(source: bytes) -> Automaton:
    key = hashlib.sha256(source).hexdigest()
    if key not in _held:
        _held[key] = compile_tokenizer(source)
    return _held[key]


def encode_table(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256, with `ids` the tokens (array), and with `decoded` the decoded text.

    `tokenizer`: path, on the driver, of a tokenizer file; its content (of fixed size) is broadcast. A null
    text counts as empty; an empty text has no tokens. Special tokens' strings in a text give their ids, as
    the file says. Whole texts are encoded; repeated rows stay; an empty table gives an empty result. Other
    columns are not read.
    """
    require(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with open(tokenizer, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        a = automaton(source.value)
        for batch in batches:
            n, sha, back, tokens, texts = [], [], [], [], []
            for x in batch.column(1).to_pylist():
                k, line, data = a.encoded(x or "")
                n.append(k)
                sha.append(hashlib.sha256(line.encode()).hexdigest())
                plain = data.decode("utf-8", "replace")
                back.append(hashlib.sha256(plain.encode()).hexdigest())
                if ids:
                    tokens.append(np.array(line.split(",") if line else [], dtype=np.int32))
                if decoded:
                    texts.append(plain)
            arrays, names = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                arrays, names = [*arrays, pa.array(tokens, pa.list_(pa.int32()))], [*names, "tokens"]
            if decoded:
                arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    more = (", tokens array<int>" if ids else "") + (", decoded string" if decoded else "")
    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def decode_table(encoded: DataFrame, tokenizer: str, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """doc_id and the text that an array of token ids stands for (null: null)."""
    require(encoded, doc_id, tokens)
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(tokens).alias("tokens"))
    with open(tokenizer, "rb") as f:
        source = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        a = automaton(source.value)
        for batch in batches:
            texts = [None if x is None else a.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
