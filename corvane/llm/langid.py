"""Operator 4: language identification by hyperdimensional profiles.

Each letter, of whatever script, has a random vector of +1 and -1 of its own, drawn from its code point. The vector of
a trigram abc binds (multiplies) a's vector permuted twice, b's permuted once and c's; a document's vector bundles
(adds) those of its trigrams, each as often as it stands there, and a language's prototype those of its documents, each
at unit length. A document gets the language whose prototype has the largest cosine with it; that cosine is its score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, at_task_end, doc_crc, require

DIMENSIONS = 2048
SEED = 20240501
#: What stands for white space, punctuation, digits and the text's ends.
BLANK = 32
#: Characters handled at once, trigrams bundled at once (few enough to stay in the cache of a core), and trigrams whose vectors a worker keeps.
BLOCK, ROWS, KEPT = 1 << 18, 64, 20_000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """Whether each code point is a letter, made once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's trigrams (three code points of 21 bits) in order, and their counts; lower case, what is no letter as one blank. Empty without a letter."""
    none = np.empty(0, dtype=np.int64)
    if not text:
        return none, none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter, parts, tail = is_letter(), [], np.array([BLANK])
    for at in range(0, len(points), BLOCK):
        s = points[at : at + BLOCK]
        s = np.concatenate((tail, np.where(letter[s], s, BLANK), [BLANK] if at + BLOCK >= len(points) else none))
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] != BLANK) | (s[:-1] != BLANK)
        s = s[keep]
        if len(s) > 2:
            parts.append(np.unique((s[:-2] << 42) | (s[1:-1] << 21) | s[2:], return_counts=True))
        tail = s[-2:]
    if len(parts) < 2:
        return parts[0] if parts else (none, none)
    ids, places = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return ids, np.bincount(places, np.concatenate([p[1] for p in parts])).astype(np.int64)


class Vectors:
    """Letters' and trigrams' vectors, made when they are first asked for."""

    def __init__(self, seed: int = SEED, dimensions: int = DIMENSIONS):
        self.seed, self.dimensions = seed, dimensions
        self.letters: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.place: dict[int, int] = {}
        self.table, self.rows = np.empty((KEPT, dimensions), dtype=np.int8), np.empty((ROWS, dimensions), dtype=np.float32)

    def letter(self, point: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A letter's vector permuted (rotated) twice, once and not."""
        if (found := self.letters.get(point)) is None:
            v = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
            v = v.astype(np.int8)
            if len(self.letters) >= KEPT:
                self.letters.clear()
            found = self.letters[point] = (np.roll(v, 2), np.roll(v, 1), v)
        return found

    def gram(self, g: int) -> np.ndarray:
        return self.letter(g >> 42)[0] * self.letter(g >> 21 & 0x1FFFFF)[1] * self.letter(g & 0x1FFFFF)[2]

    def _places(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the table that hold the vectors of `ids` (no more than it has rows)."""
        held = self.place
        ids = ids.tolist()
        new = [g for g in ids if g not in held]
        if len(held) + len(new) > KEPT:
            held.clear()
            new = ids
        for g in new:
            self.table[len(held)] = self.gram(g)
            held[g] = len(held)
        return np.fromiter(map(held.__getitem__, ids), dtype=np.int64, count=len(ids))

    def bundle(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of trigrams' vectors, each as often as counted."""
        out, weights = np.zeros(self.dimensions), counts.astype(np.float32)
        for low in range(0, len(ids), KEPT):
            places = self._places(ids[low : low + KEPT])
            for at in range(0, len(places), ROWS):
                rows = self.rows[: min(ROWS, len(places) - at)]
                rows[:] = self.table[places[at : at + ROWS]]
                out += weights[low + at : low + at + len(rows)] @ rows
        return out


#: Vectors of this task, by seed and dimensions.
_held: dict[tuple[int, int], Vectors] = {}
at_task_end(_held.clear)


def vectors(seed: int, dimensions: int) -> Vectors:
    if (seed, dimensions) not in _held:
        _held[seed, dimensions] = Vectors(seed, dimensions)
    return _held[seed, dimensions]


def document_vector(text: str | None, seed: int = SEED, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """A text's vector at unit length; None without a letter, or if its trigrams cancel out."""
    ids, counts = grams(text)
    if not len(ids):
        return None
    v = vectors(seed, dimensions).bundle(ids, counts)
    size = float(np.sqrt(v @ v))
    return v / size if size else None


class Profiles:
    """Prototypes at unit length, one for each of `names`."""

    def __init__(self, prototypes: dict[str, np.ndarray], seed: int = SEED, dimensions: int = DIMENSIONS):
        self.names, self.seed, self.dimensions = sorted(prototypes), seed, dimensions
        rows = [prototypes[n] / max(float(np.linalg.norm(prototypes[n])), 1e-9) for n in self.names]
        self.table = np.stack(rows) if rows else np.zeros((0, dimensions))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, cosine, 0 where negative); `und` and 0 without a letter or without any language learned."""
        v = document_vector(text, self.seed, self.dimensions) if self.names else None
        if v is None:
            return UNKNOWN, 0.0
        cosines = self.table @ v
        best = int(np.argmax(cosines))
        return self.names[best], float(min(1.0, max(0.0, cosines[best])))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = 20_000, seed: int = SEED, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes of the non-null languages of `docs`, from `rows_per_language` rows of each at most, about.

    Where a language has more rows, those whose key hashes under a threshold are taken. The driver gets one
    vector for each language.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)).alias("r"))
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = F.lit(1 << 20)
    for name, n in many.items():
        if n > rows_per_language:
            bound = F.when(F.col("lang") == name, F.lit(int((1 << 20) * rows_per_language / n))).otherwise(bound)
    rows = rows.where(F.col("r") < bound).select("lang", "text")

    def bundled(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, x in zip(*(c.to_pylist() for c in batch.columns)):
                if (v := document_vector(x, seed, dimensions)) is not None:
                    held[name] = held[name] + v if name in held else v
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = arrow_map(rows, bundled, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).toLocalIterator():
        found.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["x"]
    return Profiles(found, seed, dimensions)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` and two columns: the language predicted from the whole text, and its score (0 to 1).

    A null text and one without a letter get `und` and 0. Rows stay as they are, repeated ones too; an
    empty table gives an empty result. The model (of fixed size for each language) is broadcast.
    """
    require(docs, text)
    at = docs.columns.index(text)
    model = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        p = model.value
        for batch in batches:
            found = [p.predict(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names, *names])

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def held_out(column: str = "doc_id"):
    """The hold-out rule: crc32 of the id as text, modulo 3, is 1."""
    return F.pmod(doc_crc(column), F.lit(3)) == 1
