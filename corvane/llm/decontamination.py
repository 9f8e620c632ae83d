"""Operator 5: benchmark decontamination by template canonicalisation.

Texts of documents and benchmark items are cut into words (runs of letters, and runs of digits), which are read
twice. As templates: numbers (digits, number words and runs of them), names (runs of capitalised words, first words of
sentences included) and units after a number become typed placeholders, other words are lower-cased. And plainly: all
words in lower case, so that a verbatim copy is found whatever its case, punctuation and spacing. Windows of `words`
words are hashed, and documents' windows are hash joined with the items'. Each run of shared windows is then aligned:
the longest common subsequence of the item's words and the document's words around the run tells how many of the
item's words are there in order, whatever was changed, inserted or left out between them. A document holds an item
from `coverage` of its words on. So that templates which agree by chance don't count as the same question with other
parameters, a run is held to slot consistency: a value that fills several slots of the item must be filled by one
value in the document too, as far as words stand at the run's own distance. DataFrame operations only.

Words are longs throughout: a placeholder's code, or the hash of the lower-case word. Both readings of a text stand in
one array, a separator between them, so that one pass over its positions makes all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require

# Number words and units that become placeholders.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb lbs oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds "
    "ounce ounces liter liters litre litres dollar dollars cent cents euro euros percent degree degrees mph kmh hz khz mhz ghz kb mb gb tb v kv w kw kwh j kj pa kpa"
).split()
#: Codes of placeholders, and of the separator between the readings.
SEPARATOR, NAME, NUMBER, UNIT = 0, 1, 2, 3
#: Words of an item that a long holds while they are aligned, one bit each.
BLOCK = 62
#: Benchmark windows beyond which they are no longer broadcast but joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
SLOT = "struct<i:string,d:string>"


def words_of(text: Column) -> Column:
    """Runs of letters and marks, and runs of digits, which are set off by a zero in front."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Nd}+", " 0$0 ")
    return F.array_remove(F.split(digits, r"[^\p{L}\p{N}\p{M}]+"), "")


def placeholder(code: Column) -> Column:
    return code.between(NAME, UNIT)


def _codes(raw: str, low: str, h: str) -> Column:
    """Each word's code: a name, a number, or its hash."""

    def code(w, i):
        x = F.get(low, i)
        name = F.when(w == x, False).otherwise(w.rlike(r"^\p{Lu}\p{Ll}"))
        return F.when(x.isin(NUMBER_WORDS) | x.between("0", "1"), F.lit(NUMBER).cast("long")).when(name, F.lit(NAME).cast("long")).otherwise(F.get(h, i))

    return F.transform(raw, code)


def _with_units(codes: str, low: str) -> Column:
    return F.transform(codes, lambda c, i: F.when((F.get(codes, i - 1) == NUMBER) & F.get(low, i).isin(UNITS), F.lit(UNIT).cast("long")).otherwise(c))


def _goes_on(codes: str, i: Column) -> Column:
    """Whether a word belongs to the slot of the one before: names and numbers in a row are one."""
    c = F.get(codes, i)
    return c.isin(NAME, NUMBER) & F.coalesce(F.get(codes, i - 1) == c, F.lit(False))


def slot_starts(codes: str) -> Column:
    """Places of the words that begin a template word."""
    return F.when(F.size(codes) > 0, F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda i: ~_goes_on(codes, i))).otherwise(F.array().cast("array<int>"))


def slot_value(low: str, starts: Column, k: Column) -> Column:
    """The words of the k-th template word."""
    first = F.get(starts, k)
    return F.array_join(F.slice(low, first + 1, F.coalesce(F.get(starts, k + 1), F.size(low)) - first), " ")


def with_readings(rows: DataFrame, text: str) -> DataFrame:
    """`rows` without `text`, and low (lower-case words), codes (of each word), h (their hashes) and t (the template's words)."""
    held = [F.col(f"`{c}`") for c in rows.columns if c != text]
    rows = rows.select(*held, words_of(F.col(text)).alias("raw")).select(*held, "raw", F.transform("raw", lambda w: F.lower(w)).alias("low"))
    rows = rows.select(*held, "raw", "low", F.transform("low", lambda w: F.xxhash64(w)).alias("h"))
    rows = rows.select(*held, "low", "h", _codes("raw", "low", "h").alias("codes"))
    rows = rows.select(*held, "low", "h", _with_units("codes", "low").alias("codes"))
    return rows.select(*held, "low", "codes", "h", F.filter("codes", lambda c, i: ~_goes_on("codes", i)).alias("t"))


def _window_hash(plain: Column, words: str, at: Column, size: int) -> Column:
    return F.xxhash64(plain, *[F.get(F.col(words), at + i) for i in range(size)])


def item_readings(benchmark: DataFrame, item_id: str, text: str, words: int) -> DataFrame:
    """Both readings of each item: ik (a hash of item and reading), item_id, plain, n (words), size (words of a window),
    raw (each word's or slot's value), ih (its words), and masks (for each BLOCK words a map from a word to its places).
    Repeated items with one text count once."""
    rows = with_readings(benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct(), "text")
    rows = rows.withColumn("starts", slot_starts("codes"))
    values = F.transform("t", lambda _, k: slot_value("low", F.col("starts"), k))
    both = F.array(F.struct(F.lit(False).alias("plain"), F.col("t").alias("ih"), values.alias("raw")), F.struct(F.lit(True).alias("plain"), F.col("h").alias("ih"), F.col("low").alias("raw")))
    rows = rows.select("item_id", F.inline(both)).where(F.size("ih") > 0)

    def mask(part):
        def places(w):
            at = F.transform(part, lambda x, i: F.when(x == w, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
            return F.aggregate(at, F.lit(0).cast("long"), lambda a, y: a.bitwiseOR(y))

        return F.map_from_entries(F.transform(F.array_distinct(part), lambda w: F.struct(w, places(w))))

    blocks = F.sequence(F.lit(0), F.floor((F.size("ih") - 1) / BLOCK).cast("int"))
    ik = F.xxhash64(F.col("item_id"), F.col("item_id").isNull(), F.col("plain"), F.array_join("raw", " "), F.col("ih"))
    return rows.select(
        ik.alias("ik"), "item_id", "plain", F.size("ih").alias("n"), F.least(F.size("ih"), F.lit(words)).alias("size"), "raw", "ih",
        F.transform(blocks, lambda k: mask(F.slice("ih", k * BLOCK + 1, BLOCK))).alias("masks"),
    )


def item_windows(items: DataFrame, words: int) -> DataFrame:
    """The windows of `item_readings`: ik, n, size, idx, key, before (the word before the window, null where there is no
    window with it). Template windows that are placeholders alone say nothing. Items of fewer words have one window of
    all their words."""

    def literal(i):
        return F.col("plain") | F.exists(F.slice("ih", i + 1, F.col("size")), lambda w: ~placeholder(w))

    each = items.withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size")))).where(literal(F.col("idx")))
    key = F.coalesce(*[F.when(F.col("size") == n, _window_hash(F.col("plain"), "ih", F.col("idx"), n)) for n in range(1, words + 1)])
    before = F.when((F.col("idx") > 0) & literal(F.greatest(F.col("idx") - 1, F.lit(0))), F.get("ih", F.col("idx") - 1))
    return each.select("ik", "n", "size", "idx", key.alias("key"), before.alias("before"))


def _document_windows(rows: DataFrame, sizes: list[int], *carry: str) -> DataFrame:
    """The windows of rows with `s` (both readings) and `m` (words of the first): pos, size and key, with `carry`."""
    least = min(sizes)
    # the condition is on the position: one on `s` would be pushed down and read every text twice
    each = rows.select(*carry, "s", "m", F.explode(F.sequence(F.lit(0), F.greatest(F.size("s") - least, F.lit(0)))).alias("pos"))
    each = each.where(F.col("pos") + least <= F.size("s"))
    plain = F.col("pos") > F.col("m")
    if len(sizes) == 1:
        return each.select(*carry, "s", "m", "pos", F.lit(least).alias("size"), _window_hash(plain, "s", F.col("pos"), least).alias("key"))
    keys = F.array(*[F.struct(F.lit(n).alias("size"), F.when(F.col("pos") + n <= F.size("s"), _window_hash(plain, "s", F.col("pos"), n)).alias("key")) for n in sizes])
    return each.select(*carry, "s", "m", "pos", F.inline(keys))


def _around(n: Column, shift: Column) -> Column:
    """What stands around a run: h (words of the document in the run's reading, as many as the item has and some more),
    w (the values of its template words; none in the plain reading) and at (where the item's first word would stand)."""
    plain = F.col("pos") > F.col("m")
    base, end = F.when(plain, F.col("m") + 1).otherwise(0), F.when(plain, F.size("s")).otherwise(F.col("m"))
    slack = F.floor(n / 4).cast("int") + 2  # words that may be inserted or missing
    start = F.greatest(shift - slack, base)
    stop = F.least(shift + n + slack, end)
    starts = slot_starts("codes")
    values = F.when(~plain, F.transform(F.array(starts), lambda st: F.transform(F.sequence(start, stop - 1), lambda k: slot_value("low", st, k)))[0]).otherwise(F.array().cast("array<string>"))
    return F.struct(F.slice("s", start + 1, stop - start).alias("h"), values.alias("w"), (shift - start).alias("at"))


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, words: int) -> DataFrame:
    """First windows of runs that a document shares with an item: doc_id, dk (hash of the text), the item's reading, and `_around` it.

    The windows of benchmarks are broadcast up to BROADCAST_WINDOWS of them. Beyond, windows are shuffled without their
    documents' words, hot ones split by the engine's skew handling, and documents with hits are read again.
    """
    items = item_readings(benchmark, item_id, item_text, words)
    windows = item_windows(items, words)
    counts = {r["size"]: r["c"] for r in windows.groupBy("size").agg(F.count(F.lit(1)).alias("c")).collect()}  # `words` rows at most
    small = sum(counts.values()) <= BROADCAST_WINDOWS
    rows = with_readings(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("dk"), F.col(text).alias("text")), "text")
    rows = rows.select("doc_id", "dk", "low", "codes", F.size("t").alias("m"), F.concat("t", F.array(F.lit(SEPARATOR).cast("long")), "h").alias("s"))
    side = (F.broadcast if small else lambda x: x)(windows)
    carry = ("doc_id", "dk", "low", "codes") if small else ("doc_id", "dk")
    each = _document_windows(rows, sorted(counts) or [words], *carry)
    last = F.when(F.col("pos") > 0, F.get("s", F.greatest(F.col("pos") - 1, F.lit(0))))
    if not small:  # of a document's words only the one before goes along
        each = each.select(*carry, "m", "pos", "size", "key", last.alias("last"))
        last = F.col("last")
    met = each.join(side, ["key", "size"])
    # a window whose forerunner is shared too belongs to that one's run
    met = met.where(F.col("before").isNull() | last.isNull() | (last != F.col("before")))
    if not small:
        met = met.select(F.col("doc_id").alias("id_"), F.col("dk").alias("dk_"), "ik", "pos", "idx", "n").distinct()
        met = met.join(rows, F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("dk_") == F.col("dk")))
    # as a generator, so that it isn't put off until after the join: a row must not carry its whole document on
    found = met.select("doc_id", "dk", "ik", F.explode(F.array(_around(F.col("n"), F.col("pos") - F.col("idx")))).alias("around"))
    return found.join(F.broadcast(items) if small else items, "ik")


def common_words(masks: Column, region: Column) -> Column:
    """Words of an item in the longest common subsequence with `region`, by bits: after each word of the region, the zeros of the longs are the length's steps.

    A long holds BLOCK words; what an addition carries out of one goes into the next, so that the blocks act as one number.
    """
    full, none = F.lit((1 << BLOCK) - 1).cast("long"), F.lit(0).cast("long")

    def places(m, w):
        return F.coalesce(F.try_element_at(m, w), none)

    def step(v, m):
        u = v.bitwiseAND(m)
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)

    def zeros(v):
        return BLOCK - F.bit_count(v)

    single = zeros(F.aggregate(region, full, lambda v, w: step(v, places(F.get(masks, F.lit(0)), w))))

    def carried(state, m, v, w):
        u = v.bitwiseAND(places(m, w))
        total = v + u + state["carry"]
        return F.struct(F.concat(state["vs"], F.array(total.bitwiseOR(v - u).bitwiseAND(full))).alias("vs"), F.shiftright(total, BLOCK).alias("carry"))

    def all_steps(vs, w):
        start = F.struct(F.array().cast("array<bigint>").alias("vs"), none.alias("carry"))
        both = F.arrays_zip(masks.alias("m"), vs.alias("v"))
        return F.aggregate(both, start, lambda state, x: carried(state, x["m"], x["v"], w))["vs"]

    several = F.aggregate(F.aggregate(region, F.transform(masks, lambda _: full), all_steps), F.lit(0), lambda a, v: a + zeros(v))
    return F.when(F.size(masks) == 1, single).otherwise(several)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, coverage: float = 0.6) -> DataFrame:
    """One row per document text and item that it holds: doc_id, dk (hash of the text), item_id, n_words, n_found, coverage, n_slots, reparameterised.

    Words are those of the reading, with slots or plain, that covers more. `reparameterised` is true where no alignment
    has the item's own slot values. Rows with one doc_id and text give one row. Null and empty texts hold nothing, null
    and empty items are held by nothing; a null doc_id or item_id is a value like others. Empty tables give an empty result.
    """
    require(docs, doc_id, text)
    require(benchmark, item_id, item_text)
    found = hits(docs, benchmark, doc_id, text, item_id, item_text, words)
    region = F.col("around.h")
    # words that aren't there at all can't be in any alignment
    found = found.where(F.size(F.array_except("ih", region)) <= F.col("n") * (1 - coverage) + 1e-9)

    def equal(i):
        return F.coalesce(F.get("ih", i) == F.get(region, F.col("around.at") + i), F.lit(False))

    def aligned(i):
        """Equal, in three equal words at least (or in all of a shorter item)."""
        return equal(i) & ((F.col("n") < 3) | (equal(i - 1) & (equal(i + 1) | equal(i - 2))) | (equal(i + 1) & equal(i + 2)))

    slots = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: placeholder(F.get("ih", i)) & aligned(i))
    pairs = F.array_distinct(F.transform(slots, lambda i: F.struct(F.get("raw", i).alias("i"), F.get(F.col("around.w"), F.col("around.at") + i).alias("d"))))
    found = found.withColumn("slots", F.when(~F.col("plain"), pairs).otherwise(F.array().cast(f"array<{SLOT}>")))
    steady = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    same = F.forall("slots", lambda s: s["i"] == s["d"])
    lines = found.where(steady).select("doc_id", "dk", "item_id", "n", common_words(F.col("masks"), region).alias("found"), F.size("slots").alias("slots"), same.alias("same"))
    lines = lines.withColumn("coverage", F.col("found") / F.col("n")).where(F.col("coverage") >= coverage)
    best = F.max(F.struct("coverage", "n", "found"))
    out = lines.groupBy("doc_id", "dk", "item_id").agg(best.alias("best"), F.max("slots").alias("n_slots"), F.max("same").alias("same"))
    return out.select("doc_id", "dk", "item_id", F.col("best.n").alias("n_words"), F.col("best.found").alias("n_found"), F.col("best.coverage").alias("coverage"), "n_slots", (~F.col("same")).alias("reparameterised"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` whose text holds no item, with all their columns; rows without a text stay."""
    bad = contaminated(docs, benchmark, doc_id, text, **how).select(F.col("doc_id").alias("id_"), "dk").distinct().alias("bad")
    rows = docs.alias("rows")
    on = F.col(f"rows.`{doc_id}`").eqNullSafe(F.col("bad.id_")) & (F.xxhash64(F.col(f"rows.`{text}`")) == F.col("bad.dk"))
    return rows.join(bad, on, "left_anti")
