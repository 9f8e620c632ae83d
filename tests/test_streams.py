"""Gates and boards over many small batches, out of order, against the batch operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import dialogue, safety
from corvane.streaming import sessions as streams

PIECES = "answer_id string, n int, piece string, last boolean"


def run(spark, build, ddl, batches, folder, name):
    """The rows that a stream gives when each of `batches` is one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/b{i:03d}")
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder))
    q = build(source).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_matcher_equals_a_search_of_all():
    rng = random.Random(6)
    words = ["bypass", "jump", "the", "defeat", "door", "lock", "interlock", "xbypass", "doors", "\n", "   ", " " * 60, "a", "of it", "12345678901234567890"]
    pattern = re.compile(safety.FORBIDDEN_OUTPUT)
    seen = [0, 0]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice([" ", "", " "]) for _ in range(rng.randint(1, 60)))
        m, at, hit = streams.Matcher(), 0, False
        while at < len(text) and not hit:
            n = rng.choice([1, 1, 2, 7, 40])
            hit = m.hit(text[at : at + n])
            at += n
            assert hit == (pattern.search(text[:at]) is not None)
            assert len(m.tail) <= streams.SPAN + 1
        seen[hit] += 1
    assert min(seen) > 300


def test_gate_over_single_characters_equals_the_batch_gate(spark, tmp_path):
    texts = {"a": "Open the lid and then bypass the door lock now.", "b": "All is well here, no hazard.", "c": "jump    the wire, not a d oor"}
    size = max(map(len, texts.values()))
    chars = {k: [(k, i, c, i == len(t) - 1) for i, c in enumerate(t)] for k, t in texts.items()}
    flat = [r for rows in chars.values() for r in rows]
    want = {r.answer_id: r.released for r in safety.released_prefix(spark.createDataFrame(flat, PIECES), hold_back=6).groupBy("answer_id").agg(F.max("released").alias("released")).collect()}
    batches = [[r for rows in chars.values() for r in rows[i : i + 3]] for i in range(0, size, 3)]
    got = run(spark, lambda s: streams.gate_stream(s, hold_back=6, ttl_ms=None), PIECES, [b for b in batches if b], tmp_path / "gate", "gate_chars")
    text = {k: "".join(r.released for r in got if r.answer_id == k) for k in texts}
    assert text["b"] == texts["b"] and text["c"] == texts["c"]  # released whole at their ends
    assert any(r.stopped for r in got if r.answer_id == "a") and text["a"] == texts["a"][: want["a"]]


def test_gate_puts_pieces_in_order(spark, tmp_path):
    batches = [[("a", 2, "three ", False), ("a", 0, "one ", False)], [("a", 0, "one ", False)], [("a", 3, "four", True), ("b", 1, "the door", True)], [("a", 1, "two ", False), ("b", 0, "bypass ", False)]]
    got = run(spark, lambda s: streams.gate_stream(s, hold_back=0, ttl_ms=None), PIECES, batches, tmp_path / "order", "gate_order")
    assert "".join(r.released for r in got if r.answer_id == "a") == "one two three four"
    assert [(r.released, r.stopped) for r in got if r.answer_id == "b"] == [("", False), ("", True)]


@pytest.mark.parametrize("seed", [1])
def test_boards_out_of_order_equal_the_batch_fold(spark, tmp_path, seed):
    rng, ddl = random.Random(seed), "conv_id long, turn long, role string, text string"
    said = ["it leaks F5 E2", "checked. those look good", "still not working", "1. Check the drain hose [1]\n2. See TEST #4", "that did not help", "ok", "the door stays locked", "ok, no issues found here"]
    turns = [(c, t, "user" if t % 2 else "assistant", rng.choice(said)) for c in (1, 2, 3) for t in range(1, 10)]
    shuffled = rng.sample(turns, len(turns))
    got = run(spark, lambda s: streams.fold_boards(s, ttl_ms=None), ddl, [shuffled[i : i + 5] for i in range(0, len(shuffled), 5)], tmp_path / "boards", f"boards_{seed}")
    last = {r.conv_id: r.asDict(recursive=True) for r in got}
    want = {r.conv_id: r.asDict(recursive=True) for r in dialogue.fold_boards(spark.createDataFrame(turns, ddl)).collect()}
    assert last == want
