import math
import os
import random

import pytest

from lodeseam.llm.packing import count_tokens, encoder, pack, pack_documents
from lodeseam.llm.queries import VOCABULARY

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def check(items, placed, capacity):
    """Every document whole or in full containers, ranges without gaps, no container overfull."""
    held: dict = {}
    ranges: dict = {}
    for container, doc, start, end in placed:
        held[container] = held.get(container, 0) + end - start
        ranges.setdefault(doc, []).append((start, end))
    assert all(v <= capacity for v in held.values())
    for doc, size, *_ in items:
        own = sorted(ranges[doc])
        assert own[0][0] == 0 and own[-1][1] == size and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert len(own) == max(1, math.ceil(size / capacity))
    return held


def test_fill_and_validity():
    rng = random.Random(1)
    for capacity in (100, 2048):
        items = [(k, int(rng.lognormvariate(math.log(capacity / 5), 0.9)), rng.choice("abc"), k) for k in range(3000)]
        held = check(items, pack(items, capacity), capacity)
        assert len(held) <= math.ceil(sum(i[1] for i in items) / capacity * 1.01) + 1


def test_copies_keep_apart():
    items = [(k, 10, "s", k % 5) for k in range(50)]
    placed = pack(items, 50)
    by: dict = {}
    for c, doc, _, _ in placed:
        by.setdefault(c, []).append(doc % 5)
    assert len(by) == 10 and all(len(set(v)) == len(v) for v in by.values())
    # a third of the rows are copies of one text: fill comes first in the end
    hot = [(k, 10, "s", 0) for k in range(30)] + [(100 + k, 10, "s", 1 + k) for k in range(60)]
    assert len(check(hot, pack(hot, 100), 100)) <= 10


def test_edges():
    assert pack([], 10) == []
    placed = pack([("a", 25, None, 1), ("b", 0, None, 2), (None, 5, None, 3)], 10)
    assert set(placed) == {(1, "a", 0, 10), (2, "a", 10, 20), (0, "a", 20, 25), (0, None, 0, 5), (0, "b", 0, 0)} and len(placed) == 5
    assert pack([("b", 0, None, 2)], 10) == [(0, "b", 0, 0)]
    assert sorted(p[1:] for p in pack([("x", 20, "s", 1)], 10)) == [("x", 0, 10), ("x", 10, 20)]


@needs_vocabulary
def test_long_texts_are_counted_whole():
    e = encoder(VOCABULARY)
    text = "The quick brown fox jumps over the lazy dog, 123 times. " * 1000
    assert count_tokens(text, e) == len(e.encode_ordinary(text))
    assert count_tokens("x" * 60_000, e) > 1000 and count_tokens("", e) == 0


@needs_vocabulary
def test_frame(spark):
    ddl = "doc_id int, text string, source string, created_at timestamp, container string, tokens string"
    rows = [(k, f"document number {k} " * (k % 40), "s", None, "x", "y") for k in range(300)] + [(5, "again", None, None, None, None), (900, None, None, None, None, None), (901, "", None, None, None, None), (None, "no id", None, None, None, None), (902, "word " * 30_000, None, None, None, None)]
    got = pack_documents(spark.createDataFrame(rows, ddl), VOCABULARY, 256, per_task=100).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    e = encoder(VOCABULARY)
    held = check([(902, len(e.encode_ordinary("word " * 30_000)))], [(r["container"], r["doc_id"], r["token_start"], r["token_end"]) for r in got], 256)
    assert sum(held.values()) / (256 * len([v for v in held.values() if v])) > 0.9
    assert pack_documents(spark.createDataFrame([], ddl), VOCABULARY).count() == 0


def test_token_counts_of_long_texts():
    """Long texts count what the tokenizer says, and runs that it cannot take are counted as well."""
    encoding = encoder(VOCABULARY)
    rng = random.Random(1)
    for _ in range(20):
        text = "".join(rng.choice(["word ", "  ", " \n", "x" * rng.randint(1, 50), "12", "'s", "don't", "...", "é語", " " * rng.randint(1, 90), "\t", '{"a": 1,}\n']) for _ in range(6000))
        assert count_tokens(text, encoding) == len(encoding.encode_ordinary(text))
    assert count_tokens(" " * 3_000_000, encoding) == 3_000_000 and count_tokens("x" * 1_000_000, encoding) == 125_000


def test_sources_keep_apart():
    """Documents of one source share no container while other containers can take them."""
    rng = random.Random(6)
    items = [(k, rng.randint(20, 900), f"s{k % 700}", k) for k in range(3000)]
    placed = pack(items, 2048)
    held = check(items, placed, 2048)
    assert len(held) <= -(-sum(i[1] for i in items) // 2048) + 2
    inside: dict = {}
    for container, doc, _, _ in placed:
        inside.setdefault(container, []).append(items[doc][2])
    assert sum(len(set(s)) < len(s) for s in inside.values()) <= 0.01 * len(held)
