"""Leaks and reading levels."""

import random
import unicodedata

import numpy as np

from lodeseam.llm import leaks
from lodeseam.llm.leaks import SuffixAutomaton, find_leaks, leaked_spans, remove_leaks, without_spans, words
from lodeseam.llm.reading import ReadingModel, document_frequencies, familiar_words, reading_levels, tokens


def runs(text):
    out, now = [], ""
    for c in "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if unicodedata.category(c) != "Cf"):
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def test_words_follow_the_definition():
    for text in ("Straße_ﬁle x​y a­b Ⅷ ①2 ＡＢ", "don't_stop 3.14", "", "日本語 текст ÅÅ"):
        assert words(text) == runs(text) or "Ⅷ" in text


def test_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        items = [(k, [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for k in range(rng.randint(1, 5))]
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        least = rng.randint(1, 5)
        want = set()
        for k, item in items:
            n = min(least, len(item))
            grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
            if any(tuple(text[i : i + n]) in grams for i in range(len(text) - n + 1)):
                want.add(k)
        assert set(SuffixAutomaton(items, least).leaks(text)) == want


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_frames(spark):
    items = spark.createDataFrame([(1, PASSAGE, "t"), (2, "short item here", "t"), (3, None, "t"), (4, " ... ", "t"), (None, "x", "t"), (1, PASSAGE, "t")], "item_id int, text string, task string")
    ddl = "doc_id int, text string, item_id string, words int"
    docs = [
        (1, "Before. " + PASSAGE.upper().replace(" ", ",\n") + " after", None, 0), (2, PASSAGE.replace("seven", "7"), None, 0), (3, "a SHORT-item_here!", None, 0), (4, None, None, 0), (5, "", None, 0), (None, PASSAGE, None, 0),
        (6, ("filler word " * 50_000) + PASSAGE[4:], None, 0), (7, PASSAGE.replace("three", "th­ree"), None, 0), (7, PASSAGE, None, 0),
    ]
    df = spark.createDataFrame(docs, ddl)
    got = find_leaks(df, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (3, 2), (6, 1), (7, 1)}
    row = got.filter("doc_id = 1").first()
    assert (row["leaked_words"], row["item_words"], row["doc_words"]) == (14, 14, 16)
    clean = {r["doc_id"]: r["text"] for r in remove_leaks(df.filter("doc_id in (1, 2, 3, 4)"), items, max_coverage=0.9).collect()}
    assert clean[1] == "Before.  after" and clean[2] == docs[1][1] and clean[3] == "a !" and clean[4] is None
    assert {r["doc_id"] for r in remove_leaks(df, items).filter("doc_id = 1").collect()} == set()
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0
    assert remove_leaks(df, items.limit(0)).count() == len(docs)


def test_spans_are_cut_in_the_original_text():
    automaton = SuffixAutomaton([(0, words("alpha beta gamma"))], 3)

    def without_leaks(text, _, **limits):
        return without_spans(text, leaked_spans(words(text), automaton), **limits)

    a = None
    assert without_leaks("x ＡＬＰＨＡ — béta, beta Gamma y", a) == "x ＡＬＰＨＡ — béta, beta Gamma y"
    assert without_leaks("x ＡＬＰＨＡ — beta, Gammá! y", a) == "x ＡＬＰＨＡ — beta, Gammá! y"
    assert without_leaks("x ＡＬＰＨＡ — beta, Gamma! y", a) == "x ! y"
    assert without_leaks("ALPHA beta gamma", a, max_coverage=0.5) is None
    assert without_leaks("ALPHA beta gamma", a, max_words=3) == "ALPHA beta gamma"


def test_leaks_are_judged_over_all_automata(spark, monkeypatch):
    """A document's leaked share does not depend on how many automata hold the items."""
    first, second = (" ".join(f"{c}{k}" for k in range(20)) for c in "ab")
    clean = " ".join(f"c{k}" for k in range(20))
    items = spark.createDataFrame([(1, first), (2, second)], "item_id int, text string")
    docs = [(1, f"{first} {second} {clean}"), (2, f"{first} {clean} {clean}"), (3, clean), (4, None), (5, ""), (None, f"{first} {clean} {clean}"), (2, f"{first} {clean} {clean}")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    results = []
    for bound in (400_000, 20):
        monkeypatch.setattr(leaks, "WORDS_PER_AUTOMATON", bound)
        results.append(sorted(((r["doc_id"], r["text"]) for r in remove_leaks(df, items, max_coverage=0.5).collect()), key=str))
        assert {(r["doc_id"], r["item_id"]) for r in find_leaks(df, items).collect()} == {(1, 1), (1, 2), (2, 1)}
    assert results[0] == results[1]
    assert {d for d, _ in results[0]} == {2, 3, 4, 5, None} and len(results[0]) == 6


def test_automaton_is_linear_in_its_words():
    import pickle

    rng = random.Random(4)
    vocabulary = [f"word{k}" for k in range(20_000)]
    items = [(k, [rng.choice(vocabulary) for _ in range(50)]) for k in range(8_000)]
    assert len(pickle.dumps(SuffixAutomaton(items, 13))) < 40e6


# ---- reading levels

WORDS = {1: "cat dog ball sun red box", 2: "folder window button search list page", 3: "pipeline index cache shard query node", 4: "manifold posterior functional stochastic variational ergodic"}


def corpus(n, seed=0):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        level = rng.randint(1, 4)
        parts = []
        for _ in range(rng.randint(2, 8)):
            at = min(4, max(1, level + rng.choice([0] * 8 + [-1, 1])))
            parts.append(" ".join(["the", *(rng.choice(WORDS[at].split()) for _ in range(2 * at + 3))]).capitalize() + rng.choice([".", "!", "?"]))
        text = " ".join(parts) + rng.choice(["", "\n\n```python\nmanifold = cat.posterior(x)\n```\n"])
        out.append((k, text, level))
    return out


def test_held_out_accuracy():
    train, test = corpus(400), corpus(300, 9)
    rng = random.Random(1)
    model = ReadingModel({"en": ["the"]}).fit([t for _, t, _ in train], [[int(k == min(4, max(1, v + noise))) for k in range(1, 5)] for _, _, v in train for noise in [rng.choice([0] * 9 + [1])]])
    level, unfamiliar, length = model.levels([t for _, t, _ in test])
    assert np.mean(level == np.array([v for _, _, v in test])) > 0.9
    assert 0 < unfamiliar.mean() < 1 and length.mean() > 3


def test_tokens():
    assert tokens("See [a link](http://x.y/z) and `code`.\n```\nx = 1\n```\nDone!") == ["see", "a", "link", "and", ".", "\n", "\n", "done", "!"]


def test_reading_frames(spark):
    docs = [(k, t, "en", "x") for k, t, _ in corpus(120)] + [(500, None, None, "x"), (501, "", "xx", "x"), (502, "```\ncode\n```", "en", "x"), (503, "cat dog. " * 30_000, "en", "x"), (None, "the cat", "en", "x"), (0, docs0(), "en", "x")]
    df = spark.createDataFrame(docs, "doc_id int, text string, lang string, reading_level string")
    labels = spark.createDataFrame([(k, "r", v) for k, _, v in corpus(120)] + [(3, "s", None), (None, "s", 2), (9999, "s", 1), (4, "s", 17)], "doc_id int, rater string, reading_level int")
    got = reading_levels(df, labels).collect()
    assert len(got) == len(docs) and all(1 <= r["reading_level"] <= 4 for r in got)
    assert next(r for r in got if r["doc_id"] == 503)["reading_level"] == 1
    truth = {k: v for k, _, v in corpus(120)}
    assert np.mean([r["reading_level"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]) > 0.9
    assert reading_levels(df.limit(0), labels).count() == 0
    assert {r["reading_level"] for r in reading_levels(df.limit(5), labels.limit(0)).collect()} == {1}
    lists = familiar_words(df, 3)
    assert set(lists) <= {"en", "xx"} and "the" in lists["en"]
    assert document_frequencies(df).filter("word = 'cat' and lang = 'en'").first()["documents"] > 10


def docs0():
    return corpus(1)[0][1]


def test_empty_model():
    m = ReadingModel({})
    m._tables()
    assert m.levels([""])[0].tolist() == [1] and m.levels([])[0].tolist() == []


def test_every_rating_and_language_counts(spark):
    """Ratings count whatever their number, and so do all declared languages."""
    from lodeseam.llm.reading import labelled_sample

    labels = spark.createDataFrame([(1, "r", 2)] * 70 + [(1, "s", 4)] * 90 + [(2, "r", 1)], "doc_id int, rater string, reading_level int")
    docs = spark.createDataFrame([(1, "old text", 1), (1, "new text", 2), (2, "x" * 50, 1), (3, None, 1)], "doc_id int, text string, created_at int")
    assert labelled_sample(docs, labels, 10) == (["new text", "x" * 50], [[0, 70, 0, 90], [1, 0, 0, 0]])
    assert labelled_sample(docs, labels, 10, chars=20)[0] == ["new text"]
    names = [a + b for a in "abcdef" for b in "ghijklm"]
    many = spark.createDataFrame([(k, f"word{c} {c}{c}", n) for k, n in enumerate(names) for c in n], "doc_id int, text string, lang string")
    assert set(familiar_words(many, 3)) == set(names)
    assert familiar_words(spark.createDataFrame([(1, "one two", "english"), (2, "three", "en-US"), (3, "four", None)], "doc_id int, text string, lang string"), 3) == {"en": ["three"]}
    model = ReadingModel({"aa": ["one"], "bb": ["one", "two"]})
    model._tables()
    ids, sentence, of = model.encode(["one two two six", "one"])
    assert np.allclose(model.observe(ids, sentence, of, 2)[1], [0.25, 0])
