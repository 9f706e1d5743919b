"""Reading level of each document (problem 8).

The familiar-word formula (share of words outside a list of the corpus' most frequent words, plus sentence length) gives
two observations per document.  Alone they do not separate four levels well enough over five languages (the README has
figures), so they are combined with a model of which words sentences of each level use, fitted on a bounded sample of
labelled documents: every sentence has a level near its document's, and raters err by one level now and then.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 4
#: What is no prose: fenced and inline code, addresses, tags, link targets, mark-up of tables and headings.
_NO_PROSE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|https?://\S+|\]\([^)\n]*\)|<[^>\n]{1,80}>|\([\w./]*[_/.][\w./]*\)", re.S)
_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;…。！？]+(?=\s|$)|\n")
_MIN_WORDS = 3


def tokens(text: str) -> list[str]:
    """Lower-cased words of the prose, with sentence ends and line ends between them."""
    return _TOKENS.findall(_NO_PROSE.sub(" ", text.replace("\r", "\n")).lower())


class ReadingModel:
    """Levels of sentences and documents from their words.

    vocabulary: word -> row of the tables; log_words[row, level]: log probability ratio of the word at a level;
    mixture[level, sentence level]; length: mean and deviation of log sentence length per sentence level; formula: mean
    and deviation of the unfamiliar share per document level; familiar_lists: the languages in whose list a word is.
    """

    def __init__(self, familiar: dict[str, list[str]]):
        self.vocabulary: dict[str, int] = {}
        self.lists = sorted(familiar)
        for name in self.lists:
            for w in familiar[name]:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.familiar_words = familiar
        self.prior = np.full(LEVELS, 1 / LEVELS)
        self.mixture = np.full((LEVELS, LEVELS), 0.05) + np.eye(LEVELS) * 0.8
        self.mixture /= self.mixture.sum(1, keepdims=True)
        self.log_words = np.zeros((1, LEVELS))
        self.length = np.array([[2.3, 0.6]] * LEVELS)
        self.formula = np.array([[0.5, 0.3]] * LEVELS)

    def encode(self, texts: list[str], grow: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word ids, number of each word's sentence, number of each sentence's document); id 0 is an unknown word."""
        known = self.vocabulary
        lines = [tokens(t) for t in texts]
        if grow:
            for line in lines:
                for w in line:
                    if w[0].isalpha():
                        known.setdefault(w, len(known) + 1)
        get = _Lookup(known).__getitem__
        ids = np.fromiter(map(get, chain.from_iterable(lines)), dtype=np.int32, count=sum(map(len, lines)))
        docs = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        word = ids >= 0
        change = np.ones(len(ids), dtype=bool)
        if len(ids):
            change[1:] = ~word[:-1] | (docs[1:] != docs[:-1])
        sentence = np.cumsum(change) - 1
        ids, sentence, docs = ids[word], sentence[word], docs[word]
        names, sentence = np.unique(sentence, return_inverse=True)
        of = np.zeros(len(names), dtype=np.int64)
        of[sentence] = docs
        return ids, sentence, of

    def observe(self, ids: np.ndarray, sentence: np.ndarray, of: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Words per sentence, and the unfamiliar share per document: outside the list that covers most of its words."""
        words = np.bincount(sentence, minlength=len(of))
        total = np.bincount(of, weights=words, minlength=n_docs)
        # every occurrence of a familiar word counts for each of the lists that hold it
        many = self.familiar_first[ids + 1] - self.familiar_first[ids]
        hit = np.repeat(np.arange(len(ids)), many)
        at = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.familiar_first[ids], many)
        lists = max(1, len(self.lists))
        held = np.bincount(of[sentence[hit]] * lists + self.familiar_lists[at], minlength=n_docs * lists).reshape(n_docs, lists)
        return words, 1 - held.max(axis=1) / np.maximum(total, 1)

    def _tables(self) -> None:
        """familiar_lists[familiar_first[w]:familiar_first[w + 1]] are the numbers of the lists that hold word w."""
        of_word: dict[int, list[int]] = {}
        for k, name in enumerate(self.lists):
            for w in self.familiar_words[name]:
                of_word.setdefault(self.vocabulary[w], []).append(k)
        many = np.zeros(len(self.vocabulary) + 2, dtype=np.int64)
        for w, lists in of_word.items():
            many[w + 1] = len(lists)
        self.familiar_first = np.cumsum(many)
        self.familiar_lists = np.array([k for w in sorted(of_word) for k in of_word[w]], dtype=np.int64)
        if len(self.log_words) != len(self.vocabulary) + 1:
            self.log_words = np.zeros((len(self.vocabulary) + 1, LEVELS))

    def _sentences(self, ids, sentence, words, of, n_docs) -> np.ndarray:
        """log p(words of the sentence | sentence level) against the average level.

        Fragments shorter than a sentence (titles, labels) say nothing, save in documents that have nothing else.
        """
        score = np.empty((len(words), LEVELS))
        for k in range(LEVELS):
            score[:, k] = np.bincount(sentence, weights=self.log_words[ids, k], minlength=len(words))
        z = (np.log(np.maximum(words, 1))[:, None] - self.length[:, 0]) / self.length[:, 1]
        short = words < _MIN_WORDS
        score += np.where(short[:, None], 0.0, -0.5 * z * z - np.log(self.length[:, 1]))
        score[short & (np.bincount(of, weights=~short, minlength=n_docs) > 0)[of]] = 0
        return score - score.max(axis=1, keepdims=True) if len(score) else score

    def documents(self, ids, sentence, of, n_docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log p(level, document) per document and level, sentence likelihoods, unfamiliar shares."""
        words, unfamiliar = self.observe(ids, sentence, of, n_docs)
        likely = np.exp(np.maximum(self._sentences(ids, sentence, words, of, n_docs), -12.0))
        under = np.log(likely @ self.mixture.T + 1e-12)  # sentence x document level
        out = np.tile(np.log(self.prior), (n_docs, 1))
        for k in range(LEVELS):
            out[:, k] += np.bincount(of, weights=under[:, k], minlength=n_docs)
        z = (unfamiliar[:, None] - self.formula[:, 0]) / self.formula[:, 1]
        formula = -0.5 * z * z - np.log(self.formula[:, 1])
        formula[np.bincount(of, weights=words, minlength=n_docs) < _MIN_WORDS] = 0
        return out + formula, likely, unfamiliar

    def fit(self, texts: list[str], ratings: list[list[int]], rounds: int = 6, error: float = 0.04) -> "ReadingModel":
        """Expectation-maximisation; ``ratings`` has the number of raters per level, ``error`` is the chance of a rater to be one level off, to each side."""
        ids, sentence, of = self.encode(texts, grow=True)
        self._tables()
        n = len(texts)
        noise = np.full((LEVELS, LEVELS), error / 10) + np.eye(LEVELS) * (1 - 2 * error) + (np.eye(LEVELS, k=1) + np.eye(LEVELS, k=-1)) * error
        rated = np.array(ratings, dtype=np.float64) @ np.log(noise).T
        level = np.exp(rated - rated.max(axis=1, keepdims=True))
        level /= level.sum(axis=1, keepdims=True)
        part = level[of]  # sentence levels start as their documents'
        size = len(self.vocabulary) + 1
        words, _ = self.observe(ids, sentence, of, n)
        for _ in range(rounds):
            useful = part * (words >= _MIN_WORDS)[:, None]
            count = np.stack([np.bincount(ids, weights=useful[sentence, k], minlength=size) for k in range(LEVELS)], axis=1)
            share = (count + 0.3) / (count + 0.3).sum(axis=0)
            self.log_words = np.log(share) - np.log(share).mean(axis=1, keepdims=True)
            self.log_words[0] = 0
            weight = useful.sum(axis=0) + 1e-9
            logs = np.log(np.maximum(words, 1))
            mean = useful.T @ logs / weight
            spread = np.sqrt(np.maximum((useful * (logs[:, None] - mean) ** 2).sum(axis=0) / weight, 0.04))
            self.length = np.stack([mean, spread], axis=1)
            scores, likely, unfamiliar = self.documents(ids, sentence, of, n)
            posterior = scores + rated
            posterior = np.exp(posterior - posterior.max(axis=1, keepdims=True))
            level = posterior / posterior.sum(axis=1, keepdims=True)
            self.prior = (level.sum(axis=0) + 1) / (n + LEVELS)
            weight = level.sum(axis=0) + 1e-9
            mean = level.T @ unfamiliar / weight
            spread = np.sqrt(np.maximum((level * (unfamiliar[:, None] - mean) ** 2).sum(axis=0) / weight, 0.01))
            self.formula = np.stack([mean, spread], axis=1)
            # sentence levels given the documents'
            joint = likely[:, None, :] * self.mixture[None, :, :]
            joint /= joint.sum(axis=2, keepdims=True) + 1e-12
            joint *= level[of][:, :, None]
            part = joint.sum(axis=1)
            moved = (joint * (words >= _MIN_WORDS)[:, None, None]).sum(axis=0) + 0.02 * len(words) / LEVELS * np.eye(LEVELS) + 0.5
            self.mixture = moved / moved.sum(axis=1, keepdims=True)
        return self

    def levels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(level, unfamiliar share, words per sentence) of each text."""
        ids, sentence, of = self.encode(texts)
        scores, _, unfamiliar = self.documents(ids, sentence, of, len(texts))
        n_words = np.bincount(of[sentence], minlength=len(texts)) if len(of) else np.zeros(len(texts))
        n_sentences = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts))
        return np.argmax(scores, axis=1) + 1, unfamiliar, n_words / np.maximum(n_sentences, 1)


class _Lookup(dict):
    """Word ids; sentence ends are -1 and unknown words 0, decided once per text."""

    def __missing__(self, word: str) -> int:
        got = 0 if word[0].isalpha() else -1
        if len(self) < 500_000:
            self[word] = got
        return got


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(lang, word, documents): in how many documents of each declared language a word occurs; counted per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(set(tokens(text)))
            if sum(map(len, counts.values())) > 300_000:
                yield flush(counts)
                counts = {}
        if counts:
            yield flush(counts)

    def flush(counts):
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if w[0].isalpha()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.string()), pa.array([r[1] for r in rows], type=pa.string()), pa.array([r[2] for r in rows], type=pa.int64())], names=["lang", "word", "documents"])

    return documents.select(_language().alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "lang string, word string, documents bigint").groupBy("lang", "word").agg(F.sum("documents").alias("documents"))


def _language():
    """The two-letter code that a declared language begins with, "" for anything else; 676 codes at most."""
    return F.lower(F.regexp_extract(F.coalesce("lang", F.lit("")), "^([A-Za-z]{2})(?![A-Za-z]{2})", 1))


def familiar_words(documents: DataFrame, size: int = 150) -> dict[str, list[str]]:
    """The ``size`` words found in most documents of each declared language; at most 676 times ``size`` words reach the driver."""
    frequencies = document_frequencies(documents).filter("lang <> ''")
    ranked = frequencies.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("documents"), "word"))).filter(F.col("rank") <= size)
    return {r["lang"]: sorted(r["words"]) for r in ranked.groupBy("lang").agg(F.collect_list("word").alias("words")).collect()}


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int, chars: int = 40_000) -> tuple[list[str], list[list[int]]]:
    """Texts and raters per level of at most ``rows`` labelled documents, picked by the hash of their id.

    Texts of more than ``chars`` characters are left out of the sample, which bounds what reaches the driver. Of several
    texts of one id the latest counts, of equal times the larger.
    """
    votes = [F.sum((F.col("reading_level") == k).cast("int")).alias(f"level_{k}") for k in range(1, LEVELS + 1)]
    rated = (
        labels.filter(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(*votes)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    times = ["created_at"] if "created_at" in documents.columns else []
    found = (
        documents.filter("text is not null")
        .select("doc_id", "text", *times)
        .join(F.broadcast(rated), "doc_id")
        .groupBy("doc_id", *rated.columns[1:])
        .agg(F.max(F.struct(*times, "text")).alias("row"))
        .filter(F.length("row.text") <= chars)
        .orderBy("doc_id")
        .select("row.text", *rated.columns[1:])
        .toArrow()
    )
    return found.column(0).to_pylist(), [list(r) for r in zip(*(found.column(k).to_pylist() for k in range(1, LEVELS + 1)))]


def fit_reading_model(documents: DataFrame, labels: DataFrame, sample_rows: int = 6000, familiar: int = 150) -> ReadingModel:
    """Familiar words from the document frequencies of the whole corpus, the rest from at most ``sample_rows`` labelled documents."""
    model = ReadingModel(familiar_words(documents, familiar))
    texts, ratings = labelled_sample(documents, labels, sample_rows)
    if not texts:
        model._tables()
        return model
    return model.fit(texts, ratings)


def reading_levels(documents: DataFrame, labels: DataFrame, sample_rows: int = 6000, familiar: int = 150) -> DataFrame:
    """(doc_id, reading_level, unfamiliar_share, words_per_sentence): one row per row of documents.

    The model (word tables of the sample's vocabulary and the familiar lists) is broadcast; its size depends on the
    sample's bound and not on the corpus. Documents are read whole, once for the frequencies and once for the levels,
    and never shuffled. Null and empty texts, and texts without prose, get the commonest level; without any labels
    every document gets level 1. doc_ids may be null or repeat; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit_reading_model(documents, labels, sample_rows, familiar))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                level, share, length = shared.value.levels([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(level.astype(np.int32)), pa.array(share.astype(np.float64)), pa.array(length.astype(np.float64))],
                    names=["doc_id", "reading_level", "unfamiliar_share", "words_per_sentence"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, reading_level int, unfamiliar_share double, words_per_sentence double")
