"""Evaluation texts leaking into training text (problem 7)."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_WORDS = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[" + "".join(f"\\U{c:08x}" for c in [*range(0x80, 0x3000), *range(0xFE00, 0x10000), *range(0x11000, 0x1D200), *range(0xE0000, 0xE0080)] if unicodedata.category(chr(c)) == "Cf") + "]")


def normalised(text: str) -> str:
    """NFKC, case folding and removal of invisible format characters."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _FORMAT.sub("", text.casefold())


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the normalised text."""
    return _WORDS.findall(normalised(text))


class SuffixAutomaton:
    """A generalised suffix automaton over the word sequences of all items.

    Every end of a sequence keeps its item once. The ends below a state of the suffix-link tree lie side by side in one
    list, so the items that hold a state's words are a range of it, and memory is linear in the words of the items.
    """

    def __init__(self, items: list[tuple[object, list[str]]], least: int):
        self.ids = [i for i, _ in items]
        self.sizes = [len(sequence) for _, sequence in items]
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: state -> short items that end there as a whole; state -> the nearest state on its links that has any
        self.short: dict[int, list[int]] = {}
        self.short_up: dict[int, int] = {}
        at: list[int] = []
        who: list[int] = []
        for k, (_, sequence) in enumerate(items):
            last = 0
            for w in sequence:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                at.append(last)
                who.append(k)
            if 0 < len(sequence) < least:
                self.short.setdefault(last, []).append(k)
        self._order_ends(at, who)

    def _order_ends(self, at: list[int], who: list[int]) -> None:
        n = len(self.next)
        own = [0] * n
        for v in at:
            own[v] += 1
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        total = own[:]
        for v in reversed(by_length):
            total[self.link[v]] += total[v]
        first, cursor = [0] * n, [own[0]] + [0] * (n - 1)
        for v in by_length:
            up = self.link[v]
            first[v] = cursor[up]
            cursor[up] += total[v]
            cursor[v] = first[v] + own[v]
            if self.short:
                nearest = up if up in self.short else self.short_up.get(up)
                if nearest is not None:
                    self.short_up[v] = nearest
        ends = array("l", [0]) * len(at)
        place = first[:]
        for v, k in zip(at, who):
            ends[place[v]] = k
            place[v] += 1
        self.ends, self.first, self.total = ends, array("l", first), array("l", total)
        self.link, self.length = array("l", self.link), array("l", self.length)

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        new = self._state({}, self.length[last] + 1, -1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def holders(self, state: int) -> set[int]:
        """The items that hold the words of a state."""
        start = self.first[state]
        return set(self.ends[start : start + self.total[state]])

    def matches(self, sequence: list[str]) -> Iterator[tuple[int, int, set[int] | list[int]]]:
        """(end, words, items) where a long enough match ends: the longest match there and the items that hold its last ``least`` words or are short and end there whole."""
        following, link, length, short, least = self.next, self.link, self.length, self.short, self.least
        v = matched = 0
        for at, w in enumerate(map(self.vocabulary.get, sequence)):
            if w is None:
                v = matched = 0
                continue
            while True:
                to = following[v].get(w)
                if to is not None:
                    v = to
                    matched += 1
                    break
                if v == 0:
                    matched = 0
                    break
                v = link[v]
                matched = length[v]
            if matched >= least:
                u = v
                while length[link[u]] >= least:
                    u = link[u]
                yield at + 1, matched, self.holders(u)
            if short:
                u = v if v in short else self.short_up.get(v)
                while u is not None:
                    n = self.sizes[short[u][0]]
                    if n <= matched:
                        yield at + 1, n, short[u]
                    u = self.short_up.get(u)

    def leaks(self, sequence: list[str]) -> dict[int, list[list[int]]]:
        """Item number -> merged [start, end) word spans of the sequence that hold its passages."""
        found: dict[int, list[list[int]]] = {}
        for end, n, items in self.matches(sequence):
            start = end - min(n, self.least)
            for k in items:
                spans = found.setdefault(k, [])
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
        return found


#: Words of evaluation texts that one automaton holds at most; larger sets are worked off in several passes.
WORDS_PER_AUTOMATON = 400_000


def _automata(items: DataFrame, least: int) -> Iterator[SuffixAutomaton]:
    """Automata over blocks of the items, none with more than WORDS_PER_AUTOMATON words (or one item)."""
    block: list[tuple[object, list[str]]] = []
    size = 0
    for row in items.filter("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        sequence = words(row["text"])
        if block and size + len(sequence) > WORDS_PER_AUTOMATON:
            yield SuffixAutomaton(block, least)
            block, size = [], 0
        block.append((row["item_id"], sequence))
        size += len(sequence)
    if block:
        yield SuffixAutomaton(block, least)


def find_leaks(documents: DataFrame, items: DataFrame, least: int = 13) -> DataFrame:
    """(doc_id, item_id, leaked_words, longest, item_words, doc_words): the items of which each document holds passages.

    A passage is ``least`` consecutive words of an item, or the whole item if it has fewer. leaked_words counts the
    document's words in such passages, longest is the longest of them. The items are broadcast as suffix automata of
    bounded size, one pass over the documents for each; documents are read once per pass and never shuffled. Null
    texts and ids hold nothing; items without words match nothing; repeated rows give repeated results only where
    their texts differ. Empty tables give no rows.
    """
    kinds = dict(documents.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, leaked_words int, longest int, item_words int, doc_words int"
    spark = documents.sparkSession
    source = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    found = None
    for automaton in _automata(items, least):
        part = source.mapInArrow(_finder(spark.sparkContext.broadcast(automaton), to_arrow_schema(StructType.fromDDL(schema))), schema)
        found = part if found is None else found.unionByName(part)
    return found.distinct() if found is not None else spark.createDataFrame([], schema)


def _finder(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: SuffixAutomaton = shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sequence = words(text)
                for k, spans in automaton.leaks(sequence).items():
                    out.append((doc, automaton.ids[k], sum(b - a for a, b in spans), max(b - a for a, b in spans), automaton.sizes[k], len(sequence)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


_SEGMENT = re.compile(r".[̀-゙゚ͯﾞﾟ]*", re.S)


def leaked_spans(sequence: list[str], automaton: SuffixAutomaton) -> list[list[int]]:
    """Merged [start, end) word spans that hold passages of any item."""
    return _merged(s for spans in automaton.leaks(sequence).values() for s in spans)


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without_spans(text: str, spans: list[list[int]], max_words: int = 0, max_coverage: float = 1.0) -> str | None:
    """The text without its word spans of more than ``max_words`` words; None where these cover more than ``max_coverage`` of its words.

    None as well where the words cannot be told apart in the text as it stands.
    """
    spans = [s for s in _merged(spans) if s[1] - s[0] > max_words]
    if not spans:
        return text
    normal, origin = [], []
    for m in _SEGMENT.finditer(text):
        piece = normalised(m.group())
        normal.append(piece)
        origin.extend([m.start()] * len(piece))
    origin.append(len(text))
    found = list(_WORDS.finditer("".join(normal)))
    if spans[-1][1] > len(found) or sum(b - a for a, b in spans) > max_coverage * len(found):
        return None
    out, pos = [], 0
    for a, b in spans:
        out.append(text[pos : origin[found[a].start()]])
        last = origin[found[b - 1].end() - 1]
        pos = _SEGMENT.match(text, last).end()
    out.append(text[pos:])
    return "".join(out)


def remove_leaks(documents: DataFrame, items: DataFrame, least: int = 13, max_words: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """(doc_id, text): the documents without passages of the items; a document of which more than ``max_coverage`` leaked is dropped.

    The leaked spans of all items are put together before a document is judged, whatever the number of automata: with
    one automaton in a single pass that moves nothing, with several from a table of the spans of the texts that leak.
    Null texts stay null; empty texts stay. Empty items change nothing.
    """
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text string"
    spark = documents.sparkSession
    shared = [spark.sparkContext.broadcast(a) for a in _automata(items, least)]
    rows = documents.select("doc_id", "text")
    if not shared:
        return rows
    if len(shared) == 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text is not None:
                        text = without_spans(text, leaked_spans(words(text), shared[0].value), max_words, max_coverage)
                        if text is None:
                            continue
                    kept.append((doc, text))
                if kept:
                    yield _pairs(kept, batch.column(0).type)

        return rows.mapInArrow(run, schema)

    def spans_of(one):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(digest, spans) for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (spans := leaked_spans(words(text), one.value))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], type=pa.string()), pa.array([x for _, x in out], type=pa.list_(pa.list_(pa.int32())))], names=["digest", "spans"])

        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if text is not None and spans:
                    text = without_spans(text, spans, max_words, max_coverage)
                    if text is None:
                        continue
                kept.append((doc, text))
            if kept:
                yield _pairs(kept, batch.column(0).type)

    keyed = rows.withColumn("digest", F.sha2("text", 256))
    texts = keyed.filter("text is not null").select("digest", "text")
    found = [texts.mapInArrow(spans_of(one), "digest string, spans array<array<int>>") for one in shared]
    spans = found[0]
    for part in found[1:]:
        spans = spans.unionByName(part)
    # copies of a text have the same spans; each automaton's count once
    spans = spans.groupBy("digest").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return keyed.join(spans, "digest", "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)


def _pairs(kept: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], type=kind), pa.array([k[1] for k in kept], type=pa.string())], names=["doc_id", "text"])
