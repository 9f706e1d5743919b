"""Filling fixed-capacity containers with documents (problem 6)."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Splits text before byte pairs are merged, as the 50k byte-level vocabularies expect it.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tiktoken encoding of a rank file; kept per process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        _encoders[vocabulary] = tiktoken.Encoding("lodeseam", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def count_tokens(text: str, encoding) -> int:
    """Tokens of a text. Long texts are counted in parts, cut only where the vocabulary's pattern breaks, so the sum is the text's own count."""
    if len(text) < 20_000:
        return len(encoding.encode_ordinary(text))
    return sum(len(encoding._encode_single_piece(part.encode("utf-8", "replace"))) if alone else len(encoding.encode_ordinary(part)) for part, alone in _parts(text))


_breaks = regex.compile(BYTE_LEVEL_PATTERN).finditer


def _parts(text: str, size: int = 16_000) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one piece of the pattern): parts that begin and end where the pattern breaks.

    The pattern looks at nothing before a piece and at one character behind white space only, which is white space in
    both readings, so a part breaks as it does within the text. A piece of ``size`` characters stands alone: the
    encoding's own splitting fails on very long ones.
    """
    begun = 0
    for m in _breaks(text):
        long = m.end() - m.start() >= size
        if long and m.start() > begun:
            yield text[begun : m.start()], False
            begun = m.start()
        if m.end() - begun >= size:
            yield text[begun : m.end()], long
            begun = m.end()
    if begun < len(text):
        yield text[begun:], False


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, tokens, source, copies, created_at) per row: the size in tokens and a hash that equal texts share.

    Texts count as equal when they agree but for white space and case. A null text has no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            sizes = [count_tokens(t, encoding) for t in texts]
            same = [int.from_bytes(hashlib.blake2b(" ".join(t.lower().split()).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, type=pa.int64()), batch.column(1), pa.array(same, type=pa.int64()), batch.column(2)],
                names=["doc_id", "tokens", "source", "copies", "created_at"],
            )

    kinds = dict(documents.select("doc_id", "source", "created_at").dtypes)
    schema = f"doc_id {kinds['doc_id']}, tokens bigint, source {kinds['source']}, copies bigint, created_at {kinds['created_at']}"
    return documents.select("doc_id", "source", "created_at", "text").mapInArrow(run, schema)


class Bins:
    """Open containers ordered by residual space.

    A bitmap has a bit for each residual that some container has, so the tightest container for an item is the next set
    bit; every container carries bitmaps of the sources and of the groups of copies in it, and the search goes on to
    the next residual until one is compatible.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals = 0
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.place: list[int] = []
        self.left: list[int] = []
        self.sources: list[int] = []
        self.copies: list[int] = []

    def _open(self, container: int, left: int) -> None:
        self.place[container] = len(self.by_residual[left])
        self.by_residual[left].append(container)
        self.residuals |= 1 << left

    def _close(self, container: int) -> None:
        left = self.left[container]
        same = self.by_residual[left]
        last = same.pop()
        if last != container:
            same[self.place[container]] = last
            self.place[last] = self.place[container]
        if not same:
            self.residuals &= ~(1 << left)

    def find(self, size: int, source: int, copies: int) -> int | None:
        """The tightest container that holds neither a copy of the item nor a document of its source."""
        rest = self.residuals >> size << size
        while rest:
            residual = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            for container in self.by_residual[residual]:
                if not (self.copies[container] & copies or self.sources[container] & source):
                    return container
        return None

    def put(self, container: int | None, size: int, source: int, copies: int) -> int:
        if container is None:
            container = len(self.left)
            self.left.append(self.capacity)
            self.place.append(0)
            self.sources.append(0)
            self.copies.append(0)
        else:
            self._close(container)
        self.left[container] -= size
        self.sources[container] |= source
        self.copies[container] |= copies
        if self.left[container]:
            self._open(container, self.left[container])
        return container


def pack(items: list[tuple], capacity: int) -> list[tuple[int, object, int, int]]:
    """(container, doc_id, token_start, token_end) of best-fit decreasing over (doc_id, tokens, source, copies) rows.

    An item larger than a container fills containers of its own and its rest is packed like any other. Copies of one
    text and documents of one source keep apart as long as that opens no further container in the end: what lies in
    containers less than half full is placed again, into the tightest compatible container and without that rule where
    there is none. Items without tokens take no space and go to the first container.
    """
    out: list[tuple[int, object, int, int]] = []
    bins = Bins(capacity)
    full = 0
    pieces: list[tuple[int, object, int, int, int]] = []
    repeated = {c for c, n in Counter(r[3] for r in items).items() if n > 1}
    marks: dict[object, int] = {}
    source_marks: dict[object, int] = {}
    whole: list[tuple[object, int, int]] = []
    empty: list[object] = []
    for doc, size, source, copies in items:
        start = 0
        while size - start >= capacity:
            whole.append((doc, start, start + capacity))
            start += capacity
        group = 1 << marks.setdefault(copies, len(marks)) if copies in repeated else 0
        owner = 1 << source_marks.setdefault(source, len(source_marks)) if source is not None else 0
        if size > start:
            pieces.append((size - start, doc, start, owner, group))
        elif size == 0:
            empty.append(doc)
    pieces.sort(key=lambda p: -p[0])
    placed: list[list[tuple[int, object, int, int, int]]] = []
    for p in pieces:
        c = bins.put(bins.find(p[0], p[3], p[4]), p[0], p[3], p[4])
        if c == len(placed):
            placed.append([])
        placed[c].append(p)
    loose = [c for c in range(len(placed)) if bins.left[c] > capacity // 2]
    if len(loose) > 1:
        again = sorted((p for c in loose for p in placed[c]), key=lambda p: -p[0])
        for c in loose:
            bins._close(c)
            placed[c] = []
            bins.left[c] = capacity
        spare = iter(loose)
        for p in again:
            c = bins.find(p[0], p[3], p[4])
            c = bins.find(p[0], 0, p[4]) if c is None else c
            c = bins.find(p[0], 0, 0) if c is None else c
            if c is None:
                c = next(spare)
                bins.sources[c] = bins.copies[c] = 0
                bins._open(c, capacity)
            bins.put(c, p[0], p[3], p[4])
            placed[c].append(p)
    number = 0
    for content in placed:
        if content:
            out.extend((number, doc, start, start + size) for size, doc, start, _, _ in content)
            number += 1
    for doc, start, end in whole:
        out.append((number, doc, start, end))
        number += 1
    out.extend((0, doc, 0, 0) for doc in empty)
    return out


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = 2048, per_task: int = 25_000) -> DataFrame:
    """(container, doc_id, token_start, token_end): every document placed in containers of ``capacity`` tokens.

    Documents are dealt to groups of about ``per_task`` by the hash of their id, whatever their source, and each group
    is packed by itself, so the work per document does not grow with the corpus and a group leaves about one container
    part-filled. Only ids, sizes, sources and hashes are shuffled. Repeated doc_ids count once (the latest row); rows
    without doc_id count as one document; null and empty texts get a row with an empty range. An empty table gives
    no rows. Further columns are left out.
    """
    groups = max(1, round(documents.count() / per_task))
    rows = (
        token_counts(documents, vocabulary)
        .groupBy("doc_id")
        .agg(F.max(F.struct("created_at", "tokens", "copies", "source")).alias("row"))
        .select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("task"), "doc_id", "row.tokens", "row.source", "row.copies")
    )
    schema = f"container bigint, doc_id {dict(documents.dtypes)['doc_id']}, token_start bigint, token_end bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, items = None, []
        for batch in batches:
            for task, *item in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if task != current and items:
                    yield _rows(current, pack(items, capacity), arrow)
                    items = []
                current = task
                items.append(tuple(item))
        if items:
            yield _rows(current, pack(items, capacity), arrow)

    return rows.repartition("task").sortWithinPartitions("task", "doc_id").mapInArrow(run, schema)


def _rows(task: int, placed: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    number, *rest = zip(*placed)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip([[(task << 32) + n for n in number], *rest], schema)], schema=schema)
