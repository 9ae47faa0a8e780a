"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: each row holds one block of documents with, for every term that a test item uses,
the sorted positions at which it occurs in the block (postings of terms that no item uses can't take part in a match).
A phrase is searched in a block by taking the postings of its rarest term there, shifting them to phrase starts, and
intersecting them with the shifted postings of its other terms, the rarest next. A phrase's terms all lie in one block,
so a search moves no postings. Items are sent out in blocks of bounded size, each against the whole index.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import ALNUM, LOWER, content_id, materialise, pieces, string_parts, text_of, word_bounds, word_hashes

WINDOW = 10
#: Words of test items that are sent to the tasks at once (8 bytes each, and as much again for windows).
BLOCK_WORDS = 2_000_000
_BLOCK_BYTES = 2 << 20

INDEX = T.StructType([
    T.StructField("rows", T.ArrayType(T.LongType())),
    T.StructField("texts", T.ArrayType(T.LongType())),
    T.StructField("firsts", T.ArrayType(T.LongType())),
    T.StructField("terms", T.ArrayType(T.LongType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
    T.StructField("postings", T.BinaryType()),
])


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    buf, offs = string_parts(column)
    buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, offs, ALNUM)
    words = word_hashes(buf, starts, ends)
    for k in range(len(offs) - 1):
        yield words[first[k] : first[k + 1]]


class Items:
    """Test items as arrays: the distinct windows, the terms in them, and which items a window belongs to."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        owners: dict[bytes, set[str]] = defaultdict(set)
        for name, words in items:
            n = len(words)
            for s in range(max(1, n - window + 1) if n else 0):
                owners[words[s : s + window].tobytes()].add(name)
        self.windows = [np.frombuffer(w, np.uint64) for w in owners]
        self.owners = [sorted(x) for x in owners.values()]
        self.terms = np.unique(np.concatenate(self.windows)) if self.windows else np.zeros(0, np.uint64)
        self.codes = [np.searchsorted(self.terms, w) for w in self.windows]
        #: the codes of each window, the first one again where it has fewer words
        self.table = np.zeros((len(self.codes), window), np.int32)
        for row, codes in zip(self.table, self.codes, strict=True):
            row[:] = codes[0]
            row[: len(codes)] = codes

    def within(self, terms: np.ndarray) -> np.ndarray:
        """The windows all of whose terms are among these."""
        have = np.zeros(len(self.terms) + 1, bool)
        have[terms] = True
        return np.flatnonzero(have[self.table].all(1))


def item_blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> Iterator[Items]:
    """The items, read row by row on the driver, in blocks of bounded size."""
    held, size = [], 0
    body = text_of(text)
    for r in items.select(F.col("item_id").cast("string").alias("i"), body.alias("t")).where("i is not null").toLocalIterator():
        words = next(_words(pa.array([r.t])))
        if len(words):
            held.append((r.i, words))
            size += len(words)
        if size >= block_words:
            yield Items(held, window)
            held, size = [], 0
    if held:
        yield Items(held, window)


def build_index(docs: DataFrame, terms: np.ndarray, text: str = "text") -> DataFrame:
    """The positional index of `terms` (sorted word hashes) over docs: rows of INDEX.

    rows and texts are the numbers and text ids of the block's documents; firsts their first positions, and the end;
    terms, counts and postings list the postings of each term that occurs, as 32-bit positions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tids = b.column(0).to_pylist(), b.column(1).to_pylist()
            buf, offs = string_parts(b.column(2))
            out: list[list] = [[] for _ in _TYPES]
            for i, j in pieces(offs, _BLOCK_BYTES):
                part = LOWER[buf[offs[i] : offs[j]]]
                starts, ends, first = word_bounds(part, offs[i : j + 1] - offs[i], ALNUM)
                words = word_hashes(part, starts, ends)
                at = np.searchsorted(terms, words)
                at[at == len(terms)] = 0
                known = np.flatnonzero(terms[at] == words) if len(terms) else np.zeros(0, np.int64)
                code = at[known].astype(np.int32)
                order = np.argsort(code, kind="stable")
                found, counts = np.unique(code, return_counts=True)
                for col, x in zip(out, (ids[i:j], tids[i:j], first.tolist(), found.tolist(), counts.tolist(), known[order].astype("<u4").tobytes()), strict=True):
                    col.append(x)
                if len(out[0]) >= 8:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES, strict=True)], names=INDEX.names)
                    out = [[] for _ in _TYPES]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _TYPES, strict=True)], names=INDEX.names)

    body = text_of(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_id(body).alias("tid"), body.alias("t")).mapInArrow(run, INDEX)


_TYPES = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]


class Block:
    """One row of the index."""

    def __init__(self, firsts: np.ndarray, terms: np.ndarray, counts: np.ndarray, postings: bytes):
        self.firsts, self.terms = firsts, terms
        self.ends = np.cumsum(counts)
        self.flat = np.frombuffer(postings, "<u4").astype(np.int64)

    def postings(self, code: int) -> np.ndarray:
        k = np.searchsorted(self.terms, code)
        if k == len(self.terms) or self.terms[k] != code:
            return self.flat[:0]
        return self.flat[(self.ends[k - 1] if k else 0) : self.ends[k]]

    def phrase(self, codes: np.ndarray, lists: dict[int, np.ndarray]) -> np.ndarray:
        """Positions at which the phrase starts, inside one document."""
        order = sorted(range(len(codes)), key=lambda k: len(lists[codes[k]]))
        starts = lists[codes[order[0]]] - order[0]
        for k in order[1:]:
            if not len(starts):
                return starts
            have = lists[codes[k]] - k
            at = np.searchsorted(have, starts)
            at[at == len(have)] = 0
            starts = starts[have[at] == starts]
        if len(starts):
            doc = np.searchsorted(self.firsts, starts, side="right") - 1
            starts = starts[(starts >= 0) & (starts + len(codes) <= self.firsts[doc + 1])]
        return starts

    def near(self, codes: np.ndarray, lists: dict[int, np.ndarray], slop: int) -> list[tuple[int, int]]:
        """Stretches (first, end) of len(codes) + slop words at most, in one document, that hold every term of the phrase
        as often as it does; one for each posting of the rarest term that has one, the earliest."""
        want, times = np.unique(codes, return_counts=True)
        rare = min(want.tolist(), key=lambda c: len(lists[c]))
        most, out = len(codes) + slop, []
        for p in lists[rare].tolist():
            doc = int(np.searchsorted(self.firsts, p, side="right")) - 1
            lo, hi = max(int(self.firsts[doc]), p - most + 1), min(int(self.firsts[doc + 1]), p + most)
            for s in range(lo, min(p, hi - len(codes)) + 1):
                e = min(hi, s + most)
                if all(np.searchsorted(lists[c], e) - np.searchsorted(lists[c], s) >= m for c, m in zip(want.tolist(), times.tolist(), strict=True)):
                    out.append((s, e))
                    break
        return out


def _search(batches: Iterator[pa.RecordBatch], items: Items, slop: int | None) -> Iterator[pa.RecordBatch]:
    """For each document of the index: its number, words, hit ranges (in words of the document) and matched items."""
    for b in batches:
        for k in range(b.num_rows):
            ids = b.column(0)[k].values.to_pylist()
            tids = b.column(1)[k].values
            firsts, terms, counts = (b.column(c)[k].values.to_numpy() for c in (2, 3, 4))
            block = Block(firsts, terms, counts, b.column(5)[k].as_py())
            spans: dict[int, list[int]] = defaultdict(list)
            names: dict[int, set[str]] = defaultdict(set)
            lists = {int(c): block.postings(c) for c in terms.tolist()}
            for w in items.within(terms).tolist():
                codes, owners = items.codes[w].tolist(), items.owners[w]
                if slop is None:
                    places = [(s, s + len(codes)) for s in block.phrase(codes, lists).tolist()]
                else:
                    places = block.near(np.array(codes), lists, slop)
                for s, e in places:
                    doc = int(np.searchsorted(firsts, s, side="right")) - 1
                    spans[doc] += [s - int(firsts[doc]), e - int(firsts[doc])]
                    names[doc].update(owners)
            size = np.diff(firsts)
            docs = range(len(ids))
            yield pa.record_batch([pa.array(ids, pa.int64()), tids, pa.array(size, pa.int64()), pa.array([spans.get(d, []) for d in docs], pa.list_(pa.int64())), pa.array([sorted(names.get(d, ())) for d in docs], pa.list_(pa.string()))], names=["doc_id", "tid", "n_words", "spans", "items"])


_FOUND = "doc_id long, tid long, n_words long, spans array<bigint>, items array<string>"


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, tid, n_words, spans, items), one row for each row of docs: the word ranges that match, and the items they match.

    slop None: exact phrases of `window` words (an item of fewer words is one phrase). Else: stretches of at most
    window + slop words that hold all terms of a window in any order. Words are runs of digits, letters and bytes above
    127, A-Z lower-cased. Null texts have no words; items without words or with a null id match nothing. Repeated rows
    stay; very long texts are a block of their own, searched whole; other columns are ignored, whatever their names; empty
    tables give empty results (no items: no match).
    """
    spark = docs.sparkSession
    found = []
    for block in item_blocks(items, window, block_words, text):
        index = materialise(build_index(docs, block.terms, text), "index")
        sent = spark.sparkContext.broadcast(block)
        found.append(index.mapInArrow(lambda batches, sent=sent: _search(batches, sent.value, slop), _FOUND))
    if not found:
        none = Items([], window)
        return build_index(docs, none.terms, text).mapInArrow(lambda batches: _search(batches, none, slop), _FOUND)
    if len(found) == 1:
        return found[0]
    # What the later blocks of items found in a text is added to each row that has the text.
    each = found[0]
    for more in found[1:]:
        each = each.unionAll(more)
    each = each.where("size(spans) > 0").select("tid", "spans", "items").distinct()
    each = each.groupBy("tid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = found[0].select("doc_id", "tid", "n_words").join(each, "tid", "left")
    empty = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    return rows.select("doc_id", "tid", "n_words", F.coalesce("spans", empty[0]).alias("spans"), F.coalesce("items", empty[1]).alias("items"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits, items, sha = [], [], []
        for s, names in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            n = end = 0
            for lo, hi in sorted(zip(s[::2], s[1::2], strict=True)):
                n += max(0, hi - max(lo, end))
                end = max(end, hi)
            hits.append(n)
            items.append(len(names))
            sha.append(hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
        yield pa.record_batch([b.column(0), b.column(1), pa.array(hits, pa.int64()), pa.array(items, pa.int64()), pa.array(sha, pa.string()), pa.array([n > 0 for n in hits], pa.bool_()), b.column(4)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text_id"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_id for each row of docs; cases as in find_passages."""
    found = find_passages(docs, items, window, None, text, block_words).select("doc_id", "n_words", "spans", "items", "tid")
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, text_id long")
