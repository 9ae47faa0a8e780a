"""LM scoring by cross-entropy difference: matched target and background n-gram models over one vocabulary.

The vocabulary is shared by both models: every word of either corpus, and one place for unknown ones. Both models are
bigram models of the same form, interpolated with a smoothed unigram one; the target model counts the words of good
labelled documents, the background model those of all documents. A document's score is its mean loss under the
background model less that under the target model, for each token: the higher, the more it is like the target.

Plan: (1) documents are packed into chunks of bounded size, which are written; (2) each chunk and each task over a
corpus counts its own n-grams, words, bigrams and whole texts alike, by ids, and deals the sorted ids out by slices of
the id space, of which there are as many as the input needs; (3) a slice adds up what all have counted and answers each
chunk in the order of its ids; (4) a chunk scores its documents with the counts of its own n-grams only. So the tables
grow with the corpus, are never whole in one place, and a common word is asked for once a chunk. Ids are hashes that are
SPARE bits wider than the corpus needs (62 bits at most), so about one n-gram in 2^SPARE shares its counts with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import _PLACES, NOT_SPACE, U, content_id, materialise, mix, pieces, string_parts, text_of, word_bounds, word_hashes

#: Weight of the bigram estimate in a model, and the count added to each word of the unigram one.
BIGRAM, ADDED = 0.6, 0.05
#: Bytes of text in a chunk, and bytes of all texts for each slice of the ids; there are at least LEAST_SLICES.
CHUNK, SLICE, LEAST_SLICES = 16 << 20, 32 << 20, 32
#: Bits of an id beyond those that number the tokens of the documents.
SPARE = 26
#: Ids of good documents that may be broadcast (8 bytes each); with more, documents are dealt out by id.
MOST_BROADCAST = 2_000_000
_PIECE = 2 << 20
#: The last two bits of an id say what it is of; the others are of a hash.
PAIR, WORD, TEXT = U(0), U(1), U(2)
_KIND = U(3)


def id_bits(size: int) -> int:
    """The width of ids for a corpus of so many bytes."""
    return min(62, (size // 4).bit_length() + SPARE) + 2


def _id(hashes: np.ndarray, kind: np.uint64, bits: int) -> np.ndarray:
    return hashes >> U(64 - bits) & ~_KIND | kind


def token_ids(buf: np.ndarray, offs: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: the word id of each token, the id of its bigram with the one before it (none at the first of all),
    and the first token of each text (one number more than texts)."""
    for i, j in pieces(offs, _PIECE):
        part = buf[offs[i] : offs[j]]
        starts, ends, first = word_bounds(part, offs[i : j + 1] - offs[i], NOT_SPACE)
        words = word_hashes(part, starts, ends)
        pairs = np.zeros(len(words), np.uint64)
        pairs[1:] = mix(words[:-1] * _PLACES[0] + words[1:] * _PLACES[1] + U(2))
        yield _id(words, WORD, bits), _id(pairs, PAIR, bits), first


def _text_ids(tids: np.ndarray, bits: int) -> np.ndarray:
    return _id(mix(tids.view(np.uint64)), TEXT, bits)


def _counted(buf: np.ndarray, offs: np.ndarray, tids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted ids of the words, bigrams and texts of some texts, and how often each occurs."""
    found = [_text_ids(tids, bits)]
    for words, pairs, first in token_ids(buf, offs, bits):
        follows = np.ones(len(words), bool)
        follows[first[:-1][first[:-1] < len(words)]] = False
        found += [words, pairs[follows]]
    return np.unique(np.concatenate(found), return_counts=True)


def _pack(x: np.ndarray) -> bytes:
    """Numbers with their bytes by place, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(z: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(-1)


def _dealt(ids: np.ndarray, counts: np.ndarray, slices: int, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(slice, ids, counts) of sorted ids; slices is a power of two."""
    cuts = np.searchsorted(ids, np.arange(1, slices, dtype=np.uint64) << U(bits - slices.bit_length() + 1))
    for k, (i, n) in enumerate(zip(np.split(ids, cuts), np.split(counts, cuts), strict=True)):
        if len(i):
            yield k, _pack(np.diff(i, prepend=U(0)).view(np.int64)), _pack(n)


_CHUNKS = "chunk long, doc_id array<long>, tid binary, offs binary, z binary"
_COUNTS = "slice int, chunk long, kind int, ids binary, n binary"


def _chunks(docs: DataFrame, text: str, name: str) -> DataFrame:
    """The rows of docs packed into chunks, with numbers that stay as they are written."""

    def packed(number: int, ids: list, tids: list, parts: list, sizes: list) -> pa.RecordBatch:
        offs = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)
        z = zstandard.ZstdCompressor(level=3).compress(np.concatenate(parts).tobytes())
        columns = [pa.array([number], pa.int64()), pa.array([[x for i in ids for x in i.to_pylist()]], pa.list_(pa.int64()))]
        columns += [pa.array([x], pa.binary()) for x in (np.concatenate(tids).tobytes(), offs.tobytes(), z)]
        return pa.record_batch(columns, names=["chunk", "doc_id", "tid", "offs", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        ids, tids, parts, sizes = [], [], [], []
        for b in batches:
            buf, offs = string_parts(b.column(2))
            for i, j in pieces(offs, CHUNK // 4):
                if held and held + offs[j] - offs[i] > CHUNK:
                    yield packed(number, ids, tids, parts, sizes)
                    number, held = number + 1, 0
                    ids, tids, parts, sizes = [], [], [], []
                ids.append(b.column(0).slice(i, j - i))
                tids.append(b.column(1).to_numpy(zero_copy_only=False)[i:j].copy())
                parts.append(buf[offs[i] : offs[j]].copy())
                sizes.append(np.diff(offs[i : j + 1]))
                held += int(offs[j] - offs[i])
        if ids:
            yield packed(number, ids, tids, parts, sizes)

    body = text_of(text)
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_id(body).alias("tid"), body.alias("t")).mapInArrow(run, _CHUNKS), name)


def _opened(b: pa.RecordBatch, k: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, offsets and text ids of a chunk whose columns tid, offs and z start at `at`."""
    tid, offs, z = (b.column(at + c)[k].as_py() for c in range(3))
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8), np.frombuffer(offs, np.int64), np.frombuffer(tid, np.int64)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"slice": pa.int32(), "kind": pa.int32(), "chunk": pa.int64(), "n_words": pa.int64(), "total": pa.int64()}
    return pa.record_batch([pa.array(c, kinds.get(x, pa.binary())) for x, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


#: Kinds of counts: of a chunk to be scored that is part of the background or not, of the background alone, of the target alone.
ASKS_COUNTED, ASKS, BACK, AIM = range(4)


def _asked(chunks: DataFrame, slices: int, bits: int, kind: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, chunk in enumerate(b.column(0).to_pylist()):
                rows = [(s, chunk, kind, i, n) for s, i, n in _dealt(*_counted(*_opened(b, k, 1), bits), slices, bits)]
                if rows:
                    yield _batch(rows, ["slice", "chunk", "kind", "ids", "n"])

    return chunks.select("chunk", "tid", "offs", "z").mapInArrow(run, _COUNTS)


def _counts(docs: DataFrame, text: str, slices: int, bits: int, kind: int) -> DataFrame:
    """Counts of a corpus, added up over about a chunk in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list, sizes: list, tids: list) -> pa.RecordBatch:
            offs = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)
            counted = _counted(np.concatenate(parts), offs, np.concatenate(tids), bits)
            return _batch([(s, -1, kind, i, n) for s, i, n in _dealt(*counted, slices, bits)], ["slice", "chunk", "kind", "ids", "n"])

        parts, sizes, tids, held = [], [], [], 0
        for b in batches:
            buf, offs = string_parts(b.column(1))
            for i, j in pieces(offs, CHUNK // 4):
                if held and held + offs[j] - offs[i] > CHUNK:
                    yield told(parts, sizes, tids)
                    parts, sizes, tids, held = [], [], [], 0
                parts.append(buf[offs[i] : offs[j]].copy())
                sizes.append(np.diff(offs[i : j + 1]))
                tids.append(b.column(0).to_numpy(zero_copy_only=False)[i:j].copy())
                held += int(offs[j] - offs[i])
        if parts:
            yield told(parts, sizes, tids)

    body = text_of(text)
    return docs.select(content_id(body).alias("tid"), body.alias("t")).mapInArrow(run, _COUNTS)


def _answers(counts: DataFrame) -> DataFrame:
    """(slice, chunk, aim, back) for each part of a chunk, in the order of its ids; and one row of each slice, with chunk -1, of its
    number of words and the tokens of both models."""

    def tell(now: int, rows: list[tuple[int, int, bytes, bytes]]) -> Iterator[tuple]:
        ids = [np.cumsum(_unpack(r[2]).view(np.uint64), dtype=np.uint64) for r in rows]
        every = np.unique(np.concatenate(ids))
        aim, back, known = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), np.zeros(len(every), bool)
        for (_, kind, _, n), i in zip(rows, ids, strict=True):
            if kind != ASKS:
                at = np.searchsorted(every, i)
                (aim if kind == AIM else back)[at] += _unpack(n)
                known[at] = True
        word = (every & _KIND) == WORD
        yield now, -1, np.array([(known & word).sum(), aim[word].sum(), back[word].sum()], np.int64).tobytes(), b""
        for (chunk, kind, _, _), i in zip(rows, ids, strict=True):
            if kind in (ASKS, ASKS_COUNTED):
                at = np.searchsorted(every, i)
                yield now, chunk, _pack(aim[at]), _pack(back[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, names = None, [], ["slice", "chunk", "aim", "back"]
        for b in batches:
            for s, *row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if s != now:
                    if rows:
                        yield _batch(list(tell(now, rows)), names)
                    now, rows = s, []
                rows.append(tuple(row))
        if rows:
            yield _batch(list(tell(now, rows)), names)

    return materialise(counts.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, chunk long, aim binary, back binary"), "lm-answers")


def _own(x: np.ndarray) -> np.ndarray:
    """How often each value occurs in x, at each of its places."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[at].astype(np.float64)


def _losses(words: np.ndarray, pairs: np.ndarray, first: np.ndarray, own: tuple[np.ndarray, np.ndarray], held: np.ndarray, total: float) -> np.ndarray:
    """Mean loss in nats of each text with tokens. words and pairs: counts in a model at each token; own: those in the text
    itself, which are taken out where the model has counted the text (held)."""
    size = np.diff(first)
    out = np.repeat(held, size)
    words, pairs = words - out * own[0], pairs - out * own[1]
    single = (words + ADDED) / (total - np.repeat(held * size, size))
    before = np.concatenate(([0.0], words[:-1]))
    share = np.where(before > 0, BIGRAM, 0)
    share[first[:-1][size > 0]] = 0
    chance = share * pairs / np.maximum(before, 1) + (1 - share) * single
    return -np.add.reduceat(np.log(chance), first[:-1][size > 0]) / size[size > 0] if size.any() else np.zeros(0)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a label calls good: of quality 1 and not toxic. Labels grow with the documents, so their ids are
    broadcast only up to MOST_BROADCAST; with more, both sides are dealt out by doc_id."""
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    few = good.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return docs.join(F.broadcast(good) if few else good.hint("merge"), docs["doc_id"].cast("long") == good["good_id"], "left_semi")


def score(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score for each row of docs.

    Losses are means over the tokens, in nats; score = loss_background - loss_target. Without tokens (null, empty or
    blank texts) all three are null. Tokens are runs of other bytes than ASCII white space, A-Z lower-cased. background
    is docs unless given. A text is scored without its own counts in a model whose corpus holds that text (its own row
    or a copy), so that what was trained on is judged like the rest. Repeated rows each count; an empty target gives the
    uniform model. A very long text is a chunk of its own and scored whole. Other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    slices, bits = max(LEAST_SLICES, 1 << (-(-size // SLICE) - 1).bit_length()), id_bits(size)
    chunks = _chunks(docs, text, "lm-chunks")
    counts = _asked(chunks, slices, bits, ASKS_COUNTED if background is None else ASKS).unionAll(_counts(target, text, slices, bits, AIM))
    if background is not None:
        counts = counts.unionAll(_counts(background, text, slices, bits, BACK))
    answers = _answers(counts)
    sums = np.zeros(3, np.int64)
    for r in answers.where("chunk = -1").select("aim").collect():  # one row a slice
        sums += np.frombuffer(bytes(r.aim), np.int64)
    totals = [float(n) + ADDED * (int(sums[0]) + 1) for n in sums[1:].tolist()]

    def rated(doc_ids: list, opened: tuple, aim: np.ndarray, back: np.ndarray) -> pa.RecordBatch:
        buf, offs, tids = opened
        every, _ = _counted(buf, offs, tids, bits)
        models = [aim, back]
        held = [m[np.searchsorted(every, _text_ids(tids, bits))] > 0 for m in models]
        sizes, means, row = [], [[], []], 0
        for words, pairs, first in token_ids(buf, offs, bits):
            size = np.diff(first)
            number = mix(np.repeat(np.arange(len(size), dtype=np.uint64), size))
            # no bigram ends at the first word of a text: it gets an id that is of nothing
            pairs[first[:-1][size > 0]] = _KIND
            own = _own(words ^ number), _own(pairs ^ number)
            at = np.searchsorted(every, words)
            at_pair = np.minimum(np.searchsorted(every, pairs), len(every) - 1)
            sizes.append(size)
            for k, m in enumerate(models):
                loss = np.full(len(size), np.nan)
                loss[size > 0] = _losses(m[at].astype(np.float64), m[at_pair].astype(np.float64), first, own, held[k][row : row + len(size)], totals[k])
                means[k].append(loss)
            row += len(size)
        n = np.concatenate(sizes)
        aimed, behind = (np.concatenate(x) for x in means)
        return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), *(pa.array(x, mask=n == 0) for x in (aimed, behind, behind - aimed))], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aims, backs = [], []
        for b in batches:
            for k, s in enumerate(b.column(1).to_pylist()):
                if s >= 0:
                    aims.append(_unpack(b.column(2)[k].as_py()))
                    backs.append(_unpack(b.column(3)[k].as_py()))
                else:
                    yield rated(b.column(4)[k].as_py(), _opened(b, k, 5), np.concatenate(aims), np.concatenate(backs))
                    aims, backs = [], []

    said = answers.where("chunk >= 0").select("chunk", "slice", "aim", "back", F.lit(None).cast("array<long>").alias("doc_id"), *(F.lit(None).cast("binary").alias(c) for c in ("tid", "offs", "z")))
    whole = chunks.select("chunk", F.lit(-1).alias("slice"), *(F.lit(None).cast("binary").alias(c) for c in ("aim", "back")), "doc_id", "tid", "offs", "z")
    # the answers to a chunk in the order of slices, then the chunk
    rows = said.unionAll(whole).repartition("chunk").sortWithinPartitions("chunk", F.col("slice") < 0, "slice")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
