"""Suffix-array dedup: removal of bytes that a repeated string of at least `least` bytes covers.

Plan: (1) each window of `least` bytes is named by the 32 bytes in it whose hash is smallest (its anchor), so equal
windows have equal anchors at the same place; windows in a row with one anchor are a run. (2) Anchors that occur once
are dropped by one aggregate. (3) Equal runs repeat whole. (4) Other runs of a repeated anchor are suffixes to sort:
their bytes are fetched once a distinct run and ordered by the deep-shallow sort, whose tree of common prefixes gives
the longest match on both sides of the anchor. As each window of a run covers the anchor, the repeated windows of a run
cover one interval. (5) The intervals of a text are merged and cut out.
Groups of very many distinct runs of one anchor are counted by window instead, which spreads over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import U, _BYTE_CODES, _powers, content_id, materialise, mix, pieces, signed, string_parts, text_of
from corpusloom.llm.deep_shallow import Matches

LEAST, ANCHOR = 200, 32
#: Distinct runs of one anchor that one task sorts; beyond, windows are counted by hash.
MOST_SORTED = 3000
_PIECE = 1 << 20
_POS = 21
_C = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x9FB21C651E98DF25)]
_TABLES: list[np.ndarray] = []


def _sums(buf: np.ndarray) -> np.ndarray:
    if not _TABLES:
        n = (1 << _POS) + 8
        _TABLES[:] = [_powers(int(_C[0]), n), _powers(pow(int(_C[0]), -1, 1 << 64), n)]
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[buf] * _TABLES[0][: len(buf)], out=out[1:])
    return out


def _span_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((sums[hi] - sums[lo]) * _TABLES[1][lo] + (hi - lo).astype(np.uint64))


def runs(buf: np.ndarray, offs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Of texts of 2 MB together at most: (value, first byte, end, anchor byte, anchor hash, run hash) of each run."""
    n = len(buf)
    width = least - ANCHOR + 1
    if n < least:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded.data, 0, (1,))
    h = eight * _C[0]
    h ^= h >> U(29)
    m = n - 24
    h = h[:m] * _C[1] + h[8 : m + 8] * _C[2] + h[16 : m + 16] * _C[3] + h[24 : m + 24]
    h ^= h >> U(32)
    h *= _C[0]
    h ^= h >> U(29)
    h = h[: n - ANCHOR + 1]
    low = (h & ~U((1 << _POS) - 1)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    first, last = offs[:-1], offs[1:] - least
    good = np.zeros(n + 1, np.int8)
    fits = last >= first
    np.add.at(good, first[fits], 1)
    np.add.at(good, last[fits] + 1, -1)
    s = np.flatnonzero(np.cumsum(good)[: len(low)])
    if len(s) == 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    value = low[s]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (s[1:] != s[:-1] + 1)))
    # texts that touch: the first window of a text opens a run
    new |= np.isin(s, first[fits])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(s)) - 1
    lo, hi = s[begin], s[end] + least
    at = (value[begin] & U((1 << _POS) - 1)).astype(np.int64)
    return np.searchsorted(offs, lo, side="right") - 1, lo, hi, at, h[at], _span_hash(_sums(buf), lo, hi)


def _cut(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about 1 MB; a longer text in pieces that share least - 1 bytes: (bytes, offsets, rows, bases)."""
    buf, offs = string_parts(column)
    for i, j in pieces(offs, _PIECE):
        if offs[j] - offs[i] <= _PIECE:
            yield buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for base in range(0, int(offs[j] - offs[i]) - least + 1, _PIECE):
                part = buf[offs[i] + base : min(offs[j], offs[i] + base + _PIECE + least - 1)]
                yield part, np.array([0, len(part)]), np.array([i]), np.array([base])


_RUN = "kh long, sig long, tid long, at long, l short, r short"


def _all_runs(docs: DataFrame, least: int, text: str) -> DataFrame:
    names = ["kh", "sig", "tid", "at", "l", "r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tid = b.column(0).to_numpy()
            for buf, offs, rows, bases in _cut(b.column(1), least):
                k, lo, hi, at, kh, sig = runs(buf, offs, least)
                yield pa.record_batch([pa.array(signed(kh)), pa.array(signed(sig)), pa.array(tid[rows[k]]), pa.array(at - offs[k] + bases[k]), pa.array((at - lo).astype(np.int16)), pa.array((hi - at).astype(np.int16))], names=names)

    body = text_of(text)
    return docs.select(content_id(body).alias("tid"), body.alias("t")).mapInArrow(run, _RUN)


def _contexts(docs: DataFrame, distinct: DataFrame, text: str) -> DataFrame:
    """(kh, sig, n, l, c): the bytes c of each distinct run, fetched from one row that has the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = string_parts(b.column(0))
            asked = b.column(1)
            item = asked.flatten()
            owner = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            kh, sig, n, at, l, r = (item.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            place = offs[owner] + at
            for i in range(0, len(item), 20_000):
                s = slice(i, i + 20_000)
                bits = [buf[x:y].tobytes() for x, y in zip((place[s] - l[s]).tolist(), (place[s] + r[s]).tolist(), strict=True)]
                yield pa.record_batch([pa.array(kh[s]), pa.array(sig[s]), pa.array(n[s]), pa.array(l[s]), pa.array(bits, pa.binary())], names=["kh", "sig", "n", "l", "c"])

    body = text_of(text)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(content_id(body).alias("tid"), key.alias("row"), body.alias("t"))
    one = rows.groupBy("tid").agg(F.min("row").alias("row"))
    asked = distinct.groupBy("tid").agg(F.collect_list(F.struct("kh", "sig", "n", "at", "l", "r")).alias("asked"))
    return rows.join(asked.join(one, "tid"), ["tid", "row"]).select("t", "asked").mapInArrow(run, "kh long, sig long, n long, l short, c binary")


def _sorted_cover(least: int):
    """Rows sorted by kh -> (kh, sig, l, r): the part of each run that repeats, in bytes before and after the anchor."""

    def group(kh: int, rows: dict[int, tuple[int, int, bytes]], out: list) -> None:
        sigs = list(rows)
        left = [rows[s][2][: rows[s][1]][::-1] for s in sigs]
        right = [rows[s][2][rows[s][1] :] for s in sigs]
        found = Matches(right, left, least, start=ANCHOR)
        for i, s in enumerate(sigs):
            if rows[s][0] > 1:
                out.append((kh, s, len(left[i]), len(right[i])))
            elif found.ahead[i]:
                out.append((kh, s, found.behind[i], found.ahead[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, {}, []
        for b in batches:
            for kh, sig, n, l, c in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if kh != now:
                    if rows:
                        group(now, rows, out)
                    now, rows = kh, {}
                rows[sig] = (n, l, c)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int16(), pa.int16()), strict=True)], names=["kh", "sig", "l", "r"])
                out = []
        if rows:
            group(now, rows, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int16(), pa.int16()), strict=True)], names=["kh", "sig", "l", "r"])

    return run


def _window_hashes(least: int):
    """Of each distinct run: (kh, sig, n, j, w) for its windows, which start j bytes before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kh, sig, n, l, c in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                w = [hashlib.blake2b(c[s : s + least], digest_size=16).digest() for s in range(len(c) - least + 1)]
                k = len(w)
                yield pa.record_batch([pa.array([kh] * k), pa.array([sig] * k), pa.array([n] * k), pa.array([l - s for s in range(k)], pa.int16()), pa.array(w, pa.binary())], names=["kh", "sig", "n", "j", "w"])

    return run


def repeated_spans(docs: DataFrame, least: int = LEAST, text: str = "text", most_sorted: int = MOST_SORTED) -> DataFrame:
    """(tid, spans): for each text id with something to remove, the covered byte ranges (start, end), not merged."""
    all_runs = materialise(_all_runs(docs, least, text), "s-runs")
    # Written before the join, so that the join's inputs are plain exchanges whose skewed partitions can be split.
    again = materialise(all_runs.groupBy("kh").agg(F.count("*").alias("n"), F.min("sig").alias("s0"), F.max("sig").alias("s1")).where("n > 1").select("kh", (F.col("s0") != F.col("s1")).alias("mixed")), "s-again")
    hit = materialise(all_runs.join(again, "kh"), "s-hit")
    mixed = hit.where("mixed").groupBy("kh", "sig").agg(F.count("*").alias("n"), F.min(F.struct("tid", "at", "l", "r")).alias("p")).select("kh", "sig", "n", "p.*")
    ctx = materialise(_contexts(docs, mixed, text), "s-ctx")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = ctx.groupBy("kh").count().where(F.col("count") > most_sorted).select("kh")
    few = ctx.join(many, "kh", "left_anti").repartition(parts, "kh").sortWithinPartitions("kh").mapInArrow(_sorted_cover(least), "kh long, sig long, l short, r short")
    windows = ctx.join(many, "kh", "left_semi").mapInArrow(_window_hashes(least), "kh long, sig long, n long, j short, w binary")
    twice = windows.groupBy("kh", "j", "w").agg(F.sum("n").alias("m")).where("m > 1").select("kh", "j", "w")
    lots = windows.join(twice, ["kh", "j", "w"]).groupBy("kh", "sig").agg(F.max("j").alias("l"), (F.lit(least) - F.min("j")).cast("short").alias("r"))
    cover = few.unionAll(lots.select("kh", "sig", "l", "r"))
    partly = hit.where("mixed").drop("l", "r").join(cover, ["kh", "sig"])
    spans = hit.where("not mixed").select("tid", (F.col("at") - F.col("l")).alias("s"), (F.col("at") + F.col("r")).alias("e")).unionAll(partly.select("tid", F.col("at") - F.col("l"), F.col("at") + F.col("r")))
    return spans.groupBy("tid", "s", "e").agg(F.lit(1)).groupBy("tid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for b in batches:
        buf, offs = string_parts(b.column(1))
        sizes = np.diff(offs)
        removed, count, sha, kept = [], [], [], []
        spans = b.column(2)
        for k in range(b.num_rows):
            whole = buf[offs[k] : offs[k + 1]]
            gone = n = 0
            if spans[k].is_valid and len(spans[k]):
                item = spans[k].values
                s, e = item.field(0).to_numpy(), item.field(1).to_numpy()
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.concatenate(([True], s[1:] > e[:-1]))
                begin = s[new]
                end = e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                gone, n = int((end - begin).sum()), len(begin)
                edges = np.concatenate(([0], np.stack([begin, end], 1).ravel(), [len(whole)]))
                data = b"".join(whole[x:y].tobytes() for x, y in edges.reshape(-1, 2).tolist())
            else:
                data = whole.tobytes()
            removed.append(gone)
            count.append(n)
            sha.append(hashlib.sha256(data).hexdigest())
            kept.append(data)
        yield pa.record_batch([b.column(0), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=names)


def remove_repeats(docs: DataFrame, least: int = LEAST, text: str = "text", most_sorted: int = MOST_SORTED) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes.

    A byte goes when a string of `least` bytes that covers it also starts elsewhere, in the same text or in another row;
    matches may overlap, never cross texts, and are judged on the input. A null text is empty; texts shorter than
    `least` keep all. Repeated rows count as further places. doc_id may be null or repeated; other columns are ignored.
    The kept bytes may begin or end inside a UTF-8 character. An empty table gives an empty result.
    """
    body = text_of(text)
    rows = docs.select(content_id(body).alias("tid"), F.col("doc_id").cast("long").alias("doc_id"), body.alias("t"))
    joined = rows.join(repeated_spans(docs, least, text, most_sorted), "tid", "left").select("doc_id", "t", "spans")
    return joined.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
