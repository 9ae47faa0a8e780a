"""N-gram Jaccard join by PartEnum signatures, and the near-duplicate groups that its links make.

Plan: (1) every distinct text is a set of word shingles; (2) sets of one size band use one partitioning of the hashed
shingle domain, and the contents of enumerated subsets of its parts are the signatures of a set; (3) signatures are dealt
out and sorted by value, so that a group streams through a task without being held, and those that a sample shows to be
very common are dealt out by text as well; (4) each group links its members to a head, the member that meets the most
texts in all its groups, so that copies of one text meet that text; these pairs are verified on the whole sets, and
components are formed; (5) in groups that still span several components, members of different ones are compared by
sketches in blocks, and the pairs that may match are verified too. A pair that is never verified is already in one
component, or too far apart by its sizes or sketches. (6) All links lie inside components, so the links of a text are
counted there, by products of 0/1 matrices over blocks of members, and no pair is written for it.

Why no pair is lost: for sets of n <= m shingles with J >= t, at most h = (1-t)/(1+t) * (n + m) shingles differ, and
each breaks one part at most. A set that fills f > h parts shares at least f - h of them with each partner, so, in any
common order of parts, subsets of one part among the first h + 1 of each suffice (two sets that fill enough parts, or one
that does and one that emits all it has). The order puts parts of common shingles last (a list from a bounded sample,
which only affects speed). Sets that fill too few parts, small ones mostly, use the finest partitioning too, in which
each shingle is a part: they share all but h of these, so their first h + s have s in common, and the subsets of s parts
among those are enumerated; s is 2 below 64 shingles (1 for a single shingle), and 1 in the larger bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import _PLACES, U, content_id, discard, materialise, mix, pieces, shingle_hashes, signed, string_parts, text_of, word_bounds, word_hashes
from corpusloom.llm.components import connected_components

WIDTH, PERCENT = 5, 75
#: The sample for the list of common shingles, and the share of its texts that makes a shingle common: the list has
#: at most (mean shingles a text) / COMMON_SHARE entries, whatever the corpus holds.
SAMPLE_TEXTS, COMMON_SHARE = 8000, 0.0005
#: Texts of more shingles are not drawn, so the sample has a known size.
SAMPLE_LONGEST = 20_000
#: The share of the sample's texts that makes a signature hot, and over how many cells its texts are dealt. There are at
#: most (mean signatures a text) / HOT_SHARE hot ones, whatever the corpus holds.
HOT_SHARE, HOT_CELLS = 0.004, 64
#: Members of a group that meet in one task; larger groups are dealt over pairs of blocks.
BLOCK = 1024
#: Shingle hashes that a verifying task keeps at hand, and that a block of a component may hold.
HELD = 2_000_000
_CHUNK = 4 << 20


def text_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, offs = string_parts(column)
    for i, j in pieces(offs, _CHUNK):
        part = buf[offs[i] : offs[j]]
        starts, ends, first = word_bounds(part, offs[i : j + 1] - offs[i])
        words = word_hashes(part, starts, ends)
        first = first.tolist()
        for k in range(j - i):
            yield np.unique(shingle_hashes(words[first[k] : first[k + 1]], width))


def _bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, parts, differences at most) under which a set of n shingles emits signatures: a pair meets in the band of its smaller set."""
    band = (n.bit_length() - 1) // 2
    low = 4**band
    largest = n * 100 // percent
    out = [(band, max(2 * low, 8), (100 - percent) * (n + largest) // (100 + percent))]
    if -(-n * percent // 100) < low:
        out.append((band - 1, max(low // 2, 8), (100 - percent) * (n + low - 1) // (100 + percent)))
    return out


def signatures(shingles: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The PartEnum signatures of a sorted set of shingle hashes."""
    n = len(shingles)
    if n == 0:
        return shingles
    rare = np.ones(n, bool)
    if len(common):
        at = np.searchsorted(common, shingles)
        at[at == len(common)] = 0
        rare = common[at] != shingles
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(shingles + U(0x51ED27)), out=sums[1:])
    found = []
    for band, parts, differ in _bands(n, percent):
        part = ((shingles >> U(32)) * U(parts)) >> U(32)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        end = np.append(begin[1:], n)
        value = mix(sums[end] - sums[begin] + mix(part[begin] + U(band << 40)))
        if len(value) > differ + 1:
            order = np.where(np.logical_or.reduceat(rare, begin), value >> U(1), value | U(1 << 63))
            found.append(value[np.argpartition(order, differ)[: differ + 1]])
        else:
            found.append(value)
        if len(value) <= differ:
            found.append(_fine_subsets(shingles, rare, band, n, differ))
    return np.concatenate(found)


def _fine_subsets(shingles: np.ndarray, rare: np.ndarray, band: int, n: int, differ: int) -> np.ndarray:
    """Subsets of the finest parts, one for each shingle: of one part in the larger bands, else of two."""
    value = mix(shingles ^ U(0xA5A5A5A5 + band))
    order = np.argsort(np.where(rare, value >> U(1), value | U(1 << 63)))
    if n == 1 or band > 2:
        return value[order[: differ + 1]]
    first = np.sort(value[order[: differ + 2]])
    i, j = np.triu_indices(len(first), 1)
    return mix(first[i] * _PLACES[0] + first[j] * _PLACES[1] + U(band))


def count_sketch(shingles: np.ndarray) -> bytes:
    """How many shingles each of 2**k equal ranges of hashes holds, 2 at most on average, two ranges a byte; empty: not known.

    Two sets differ in at least as many shingles as their counts do in all, so a sketch never hides a similar pair.
    """
    bits = max(8, len(shingles).bit_length() - 1)
    counts = np.bincount((shingles >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return (counts[::2] << 4 | counts[1::2]).astype(np.uint8).tobytes() if counts.max() < 16 else b""


def _counts_of(sketches: bytes) -> np.ndarray:
    """The counts in one or more sketches."""
    both = np.frombuffer(sketches, np.uint8)
    return np.stack([both >> 4, both & 15], 1).ravel()


def _may_match(x: bytes, y: bytes, differ: int) -> bool:
    if not x or not y:
        return True
    p, q = _counts_of(x).astype(np.int16), _counts_of(y).astype(np.int16)
    if len(p) < len(q):
        p, q = q, p
    if len(p) > len(q):
        p = p.reshape(len(q), -1).sum(1)
    return int(np.abs(p - q).sum()) <= differ


def shingle_counts(docs: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """(tid, doc_id, n, k) of every row: the id of its text, the size of its set, and its count sketch. Null texts have size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k = [], []
            for s in text_sets(b.column(1), width):
                n.append(len(s))
                k.append(count_sketch(s))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(k, pa.binary())], names=["tid", "doc_id", "n", "k"])

    body = text_of(text)
    return docs.select(content_id(body).alias("tid"), body.alias("t"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "tid long, doc_id long, n long, k binary")


def _sampled(docs: DataFrame, sketches: DataFrame, width: int, percent: int, text: str) -> tuple[np.ndarray, list[int]]:
    """(common, hot): shingles in many texts of a bounded sample, chosen by hash, and signatures of many of its texts.

    The lists only decide which signatures come first and how they are dealt out. Ids are drawn first, so that the top of
    an order never moves texts.
    """
    drawn = sketches.where(f"n > 0 and n <= {SAMPLE_LONGEST}").select("tid", "row").orderBy(F.xxhash64("tid", F.lit(5)), "tid", "row").limit(SAMPLE_TEXTS)
    body = text_of(text)
    rows = docs.select(content_id(body).alias("tid"), _row("doc_id").alias("row"), body.alias("t"))
    some = materialise(rows.join(F.broadcast(drawn), ["tid", "row"], "left_semi").select("t"), "j-sample")

    def often(of, least: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in text_sets(b.column(0), width):
                    if len(s):
                        yield pa.record_batch([pa.array(signed(np.unique(of(s))))], names=["h"])

        got = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least).select("h").toArrow()
        return np.sort(np.array(got.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64))

    common = often(lambda s: s, max(3, int(SAMPLE_TEXTS * COMMON_SHARE)))
    hot = often(lambda s: signatures(s, common, percent), int(SAMPLE_TEXTS * HOT_SHARE))
    discard(some)
    return common, signed(hot).tolist()


def _signature_rows(docs: DataFrame, common: np.ndarray, width: int, percent: int, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tids = b.column(0).to_numpy(zero_copy_only=False)
            sigs, owner, held = [], [], 0
            for tid, s in zip(tids.tolist(), text_sets(b.column(1), width), strict=True):
                v = signatures(s, common, percent)
                sigs.append(v)
                owner.append(np.full(len(v), tid, np.int64))
                held += len(v)
                if held > 400_000:
                    yield pa.record_batch([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(owner))], names=["sig", "tid"])
                    sigs, owner, held = [], [], 0
            if held:
                yield pa.record_batch([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(owner))], names=["sig", "tid"])

    body = text_of(text)
    return docs.select(content_id(body).alias("tid"), body.alias("t")).mapInArrow(run, "sig long, tid long")


def _groups(hot: list[int]):
    """Rows sorted by (sig, tid) -> (sig, a, b): the two texts of a signature of two, one row with the text a (b null) for
    each text of one that has more, or that is hot, as its texts are spread over tasks. Two ids at most are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []  # the texts of the open group that are not told yet
        now, size, last = None, 0, None
        spread = np.array(sorted(hot), np.int64)

        def told(*columns) -> pa.RecordBatch:
            return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=["sig", "a", "b"])

        def closed() -> list[tuple[int, int, int | None]]:
            if not held:
                return []
            if size == 2 and len(held) == 2 and not is_hot(now):
                return [(now, held[0], held[1])]
            return [(now, t, None) for t in held] if size > 2 or is_hot(now) else []

        def is_hot(sig: int) -> bool:
            k = int(np.searchsorted(spread, sig))
            return k < len(spread) and spread[k] == sig

        for b in batches:
            sig, tid = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(sig):
                continue
            keep = np.ones(len(sig), bool)
            keep[1:] = (sig[1:] != sig[:-1]) | (tid[1:] != tid[:-1])
            keep[0] = (sig[0], tid[0]) != (now, last)
            sig, tid = sig[keep], tid[keep]
            if not len(sig):
                continue
            last = int(tid[-1])
            begin = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            count = np.diff(np.append(begin, len(sig)))
            rows: list[tuple[int, int, int | None]] = []
            # the first run may go on with the open group, the last one stays open
            for k in dict.fromkeys((0, len(begin) - 1)):
                these = tid[begin[k] : begin[k] + count[k]].tolist()
                if sig[begin[k]] == now:
                    size += len(these)
                else:
                    rows += closed()
                    now, size, held = int(sig[begin[k]]), len(these), []
                held += these
                if size > 2:
                    rows += [(now, t, None) for t in held]
                    held = []
            if rows:
                yield told(*zip(*rows, strict=True))
            inner = np.arange(1, len(begin) - 1)
            if len(inner):
                marked = np.isin(sig[begin[inner]], spread)
                two = begin[inner[(count[inner] == 2) & ~marked]]
                if len(two):
                    yield told(sig[two], tid[two], tid[two + 1])
                many = np.zeros(len(begin), bool)
                many[inner[(count[inner] > 2) | marked]] = True
                rest = np.repeat(many, count)
                if rest.any():
                    yield told(sig[rest], tid[rest], pa.nulls(int(rest.sum()), pa.int64()))
        rows = closed()
        if rows:
            yield told(*zip(*rows, strict=True))

    return run


def _row(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(-(2**63)))


def _cross_pairs(percent: int):
    """Rows sorted by cell -> (a, b): pairs of one cell in different components that sizes and sketches allow.

    side 0: the cell is one block, any two may pair; sides 1 and 2: only across the sides.
    """

    def pairs(rows: list[tuple[int, int, int, int, bytes]], done: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        rows = sorted(set(rows), key=lambda r: r[3])
        n = np.array([r[3] for r in rows])
        comp, side, tid = (np.array([r[k] for r in rows]) for k in (2, 0, 1))
        width = np.array([2 * len(r[4]) for r in rows])
        # sketches of one width as a matrix, and folded to half of it
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            full = _counts_of(b"".join(rows[i][4] for i in at)).reshape(len(at), w) if w else np.zeros((len(at), 0), np.uint8)
            tables[w] = (at, full)
        where = np.empty(len(rows), np.int64)
        for at, _ in tables.values():
            where[at] = np.arange(len(at))
        for i in range(len(rows) - 1):
            end = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
            j = np.arange(i + 1, end)
            j = j[(comp[j] != comp[i]) & (tid[j] != tid[i]) & ((side[j] != side[i]) | (side[i] == 0))]
            if not len(j):
                continue
            differ = (100 - percent) * (n[i] + n[j]) // (100 + percent)
            good = np.ones(len(j), bool)
            w = int(width[i])
            if w:
                mine = tables[w][1][where[i]].astype(np.int16)
                for v in np.unique(width[j]).tolist():
                    if not v:
                        continue
                    these = np.flatnonzero(width[j] == v)
                    other = tables[v][1][where[j[these]]].astype(np.int16)
                    small = min(v, w)
                    x = mine.reshape(small, -1).sum(1)
                    y = other if v == small else other.reshape(len(these), small, -1).sum(2)
                    good[these] = np.abs(y - x).sum(1) <= differ[these]
            for k in j[good].tolist():
                pair = (min(rows[i][1], rows[k][1]), max(rows[i][1], rows[k][1]))
                if pair not in done:
                    yield pair
                    done.add(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out, done = None, [], [], set()

        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

        for b in batches:
            for cell, *row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if cell != now:
                    out += pairs(rows, done) if rows else []
                    now, rows = cell, []
                    if len(out) > 50_000:
                        yield batch(out)
                        out = []
                    if len(done) > 500_000:
                        done.clear()
                rows.append(tuple(row))
        out += pairs(rows, done) if rows else []
        if out:
            yield batch(out)

    return run


def _packed_texts(docs: DataFrame, asked: DataFrame, text: str) -> DataFrame:
    """(tid, z): the compressed text of each id that is asked for, from the row with it that is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            buf, offs = string_parts(b.column(1))
            blobs = [press.compress(buf[offs[k] : offs[k + 1]].tobytes()) for k in range(b.num_rows)]
            yield pa.record_batch([b.column(0), pa.array(blobs, pa.binary())], names=["tid", "z"])

    body = text_of(text)
    rows = docs.select(content_id(body).alias("tid"), _row("doc_id").alias("row"), body.alias("t"))
    found = rows.join(asked, ["tid", "row"], "left_semi").select("tid", "t").mapInArrow(run, "tid long, z binary")
    return materialise(found.dropDuplicates(["tid"]), "j-texts")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: dict[int, np.ndarray] = {}
        size = 0

        def get(tid: int, z: bytes) -> np.ndarray:
            nonlocal size
            if tid not in held:
                while held and size > HELD:
                    size -= len(held.pop(next(iter(held))))
                held[tid] = next(text_sets(pa.array([unpack.decompress(z)], pa.binary()), width))
                size += len(held[tid])
            return held[tid]

        for batch in batches:
            good = []
            za, zb = batch.column(2), batch.column(3)
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = get(a, za[k].as_py()), get(b, zb[k].as_py())
                if len(y) > len(x):
                    x, y = y, x
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum()) if len(x) else 0
                good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("tid").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("tid").alias("b"), F.col("z").alias("zb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _counted_links(percent: int, width: int):
    """Rows sorted by cell -> (tid, w): for each text, the copies of the texts of its cell that it links to.

    side 0: any two of the cell; sides 1 and 2: only across. A cell holds two blocks at most.
    """
    columns = 4096

    def count(rows: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        unpack = zstandard.ZstdDecompressor()
        rows = sorted(rows, key=lambda r: r[:2])
        side, tid, copies = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        sets = [next(text_sets(pa.array([unpack.decompress(r[3])], pa.binary()), width)) for r in rows]
        size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(rows)), size)
        _, word, often = np.unique(flat, return_inverse=True, return_counts=True)
        # shingles of one text only take no part in a product
        number = np.cumsum(often > 1) - 1
        shared = often[word] > 1
        word, owner = number[word[shared]], owner[shared]
        order = np.argsort(word, kind="stable")
        word, owner = word[order], owner[order]
        cut = int(np.searchsorted(side, 2)) if side[0] else len(rows)
        left, right = slice(0, cut), (slice(cut, len(rows)) if side[0] else slice(0, cut))
        both = np.zeros((cut, right.stop - right.start), np.float64)
        for lo in range(0, int(number[-1]) + 1, columns):
            i, j = np.searchsorted(word, (lo, lo + columns))
            has = np.zeros((len(rows), min(columns, int(number[-1]) + 1 - lo)), np.float32)
            has[owner[i:j], word[i:j] - lo] = 1
            both += has[left] @ has[right].T
        linked = (both > 0) & (100 * both >= percent * (size[left, None] + size[None, right] - both))
        if side[0]:
            return tid, np.concatenate([linked @ copies[right], copies[left] @ linked])
        np.fill_diagonal(linked, False)
        return tid, linked @ copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out, held = None, [], [], 0

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate([x[k] for x in out]).astype(np.int64)) for k in range(2)], names=["tid", "w"])

        for b in batches:
            for cell, *row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if cell != now:
                    if len({r[0] for r in rows} - {0}) == 2 or len(rows) > 1 and rows[0][0] == 0:
                        out.append(count(rows))
                        held += len(rows)
                    now, rows = cell, []
                    if held > 20_000:
                        yield told()
                        out, held = [], 0
                rows.append(tuple(row))
        if len({r[0] for r in rows} - {0}) == 2 or len(rows) > 1 and rows[0][0] == 0:
            out.append(count(rows))
        if out:
            yield told()

    return run


def _blocks(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """rows with cell and side, once for each pair of blocks of its group that it takes part in."""
    own = F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side")
    return dealt.select("*", cell, side).drop("blocks", "own", "other")


class JaccardJoin:
    """The similarity join of the texts of docs, whose scratch tables live until `close`.

    rows: (tid, doc_id, n), one for each row of docs; components: (node, component) of each text that has a link.
    """

    def __init__(self, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text"):
        self.docs, self.width, self.percent, self.text = docs, width, percent, text
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self._scratch: list[DataFrame] = []
        rows = self._kept(shingle_counts(docs, width, text), "j-rows")
        self.rows = rows.select("tid", "doc_id", "n")
        one = rows.groupBy("tid").agg(F.min(F.struct(_row("doc_id").alias("row"), "n", "k")).alias("p"), F.count("*").alias("copies"))
        self.sketches = self._kept(one.select("tid", "p.*", "copies"), "j-sketches")
        self.groups = self._kept(self._grouped(), "j-groups")
        # texts of a group of two, and of larger groups
        self.couples = self.groups.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        members = self.groups.where("b is null").select("sig", F.col("a").alias("t"))
        self.large = self._kept(members.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1"), "j-large")
        self.members = members
        self.components = self._components()

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        self._scratch.append(materialise(df, name))
        return self._scratch[-1]

    def _dropped(self, *tables: DataFrame) -> None:
        for t in tables:
            self._scratch = [x for x in self._scratch if x is not t]
            discard(t)

    def _grouped(self) -> DataFrame:
        common, hot = _sampled(self.docs, self.sketches, self.width, self.percent, self.text)
        sigs = _signature_rows(self.docs, common, self.width, self.percent, self.text)
        spread = F.when(F.col("sig").isin(hot), F.pmod(F.col("tid"), F.lit(HOT_CELLS))).otherwise(F.lit(0)) if hot else F.lit(0)
        return sigs.repartition(self.parts, F.xxhash64("sig", spread)).sortWithinPartitions("sig", "tid").mapInArrow(_groups(hot), "sig long, a long, b long")

    def _fitting(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and sketches allow the similarity."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                differ = ((100 - percent) * (b.column(2).to_numpy() + b.column(3).to_numpy()) // (100 + percent)).tolist()
                good = [_may_match(x, y, h) for x, y, h in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), differ, strict=True)]
                yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

        def side(c: str, *more: str) -> DataFrame:
            return self.sketches.select(F.col("tid").alias(c), *(F.col(x).alias(x + c) for x in more))

        sized = pairs.join(side("a", "n"), "a").join(side("b", "n"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return sized.join(side("a", "k"), "a").join(side("b", "k"), "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long")

    def _packed(self, ids: DataFrame) -> DataFrame:
        return _packed_texts(self.docs, ids.join(self.sketches.select("tid", "row"), "tid"), self.text)

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(F.col("a").alias("tid")).unionAll(pairs.select(F.col("b").alias("tid"))).distinct()
        texts = self._packed(ends)
        out = self._kept(_verify(pairs, texts, self.width, self.percent), name)
        discard(texts)
        return out

    def _compared(self, named: DataFrame) -> DataFrame:
        """The pairs of large groups that are in different components and that sizes and sketches allow, from blocks of bounded size."""
        seen = self.members.join(named.select("t", "c"), "t")
        mixed = seen.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("c0 <> c1").select("sig", "m")
        dealt = _blocks(self.members.join(mixed, "sig"), "sig", F.ceil(F.col("m") / BLOCK).cast("int"))
        cells = dealt.select("cell", "side", "t").join(named, "t").select("cell", "side", "t", "c", "n", "k").repartition(self.parts, "cell").sortWithinPartitions("cell")
        return cells.mapInArrow(_cross_pairs(self.percent), "a long, b long").distinct()

    def _components(self) -> DataFrame:
        inside = self.members.join(self.large, "sig")
        meets = inside.groupBy("t").agg(F.sum("m").alias("meets"))
        heads = self._kept(inside.join(meets, "t").groupBy("sig").agg(F.max(F.struct("meets", "t")).alias("h")).select("sig", F.col("h.t").alias("h")), "j-heads")
        spokes = self.members.join(heads, "sig").where("t <> h").select(F.least("t", "h").alias("a"), F.greatest("t", "h").alias("b"))
        stars = self._kept(self._fitting(self.couples.unionAll(spokes).distinct()), "j-stars")
        links = self._verified(stars, "j-links")
        comps = connected_components(links)
        self._dropped(heads)
        # Groups that span several components: members of different ones are compared, in blocks of bounded size.
        shape = self.sketches.select(F.col("tid").alias("t"), "n", "k")
        named = self._kept(shape.join(comps.select(F.col("node").alias("t"), "component"), "t", "left").select("t", F.coalesce("component", "t").alias("c"), "n", "k"), "j-named")
        rest = self._kept(self._compared(named).join(stars, ["a", "b"], "left_anti"), "j-rest")
        if not rest.isEmpty():
            more = self._verified(rest, "j-more")
            if not more.isEmpty():
                discard(comps)
                comps = connected_components(links.unionAll(more))
        self._dropped(self.groups, self.large, stars, named, rest)
        self._scratch.append(comps)
        return comps

    def link_counts(self) -> DataFrame:
        """(tid, others): the rows of other texts that each text links to; texts without any may be absent."""
        texts = self.sketches.select("tid", "row", "n", "copies").join(self.components.select(F.col("node").alias("tid"), "component"), "tid")
        texts = self._kept(texts, "j-members")
        sizes = texts.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("held"))
        blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("held") / HELD)).cast("int")
        dealt = _blocks(texts.select(F.col("tid").alias("t"), "copies", "component").join(sizes, "component"), "component", blocks)
        packed = _packed_texts(self.docs, texts.select("tid", "row"), self.text)
        cells = dealt.join(packed.withColumnRenamed("tid", "t"), "t").select("cell", "side", "t", "copies", "z").repartition(self.parts, "cell").sortWithinPartitions("cell")
        counted = self._kept(cells.mapInArrow(_counted_links(self.percent, self.width), "tid long, w long").groupBy("tid").agg(F.sum("w").alias("others")), "j-counts")
        discard(packed)
        self._dropped(texts)
        return counted


def near_duplicate_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", links: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links), text_id, group_id;
    with links also n_links, the number of other rows that it links to, copies of its text included.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased; a set is the distinct runs of `width` words,
    or the whole sequence if shorter. Two rows link when 100 * intersection >= percent * union. A null, empty or blank
    text has the size 0 and no link: its component is its own doc_id. Equal texts link when they have words. Repeated
    rows stay, each with its row. text_id is the id of the text and group_id the same for all rows of a group. A null
    doc_id takes part, but is never the smallest unless all of its group are null. Very long texts are handled whole.
    Other columns are ignored, whatever their names; an empty table gives an empty result.

    The links of a component of k different texts are counted by k^2 / 2 comparisons, in blocks over all tasks.
    """
    join = JaccardJoin(docs, width, percent, text)
    keyed = join.rows.join(join.components.withColumnRenamed("node", "tid"), "tid", "left")
    more: list[Column] = []
    if links:
        copies = join.sketches.select("tid", "copies")
        keyed = keyed.join(copies, "tid").join(join.link_counts(), "tid", "left")
        more = [F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("others", F.lit(0))).otherwise(F.lit(0)).alias("n_links")]
    keyed = keyed.select("doc_id", "n", "tid", F.coalesce("component", "tid").alias("c"), *more)
    least = keyed.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return keyed.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), own, F.col("tid").alias("text_id"), F.col("c").alias("group_id"), *(["n_links"] if links else []))
