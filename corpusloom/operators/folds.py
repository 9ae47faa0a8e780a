"""Folds over one document that no set of windows expresses: reflow, vocabulary de-hyphenation, packing of chunks.

They run in Arrow batches, a document at a time, so memory is bounded by the longest document.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_END = re.compile(r"""[.!?]["'”’)\]]*$""")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def _paragraphs(lines: list[str], opens: Callable[[int, int], bool]) -> list[str]:
    """Lines joined by blanks into paragraphs; opens(s, i): line i opens one where the last began at line s."""
    starts = [0] if lines else []
    for i in range(1, len(lines)):
        if opens(starts[-1], i):
            starts.append(i)
    return [" ".join(lines[s:e]) for s, e in zip(starts, [*starts[1:], len(lines)])]


def reflow_text(text: str, wrap: int = 45) -> str:
    """Lines of each block between blank lines joined: a line that goes on (lower case, a mark), one after a comma or
    semicolon, and one after a paragraph of at least `wrap` characters so far whose last line ends no sentence."""

    def block(lines: list[str]) -> str:
        before = list(accumulate((len(x) + 1 for x in lines), initial=0))

        def opens(s: int, i: int) -> bool:
            goes_on = lines[i][0].islower() or lines[i][0] in ",;)" or lines[i - 1][-1] in ",;"
            return not goes_on and (before[i] - before[s] - 1 < wrap or _END.search(lines[i - 1]) is not None)

        return "\n".join(_paragraphs(lines, opens))

    lines = (x.strip() for x in text.split("\n"))
    return "\n\n".join(block(list(part)) for full, part in groupby(lines, bool) if full)


def bridge_text(text: str, min_words: int = 4, bridge_words: int = 6) -> str:
    """Paragraphs rejoined over breaks: one that ends no sentence takes the next block if that starts in lower case and
    the paragraph has enough words; inside a block, a capital or an opening quote after a line of enough words that ends
    a sentence opens a paragraph."""
    numbered = [(k, x.strip()) for k, x in enumerate(text.split("\n")) if x.strip()]
    lines = [x for _, x in numbered]
    words = list(accumulate((len(x.split()) for x in lines), initial=0))

    def opens(s: int, i: int) -> bool:
        last, first = lines[i - 1][-1], lines[i][0]
        if numbered[i][0] - numbered[i - 1][0] > 1:
            return last in ".?!\u201d\u2019\"" or not first.islower() or words[i] - words[s] < bridge_words
        return last in ".?!\u201d\"" and (first.isupper() or first in "\u201c\"") and words[i] - words[i - 1] >= min_words

    return "\n\n".join(_paragraphs(lines, opens))


_CUT = re.compile(r"([A-Za-z\u00C0-\u00FF]{2,})-[ \t]*\n[ \t]*([a-z\u00E0-\u00FF]{2,})")


def dehyphenate_text(text: str) -> str:
    """Words of letters cut at line ends before a small letter: joined if the document has the joined word, or does not
    have the hyphenated one. A word may be cut several times."""
    known = {w.lower() for w in re.findall(r"[A-Za-z\u00C0-\u00FF]+(?:-[A-Za-z\u00C0-\u00FF]+)*", text)}

    def mend(m: re.Match) -> str:
        a, b = m.group(1), m.group(2)
        return f"{a}{b}" if (a + b).lower() in known or f"{a}-{b}".lower() not in known else f"{a}-{b}"

    while (new := _CUT.sub(mend, text)) != text:
        text = new
    return text


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def pack_chunks(text: str, target: int = 2048, least: int = 64) -> list[tuple[str, int]]:
    """Paragraphs packed greedily into chunks of at most `target` tokens; longer paragraphs by sentences, longer
    sentences cut; chunks under `least` tokens go."""
    chunks: list[tuple[str, int]] = []

    def pack(items: list[str], glue: str) -> list[str]:
        """The parts that did not fit, in place; full buffers are emitted."""
        buf: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal buf, size
            if buf:
                chunks.append((glue.join(buf), size))
            buf, size = [], 0

        for item in items:
            n = count_tokens(item)
            if n > target:
                flush()
                if glue == " ":
                    spans = [m.span() for m in _TOKEN.finditer(item)]
                    for i in range(0, n, target):
                        part = spans[i : i + target]
                        chunks.append((item[part[0][0] : part[-1][1]], len(part)))
                else:
                    pack([s for s in re.split(r"(?<=[.!?])\s+", item) if s.strip()], " ")
                continue
            if size + n > target:
                flush()
            buf.append(item)
            size += n
        flush()
        return buf

    pack([p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()], "\n\n")
    return [c for c in chunks if c[1] >= least]


def pack_ids(sentences: list[list[int]], room: int = 510, first: int = 101, last: int = 102) -> list[tuple[list[int], list[int]]]:
    """Token ids packed into blocks of at most `room`, with the two special ids around: (ids, mask of the special ones).

    Sentences are whole in a block if they fit one; a block ends where the cumulative size passes its room."""
    parts = [ids[i : i + room] for ids in sentences for i in range(0, len(ids), room)]
    ends = list(accumulate(map(len, parts)))
    cuts = [0]
    while cuts[-1] < len(parts):
        cuts.append(bisect_right(ends, (ends[cuts[-1] - 1] if cuts[-1] else 0) + room))
    blocks = [[x for p in parts[i:j] for x in p] for i, j in zip(cuts, cuts[1:])]
    return [([first, *b, last], [1, *[0] * len(b), 1]) for b in blocks]


#: Characters, or ids, of a piece of a batch: what is held as Python objects at a time, besides the longest document.
_PIECE = 1 << 20


def _scalar(f):
    @F.arrow_udf(T.StringType())
    def run(s: pa.Array) -> pa.Array:
        done, piece, size = [], [], 0
        for x in s:
            x = x.as_py()
            piece.append(None if x is None else f(x))
            size += len(x or "")
            if size >= _PIECE:
                done.append(pa.array(piece, pa.string()))
                piece, size = [], 0
        return pa.concat_arrays([*done, pa.array(piece, pa.string())])

    return run


reflow, bridge, dehyphenate_by_vocabulary = _scalar(reflow_text), _scalar(bridge_text), _scalar(dehyphenate_text)


def chunks(df: DataFrame, key: str, text: str, target: int = 2048, least: int = 64, keep: list[str] | None = None) -> DataFrame:
    """(keep..., key, chunk, text, n_tokens): the chunks of each document, numbered from 0."""
    keep = keep or []
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*head, i, c, n) for *head, t in b.itertuples(index=False) for i, (c, n) in enumerate(pack_chunks(t or "", target, least))]
            yield pd.DataFrame(rows, columns=[*keep, key, "chunk", "text", "n_tokens"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*keep, key]), "chunk int, text string, n_tokens int"])
    return df.select(*keep, key, text).mapInPandas(run, schema)


def packed_blocks(df: DataFrame, key: str, text: str, room: int = 510, buckets: int = 30000) -> DataFrame:
    """(key, block, input_ids, special_tokens_mask): sentences as hashed word ids, packed, never across documents."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            rows, ids_all, mask_all, ends = [], array("i"), array("i"), array("i", [0])

            def piece() -> pa.RecordBatch:
                ids, mask = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(a, np.int32))) for a in (ids_all, mask_all))
                keys = b.column(0).take(pa.array([r for r, _ in rows], pa.int64()))
                return pa.RecordBatch.from_arrays([keys, pa.array([i for _, i in rows], pa.int32()), ids, mask], names=[key, "block", "input_ids", "special_tokens_mask"])

            for r, t in enumerate(b.column(1)):
                ids = [[1000 + zlib.crc32(w.lower().encode()) % buckets for w in _TOKEN.findall(s)] for s in re.split(r"(?<=[.!?])\s+", t.as_py() or "")]
                for i, (x, m) in enumerate(pack_ids([x for x in ids if x], room)):
                    rows.append((r, i))
                    ids_all.extend(x)
                    mask_all.extend(m)
                    ends.append(len(ids_all))
                if len(ids_all) >= _PIECE:
                    yield piece()
                    rows, ids_all, mask_all, ends = [], array("i"), array("i"), array("i", [0])
            yield piece()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kinds[key]}, block int, input_ids array<int>, special_tokens_mask array<int>")
