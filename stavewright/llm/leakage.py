"""Problem 8: passages of evaluation items inside documents.

An Aho-Corasick automaton holds the items as chunks of (k+1)/2 words, side by side:
any ``k`` words in a row of an item contain one of its chunks whole. Each document is
tidied, lowered, cut into words and read once; a chunk that is met is extended to both
sides for as long as document and item agree, and ``k`` words or more are a leak.
Chunks side by side make as many states as the items have words. Offsets are computed
for documents with hits only, in the text as stored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavewright.llm.tidy import pieces, tidy
from stavewright.storage import ship

_WORD = re.compile(r"[^\W_]+")
# What separates words of plain text, as a table: far quicker than the expression.
_APART = {c: " " for c in range(128) if not chr(c).isalnum()}

#: Characters of items in one automaton: what a worker has in memory at a time. Items beyond that fill further automata; documents are read once all the same.
BLOCK_CHARS = 8 << 20
#: Words of documents that wait for all automata to pass over them.
SPOOL_WORDS = 8 << 20


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the tidied text, case ignored."""
    if text.isascii():
        return text.lower().translate(_APART).split()
    return _WORD.findall(tidy(text).lower())


class Passages:
    """The automaton over a block of items."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        import ahocorasick

        self.k = k
        self.chunk = (k + 1) // 2
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, tuple[int, ...]]] = []
        chunks: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words(text))
            if len(ids) >= k:
                for i in range(0, len(ids) - self.chunk + 1, self.chunk):
                    chunks[ids[i : i + self.chunk]].append((len(self.items), i))
                self.items.append((item_id, ids))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for chunk, at in chunks.items():
            self.automaton.add_word(chunk, at)
        self.empty = not chunks
        if chunks:
            self.automaton.make_automaton()

    def hits(self, found: list[str]) -> list[tuple[int, int, int]]:
        """``(item_id, first word, last word)`` of the maximal stretches of ``found`` that are made of ``k`` words in a row of that item."""
        if self.empty:
            return []
        get = self.number.get
        ids = tuple([get(w, 0) for w in found])
        done: dict[tuple[int, int], int] = {}  # how far an item was followed along one alignment
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, places in self.automaton.iter(ids):
            for item, at in places:
                shift = end - self.chunk + 1 - at
                if done.get((item, shift), -1) >= end:
                    continue
                held = self.items[item][1]
                a, b = end - self.chunk + 1, end
                while a > 0 and a - shift > 0 and ids[a - 1] == held[a - 1 - shift]:
                    a -= 1
                while b + 1 < len(ids) and b + 1 - shift < len(held) and ids[b + 1] == held[b + 1 - shift]:
                    b += 1
                done[item, shift] = b
                if b - a + 1 >= self.k:
                    ends[item].append((a + self.k - 1, b))
        out = []
        for item, spans in ends.items():
            # Stretches of several alignments whose runs end side by side are one.
            spans.sort()
            a, b = spans[0]
            for x, y in spans[1:]:
                if x > b + 1:
                    out.append((self.items[item][0], a - self.k + 1, b))
                    a, b = x, y
                b = max(b, y)
            out.append((self.items[item][0], a - self.k + 1, b))
        return out


def stored_offsets(text: str) -> list[tuple[int, int]]:
    """For each word of :func:`words`, where it begins and ends in the text as stored."""
    form, at = [], []
    for a, b in pieces(text):
        piece = tidy(text[a:b]).lower()
        form.append(piece)
        at += [(a, b)] * len(piece)
    return [(at[m.start()][0], at[m.end() - 1][1]) for m in _WORD.finditer("".join(form))]


_MADE: dict[tuple, Passages] = {}  # the automaton a worker built last


def _blocks(items: DataFrame, block_chars: int) -> list[bytes]:
    """The items in the order of their ids, packed in blocks of about ``block_chars`` characters."""
    blocks, block, chars = [], [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        chars += len(r.text)
        if chars >= block_chars:
            blocks.append(zlib.compress(pickle.dumps(block)))
            block, chars = [], 0
    return blocks + [zlib.compress(pickle.dumps(block))] * bool(block)


def find_leaks(documents: DataFrame, items: DataFrame, k: int = 12, offsets: bool = True, block_chars: int = BLOCK_CHARS, spool_words: int = SPOOL_WORDS) -> DataFrame:
    """One row a document, item and stretch of at least ``k`` words that both share.

    Columns ``doc_id, item_id, first_word, n_words`` and, with ``offsets``,
    ``start_char, end_char`` in the stored text. Items of fewer than ``k`` words and
    NULL or empty texts have no stretches; an item twice under different ids gives two
    rows; whole texts are read, however long.

    Documents are read and cut into words once, whatever the number of items: up to
    ``spool_words`` words wait while one automaton after the other passes over them. A
    worker holds the items (held-out material) packed, and one automaton.
    """
    spark = documents.sparkSession
    ship(spark)
    blocks = _blocks(items.where("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text"), block_chars)
    held, keys = spark.sparkContext.broadcast(blocks), [hashlib.md5(b).hexdigest() for b in blocks]
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "first_word", "n_words", *(("start_char", "end_char") if offsets else ()))])

    def passages(i: int) -> Passages:
        key = (keys[i], k)
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = Passages(pickle.loads(zlib.decompress(held.value[i])), k)
        return _MADE[key]

    def leaks(i: int, doc: int, text: str, found: list[str]) -> list[tuple]:
        spans = passages(i).hits(found)
        at = stored_offsets(text) if spans and offsets else None
        return [(doc, item, a, b - a + 1, *((at[a][0], at[b][1]) if at else ())) for item, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64()) for _ in schema], schema=schema)

        spool, waiting = [], 0
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text := text.as_py())
                if len(keys) == 1:
                    out += leaks(0, doc, text, found)
                elif keys:
                    spool.append((doc, text, " ".join(found)))
                    waiting += len(found)
                    if waiting > spool_words:
                        out += [r for i in range(len(keys)) for x, y, z in spool for r in leaks(i, x, y, z.split())]
                        spool, waiting = [], 0
            yield made(out)
        yield made([r for i in range(len(keys)) for x, y, z in spool for r in leaks(i, x, y, z.split())])

    return documents.where("text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} bigint" for n in schema.names))
