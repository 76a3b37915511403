"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised (A-Z in lower case, words of letters and digits
joined by one blank) and cut into windows of ten words; an item of fewer words
is one window.  All windows go into one automaton and each text is scanned once
after the same normalisation.  A match is a place in the normalised text; it is
mapped to word numbers and, for the texts that have matches, to places in the
original.

The items are sent to every executor, so their size is checked first: more than
``most_words`` words (some 200 MB of automaton at the default) are refused, to be
scanned in parts.

Defined results: NULL and empty texts have no words and no matches; NULL and
empty items have no window; repeated items with one id are one item; an item without an id is
ignored; repeated documents are each scanned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyweave.llm.common import UPPER

#: Bytes that separate words: everything below 128 but digits and letters.
APART = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: Lower case, and a blank for each separator.  Every byte stays one byte.
PLAIN = bytes.maketrans(APART + UPPER.encode(), b" " * len(APART) + UPPER.lower().encode())
WINDOW = 10


def words_of(text: str | None) -> list[bytes]:
    """Normalised words.  The table leaves no white space but blanks, so split() cuts at blanks only."""
    return (text or "").encode().translate(PLAIN).split()


class Windows:
    """The automaton over all windows of the items, in terms of the numbers of their words."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(words) - size + 1) if words else 0):
                ids = owners.setdefault(tuple(words[i : i + size]), [])
                if item not in ids:
                    ids.append(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in owners.items():
            self.machine.add_word(window, (len(window), ids))
        if owners:
            self.machine.make_automaton()

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, disjoint stretches of hit words (first, behind the last), and the items found."""
        words = words_of(text)
        # 0 stands for every word that no item has; it is in no window.
        line = tuple(map(self.numbers.get, words, repeat(0)))
        spans, items = [], set()
        if self.numbers and any(line):
            for end, (length, ids) in self.machine.iter(line):
                spans.append((end + 1 - length, end + 1))
                items.update(ids)
        merged: list[tuple[int, int]] = []
        for first, last in sorted(spans):
            if merged and first <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], last))
            else:
                merged.append((first, last))
        return len(words), merged, sorted(items)


def original_places(text: str, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches as character places in the original text."""
    raw = text.encode()
    starts, ends, at = [], [], 0
    for word in raw.translate(PLAIN).split(b" "):
        if word:
            starts.append(at)
            ends.append(at + len(word))
        at += len(word) + 1
    chars = lambda b: len(raw[:b].decode())
    return [(chars(starts[a]), chars(ends[b - 1])) for a, b in stretches]


FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())),
        StructField(
            "spans",
            ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])),
        ),
    ]
)


def benchmark_items(benchmark: DataFrame, most_words: int = 500_000) -> list[tuple[str, str]]:
    """(id as string, text) of the items; refuses a table too large to be sent to every executor."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0]
    if (words or 0) > most_words:
        raise ValueError(f"{words} benchmark words: scan them in parts of {most_words}")
    return [(str(i), t) for i, t in items.select("item_id", "text").collect()]


def scan(docs: DataFrame, benchmark: DataFrame, column: str = "found", size: int = WINDOW) -> DataFrame:
    """``docs`` with a struct: words, hit words, items found (ids as strings, sorted) and character spans.

    The items are the stated query set; every whole text is held against all of them.
    """
    if column in docs.columns:
        raise ValueError(f"{column} is a column already")
    shared = docs.sparkSession.sparkContext.broadcast(benchmark_items(benchmark))
    kind = to_arrow_type(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, size)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n, stretches, items = windows.find(text)
                places = original_places(text, stretches) if stretches else []
                rows.append(
                    {
                        "n_words": n,
                        "n_hit": sum(b - a for a, b in stretches),
                        "items": items,
                        "spans": [{"start": a, "end": b} for a, b in places],
                    }
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, column]
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, FOUND)]))
