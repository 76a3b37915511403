"""BPE encoding and decoding with cuts that are certain before any merge is made.

A pair of neighbouring symbols that stands inside no token of the vocabulary can
never be merged across, so a word may be cut there and its fragments encoded by
themselves; their ids, one after the other, are the word's.  The cuts split what
is unusual about a word into short common fragments, whose ids are remembered.

The vocabulary file is the one of a public tokenizer (its path is a parameter):
NFC, white space, lower case, a pattern that finds words, bytes as characters,
merges with an end-of-word mark.  Without a decoder the file's tokens are joined
by blanks, and special tokens in a text are taken as such.

Defined results: NULL is an empty text, an empty text has no ids and decodes to an empty
one; very long words are encoded in time n log n; repeated rows are each
encoded; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer

#: White space as the vocabulary's own pattern understands it.
BLANK = r"[\t-\r\x20\x85\xa0  -     　]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Merges, ids and certain cuts of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.mark: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        # Normalising and the classes of letters beyond ASCII follow the library's own tables of characters.
        self.rules = Tokenizer.from_file(path)
        symbols = byte_symbols()
        #: Characters of one byte in Latin-1, as the symbols of their bytes in UTF-8.
        self.spelling = {c: "".join(symbols[b] for b in chr(c).encode()) for c in range(256)}
        self.size = max(self.tokens, default=-1) + 1
        self.joined = self.joinable()

    def spelled(self, token: str) -> list[str]:
        """A token's symbols; the last of a word's end carries the mark."""
        if self.mark and token.endswith(self.mark) and token != self.mark:
            bare = token[: -len(self.mark)]
            return [*bare[:-1], bare[-1] + self.mark]
        return list(token)

    def joinable(self) -> set[tuple[str, str]]:
        """Neighbouring symbols inside any token that merges can make; all other pairs are certain cuts."""
        made = {a + b for a, b in self.ranks}
        return {pair for token in made for s in [self.spelled(token)] for pair in zip(s, s[1:], strict=False)}

    def spelled_words(self, piece: str) -> list[str]:
        """The words of a piece without white space, each as symbols of its bytes.

        Latin-1 has no characters that compose, and its letters and cases are the same everywhere.
        """
        if piece.isascii():
            words = self.words.findall(piece.lower())
            # What can be printed stands for itself.
            return words if piece.isprintable() else [w.translate(self.spelling) for w in words]
        if max(piece) < "\u0100":
            return [w.translate(self.spelling) for w in self.words.findall(piece.lower())]
        plain = self.rules.normalizer.normalize_str(piece)
        return [w for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(plain)]

    def fragments(self, word: str) -> list[str]:
        """A word's symbols cut where no token can lie across; a blank, which is no symbol, marks the word's end."""
        joined = self.joined
        cuts = [k for k, pair in enumerate(zip(word, word[1:-1]), 1) if pair not in joined]  # noqa: B905
        if len(word) > 1 and (word[-2], word[-1] + self.mark) not in joined:
            cuts.append(len(word) - 1)
        word += " "
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def merge_fragment(self, fragment: str) -> list[int]:
        """Ids of a fragment as ``fragments`` writes it."""
        if fragment.endswith(" "):
            return self.merge((*fragment[:-2], fragment[-2] + self.mark))
        return self.merge(tuple(fragment))

    def merge_few(self, symbols: tuple[str, ...]) -> list[str]:
        """As ``merge``, by looking through all pairs each time: quicker for short fragments."""
        part, rank, none = list(symbols), self.ranks.get, len(self.ranks)
        ranks = [rank(pair, none) for pair in zip(part, part[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((part[i - 1], part[i]), none)
            if i < len(ranks):
                ranks[i] = rank((part[i], part[i + 1]), none)
        return part

    def merge(self, symbols: tuple[str, ...], few: int = 32) -> list[int]:
        """Ids of a fragment: the pair of lowest rank first, of equal ones the leftmost."""
        if len(symbols) <= few:
            symbols = self.merge_few(symbols)
        else:
            left = list(range(-1, len(symbols) - 1))
            right = [*range(1, len(symbols)), -1]
            part: list[str | None] = list(symbols)
            queue = [
                (self.ranks[pair], i)
                for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))
                if pair in self.ranks
            ]
            heapq.heapify(queue)
            while queue:
                rank, i = heapq.heappop(queue)
                j = right[i]
                if part[i] is None or j < 0 or self.ranks.get((part[i], part[j])) != rank:
                    continue  # what stood here has been merged meanwhile
                part[i] += part[j]
                part[j] = None
                right[i] = right[j]
                if right[i] >= 0:
                    left[right[i]] = i
                for a, b in ((left[i], i), (i, right[i])):
                    if a >= 0 and b >= 0 and (part[a], part[b]) in self.ranks:
                        heapq.heappush(queue, (self.ranks[part[a], part[b]], a))
            symbols = [p for p in part if p is not None]
        # A symbol that the vocabulary lacks has no id and is left out.
        return [self.ids[s] for s in symbols if s in self.ids]


class Memory(dict):
    """Remembers what ``compute`` gave for keys of bounded length: the latest ones, at most twice ``most``."""

    def __init__(self, compute, most: int, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def joined(shown: Iterable[tuple[str, str]]) -> tuple[str, str]:
    """Shown parts, one after the other; a part without ids leaves no blank."""
    kept = [x for x in shown if x[0]]
    return " ".join([x[0] for x in kept]), " ".join([x[1] for x in kept])


class Codec:
    """Encodes and decodes texts; remembers the ids of fragments, of words and of pieces between blanks."""

    def __init__(self, vocabulary: Vocabulary, most: int = 250_000):
        self.vocabulary = vocabulary
        self.pieces = Memory(self.piece, most)
        self.words = Memory(self.word, most)
        # Pieces and words as they are shown; only one of both kinds is ever filled by a query.
        self.shows = Memory(self.shown_piece, most)
        self.shown_words = Memory(self.shown_word, most)
        # Fragments recur more than pieces do: the cuts make rare words of common parts.
        self.fragments = Memory(vocabulary.merge_fragment, 2 * most)
        self.blanks = regex.compile(BLANK)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a word in symbols."""
        return tuple(chain.from_iterable(map(self.fragments.__getitem__, self.vocabulary.fragments(word))))

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece without white space; normalising and finding words never look across a blank."""
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.vocabulary.spelled_words(piece))))

    def shown_word(self, word: str) -> tuple[str, str]:
        """The ids of a word in decimal, and what they decode to."""
        ids = self.word(word)
        return " ".join(map(str, ids)), self.decode(ids)

    def shown_piece(self, piece: str) -> tuple[str, str]:
        """The ids of a piece in decimal, and what they decode to."""
        words = self.vocabulary.spelled_words(piece)
        if len(words) == 1:
            return self.shown_words[words[0]]
        return joined(map(self.shown_words.__getitem__, words))

    def cut(self, text: str) -> list[str]:
        """Pieces between white space."""
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
        return list(filter(None, self.blanks.split(text)))

    def ordinary(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.cut(text))))

    def parts(self, text: str) -> list[str]:
        """Special tokens and the stretches between them."""
        if self.specials is None or not self.specials.search(text):
            return [text]
        return list(filter(None, self.specials.split(text)))

    def shown(self, text: str | None) -> tuple[int, str, str]:
        """As ``encode`` and ``decode``: number of ids, the ids in decimal joined by blanks, and the decoded text.

        Pieces are remembered as they are shown, so a text is two joins over its pieces.
        """
        found: list[tuple[str, str]] = []
        for part in self.parts(text or ""):
            if part in self.vocabulary.special:
                found.append((str(self.vocabulary.special[part]), part))
            else:
                found += map(self.shows.__getitem__, self.cut(part))
        ids, decoded = joined(found)
        return ids.count(" ") + 1 if ids else 0, ids, decoded

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; special tokens are taken where they stand."""
        ids: list[int] = []
        for part in self.parts(text or ""):
            if part in self.vocabulary.special:
                ids.append(self.vocabulary.special[part])
            else:
                ids += self.ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks; an id without a token is left out."""
        try:
            return " ".join(map(self.vocabulary.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(filter(None, map(self.vocabulary.tokens.get, ids)))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One per worker process and file."""
    return Codec(Vocabulary(path))


IDS = pa.list_(pa.int32())


def encode(docs: DataFrame, path: str, column: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the ids of each whole text."""

    def values(batch: pa.RecordBatch) -> list[pa.Array]:
        code = codec(path)
        return [pa.array([code.encode(t.as_py()) for t in batch.column(text)], IDS)]

    return _each(docs, [StructField(column, ArrayType(IntegerType()))], values)


def decode(encoded: DataFrame, path: str, column: str = "decoded", ids: str = "ids") -> DataFrame:
    """``encoded`` with the text of each list of ids."""

    def values(batch: pa.RecordBatch) -> list[pa.Array]:
        code = codec(path)
        return [pa.array([code.decode(x.as_py() or []) for x in batch.column(ids)], pa.string())]

    return _each(encoded, [StructField(column, StringType())], values)


def encode_and_decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", text: str = "text") -> DataFrame:
    """``docs`` with ids and what they decode to, in one pass."""

    def values(batch: pa.RecordBatch) -> list[pa.Array]:
        code = codec(path)
        encoded = [code.encode(t.as_py()) for t in batch.column(text)]
        return [pa.array(encoded, IDS), pa.array(list(map(code.decode, encoded)), pa.string())]

    added = [StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())]
    return _each(docs, added, values)


def _each(df: DataFrame, added: list[StructField], values, rows: int = 256) -> DataFrame:
    """Adds columns by ``values`` of some rows at a time, so that few ids are Python objects at once."""
    names = [a.name for a in added]
    if {*names} & {*df.columns}:
        raise ValueError(f"{names}: a column has that name already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *values(part)], names=[*part.schema.names, *names]
                )

    return df.mapInArrow(run, StructType([*df.schema.fields, *added]))
