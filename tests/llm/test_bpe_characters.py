"""Every character as the library encodes it, and what is shown of a text."""

import pytest
from tokenizers import Tokenizer

from tallyweave.llm import bpe
from tests.llm.test_operators import ODD, VOCABULARY, documents


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.mark.parametrize("shape", ["{}", "a{}b", "e{}́"])
def test_all_characters_as_the_library(library, shape):
    # Planes beyond the third hold tags, selectors and private use only.
    codes = [c for c in [*range(0x30000), *range(0xE0000, 0xE0200), 0x10FFFD] if not 0xD800 <= c < 0xE000]
    if shape != "a{}b":
        codes = [c for c in codes if c < 0x10000]
    codec = bpe.Codec(bpe.Vocabulary(VOCABULARY))
    texts = [shape.format(chr(c)) for c in codes]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [hex(c) for c, t, w in zip(codes, texts, want, strict=True) if codec.encode(t) != w.ids] == []


def test_shown_texts_are_ids_and_decoded_text(library):
    codec = bpe.Codec(bpe.Vocabulary(VOCABULARY), most=5)
    special = sorted(codec.vocabulary.special)
    texts = [*ODD, "Ünï ΣΑΣ İ x9", *special, f"a{special[0]}b  {special[-1]}", "​  ", "ab" * 3000, "the quick " * 40]
    for t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.shown(t) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))


def test_no_rows(spark):
    assert bpe.encode_and_decode(documents(spark, []), VOCABULARY).collect() == []
