import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assaykit.llm.token_counts import PreTokens, count_tokens

from .helpers import corpus, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def definition():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_counts_are_the_librarys(spark, definition):
    rng = random.Random(5)
    odd = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "  lead", "tail  ", "\n\n\n x", "it's 'T we'll", "ʼn İ ß ﬁ 한국어 日本 🙂👍🏽 ​ ", "\x00\x1c\x85\xa0", "x" * 5000, "é" * 3000, " " * 700]
    texts = [t for _, t in corpus(5)] + odd + ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0x1F300, 0x1FA00), 0x20])) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rows = [(None if i == 3 else i % 70, t) for i, t in enumerate(texts)]
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    for block in (300, 1 << 22):
        got = count_tokens(docs(spark, rows), definition, block_bytes=block).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pattern_agrees_with_the_library_below_0240(definition):
    cut, rng = PreTokens(definition), random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice([chr(rng.randrange(0x240)), rng.choice(" \n'st\t ")]) for _ in range(rng.randint(1, 12)))
        assert cut.find(text) == [text[a:b] for _, (a, b) in cut.library.pre_tokenizer.pre_tokenize_str(text)]


def test_empty_table_and_unsupported_tokenizer(spark, definition):
    assert count_tokens(docs(spark, [(1, "a")]).limit(0), definition).count() == 0
    with pytest.raises(ValueError):
        PreTokens('{"pre_tokenizer": {"type": "Whitespace"}, "added_tokens": []}')
