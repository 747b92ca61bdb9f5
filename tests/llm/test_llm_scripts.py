"""Token counts of texts in any script."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from cairnfield.llm import token_counts
from cairnfield.llm.queries import BYTE_BPE

PATH = public_tokenizers.path(BYTE_BPE)
SIGNS = list("ab1' !\n\t“”’—…Привет世界你好　한글ह्िी٣५Ⅷ😀👍🏽 ​́ é𝒜𝟙") + ["'s", "'ll", "  ", " “", "don’t"]


def test_every_script_is_cut_like_the_library():
    rng = random.Random(6)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts.append(" ".join(map(chr, [*range(0x250, 0xD800, 7), *range(0xE000, 0x30000, 31)])))
    own = Tokenizer.from_file(PATH).pre_tokenizer
    chars, offsets = token_counts._chars(pa.array(texts))
    found = token_counts.pre_tokens(chars, offsets, token_counts._learn_classes(chars, own))
    assert found.tolist() == [int(o) + a for o, t in zip(offsets, texts) for _, (a, _) in own.pre_tokenize_str(t)]
    assert token_counts._without(pa.array(texts), ["<|endoftext|>"]).all()
    keys, _, spans, back, first = token_counts._keyed(pa.array(texts), own)
    assert len(back) == len(found) and len(np.unique(keys)) == len(spans)


def test_counts_of_every_script(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["мир <|endoftext|> “x”", None]
    library = Tokenizer.from_file(PATH)
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for table in (1, 65_536):
        assert sorted(map(tuple, token_counts.count_tokens(df, PATH, table_size=table).collect())) == expected
