import hashlib
import random
import unicodedata

import pytest
from tokenizers import Tokenizer

from quorumtab.llm.bpe import Codec, encode, op6_bpe, vocabulary

TEXTS = [
    "", " \n\t ", "Hello WORLD's it'll <|endoftext|> don't<|startoftext|>x", "ΑΣ ΣΑΣ όσος İstanbul ǅ ﬁ Å é", "12345 ٣٤ ½ x²", "a\x1cb\x85c　d​e\xa0f",
    "😀👩‍👩‍👧 #$%^ <|endoftext|", "x" * 5000, "ab" * 3000, "é" * 2000 + "!" * 3000, "Á 각 ñ 힣", "<|ENDOFTEXT|> '<|endoftext|>'s", "'S 'T 'LL I'D",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_codec_equals_library(library):
    codec = Codec(open(vocabulary(), encoding="utf-8").read())
    rng = random.Random(5)
    pools = [range(0, 128), range(0, 0x250), range(0x370, 0x600), range(0x4E00, 0x4F00), range(0x1F300, 0x1F400), range(0x300, 0x370), range(97, 123)]
    made = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    made += ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(100, 600))) for _ in range(100)]
    made = ["".join(c for c in t if unicodedata.category(c) != "Cn") for t in made]
    for text in TEXTS + made:
        want = library.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert got == want, text
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_whole_table_equals_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = op6_bpe(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "a", 4)], "doc_id long, text string, ids int")
    assert sorted((str(r.doc_id), r.ids) for r in encode(df, vocabulary()).collect()) == [("1", []), ("1", []), ("None", [320])]
    assert encode(df.limit(0), vocabulary()).count() == 0
