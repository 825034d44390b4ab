import hashlib
from collections import Counter
from math import floor

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from quorumtab.llm import quality_rules
from tests.llm.test_ngram_join import brute

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SIZE = lambda t: len((t or "").encode().split())


def plain_mix(docs):
    """Documents as often as the mix takes them: the targets by repeated sharing."""
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += SIZE(t)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    out = []
    for d, t, s in docs:
        rate = target[s] / sizes[s] if sizes[s] else 0
        draw = int(hashlib.md5(f"{d}:mix-1".encode()).hexdigest()[:8], 16) / 2**32
        out += [(d, t)] * (floor(rate) + (draw < rate - floor(rate)))
    return out


def test_stages_equal_brute_force(spark, duck):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    duck.execute("CREATE SCHEMA IF NOT EXISTS tiny")
    duck.execute("CREATE OR REPLACE VIEW tiny.documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    duck.execute("SET schema = 'tiny'")
    cur = duck.execute(quality_rules.ORACLE)
    names = [d[0] for d in cur.description]
    ok = {r[names.index("doc_id")] for r in cur.fetchall() if r[names.index("kept")]}
    duck.execute("SET schema = 'main'")
    left = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        if r.doc_id in ok:
            left[(r.text or "").translate(LOWER)] = (r.doc_id, r.text, r.source)
    left = list(left.values())
    classes = {d: c for d, c, _ in brute([(d, t) for d, t, _ in left])}
    left = [x for x in left if classes[x[0]] == x[0]]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = sorted((d, tok.encode(t, add_special_tokens=False).ids) for d, t in plain_mix(left))
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(want) == len(got)
    assert sorted((r.doc_id, r.ids) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name


def test_nulls_repeats_and_clashing_columns(spark):
    words = lambda i, n=40: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(1, None, "en", "a", 0, "p"), (2, "", "en", "a", 0, "p"), (3, words(3), "en", None, 0, "p"), (3, words(3), "en", None, 0, "p"), (4, words(4), None, "b", 0, "p"),
            (5, words(4).upper(), "en", "b", 0, "p"), (None, words(6), "en", "b", 0, "p"), (7, words(7), "en", "b", 0, "p"), (8, words(7) + " and one", "en", "b", 0, "q"), (9, words(9, 5000), "en", "c", 0, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, other string").withColumnRenamed("other", "Key")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "Key"], name
    assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted([3, 5, None, 7, 9], key=str)
    mixed = corpus_pipeline.mix(spark, docs, "")
    out = corpus_pipeline.encode(spark, mixed, "").collect()
    assert len(out) == mixed.count() and {r.doc_id for r in out} <= {3, 5, None, 7, 9}
