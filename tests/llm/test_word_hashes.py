from hypothesis import given
from hypothesis import strategies as st

from quorumtab.llm.word_hashes import word_hashes


@given(st.lists(st.text(st.sampled_from("ab é\t\n\x0b\r"), max_size=12), max_size=30))
def test_equal_words_have_equal_hashes_and_others_not(texts):
    texts = [t.encode() for t in texts]
    counts, (low, high) = word_hashes(texts, second=True)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    for h in (low.tolist(), high.tolist()):
        assert len(h) == len(words) and len(set(zip(h, words))) == len(set(h)) == len(set(words))


def test_long_texts():
    texts = [b"ab cd " * 100_000, b"", b"cd", b" ab"]
    counts, (low,) = word_hashes(texts)
    assert counts.tolist() == [200_000, 0, 1, 1] and low[-2] == low[1] and low[-1] == low[0] and len(set(low.tolist())) == 2
