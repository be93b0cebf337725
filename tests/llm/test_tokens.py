import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spatialrank.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = [" ", "  ", "\n", "\t", "\r\n", "'", "'s", "'re", "'ll", "'d", "s", "re", "é", "ñ", "Ünder", "the", " the", "12", " 3", "!", "&&&", " ", "日本", "\U0001f600", "<|endoftext|>", " ", "x" * 40, "²"]


def check(texts):
    ids, counts = tokens.encoder(PATH).ids(pa.array(texts, pa.string()))
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.text(max_size=30)), min_size=1, max_size=6))
def test_same_ids_as_the_library(texts):
    check(texts)


def test_long_text_and_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 50)
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeé "), 7))
    check([" ".join(word() for _ in range(3000)), None, "", "a" * 5000, " ".join(word() for _ in range(500))])


def test_end_is_added_after_each_document():
    ids, counts = tokens.with_end(np.array([5, 6, 7], np.uint32), np.array([2, 0, 1]), 2)
    assert ids.tolist() == [5, 6, 2, 2, 7, 2] and counts.tolist() == [3, 1, 2]
