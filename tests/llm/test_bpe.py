import hashlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer as Reference  # noqa: E402

from llm_helpers import DATA  # noqa: E402
from panelspark.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", "Hello <|endoftext|>it's 12 Σας ΣΑΣ\x1cfoo  !!x", "日本語 İstanbul é   12½ ab'S we'll x\x85y ​ z  don't aaaaaaa aaaa 🤣🤣 ﬁ", "a" * 300, "ananananan", "<|startoftext|><|endoftext|> <|endof", "\x00\x01 ퟿\U0010ffff", "é ñ"]


def test_automaton_on_a_small_vocabulary():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "ab", "bc", "aa", "abc"])}
    m = bpe.Automaton(vocab, [("a", "b"), ("b", "c"), ("a", "a"), ("ab", "c")])
    spell = lambda w: [m.label[i] for i in m.path(w, "")]
    assert spell("abc") == ["abc"] and spell("bcbc") == ["bc", "bc"] and spell("aaa") == ["aa", "a"] and spell("aab") == ["a", "ab"]
    with pytest.raises(ValueError):
        m.path("x", "")


def test_encodes_and_decodes_as_the_library():
    ref, mine = Reference.from_file(PATH), bpe.Tokenizer(PATH)
    import pyarrow.parquet as pq

    texts = HARD + [t for t in pq.read_table(f"{DATA}/sf0.001/documents.parquet").column("text").to_pylist() if t]
    for text, want in zip(texts, ref.encode_batch(texts, add_special_tokens=False)):
        ids = mine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:50]
        assert mine.decode(ids) == ref.decode(want.ids, skip_special_tokens=False)


def test_every_code_point():
    """Beside letters, digits and marks, as the library does."""
    ref, mine = Reference.from_file(PATH), bpe.Tokenizer(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or c % 97 == 0 or 0xE0000 <= c < 0xE0200)]
    for a in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}." for c in points[a : a + 20_000]]
        for text, want in zip(texts, ref.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(mine.encode(text), "<u4").tolist() == want.ids, ascii(text)


def test_documents(odd, odd_rows, empty):
    ref = Reference.from_file(PATH)
    got = bpe.encode_documents(odd, PATH, with_ids=True).collect()
    want = sorted(((d is None, d or 0, hashlib.sha256(np.array(ref.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for d, t, *_ in odd_rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256) for r in got) == want
    assert all(len(r.ids) == r.n_tokens for r in got) and bpe.encode_documents(empty, PATH).count() == 0


def test_other_scripts_cost_no_more_than_twice():
    """Per word: the tests for rare characters are a look at each character, not a search of a large class."""
    import time

    mine = bpe.Tokenizer(PATH)
    plain = " ".join(["stone river", "under the bridge"] * 4_000)
    other = plain.replace("stone", "st\u00f6ne")

    def took(text):
        mine.encode(text)
        began = time.process_time()
        for _ in range(5):
            mine.encode(text)
        return time.process_time() - began

    assert min(took(other) for _ in range(3)) <= 2 * min(took(plain) for _ in range(3))
