"""Runs are given to the tokenizers library many at once, those with numerals too, and get the ids that they get alone."""

from __future__ import annotations

import pyarrow as pa

from tilewright.llm.token_files import WordCoder, default_tokenizer


class Counted:
    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **named):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **named)


def test_runs_with_numerals_are_joined():
    coder = WordCoder(default_tokenizer())
    coder.library = Counted(coder.library)
    runs = [f"{a}{i}{b}" for i in range(150) for a, b in (("x", "y,"), ("(0", "٣"), ("一〇", "①"), ("é", "'s"))] + ["plain", "é", "́", "一"]
    got = coder._fresh(runs)
    assert coder.library.texts < 10
    assert got == coder._each(runs)


def test_runs_that_hold_a_mark():
    coder = WordCoder(default_tokenizer())
    texts = pa.array(["a|1 | |7 0 00 b0", "", " \n", "1| x", "<|endoftext|> 0<|startoftext|>"])
    ids, lengths = coder.encode(texts, 1)
    wanted = [[*coder.library.encode(t, add_special_tokens=False).ids, 1] for t in texts.to_pylist()]
    assert lengths.tolist() == [len(w) for w in wanted] and ids.tolist() == sum(wanted, [])
    assert coder.encode(texts.slice(3, 1), 1)[0].tolist() == wanted[3] and coder.encode(texts.slice(0, 0), 1)[0].tolist() == []
