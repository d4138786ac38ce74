"""Ids of texts with the tokenizer file's added tokens."""

import public_tokenizers
from tokenizers import Tokenizer

from quillspan.llm.subwords import encode
from quillspan.llm.token_counts import TOKENIZERS

TEXTS = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", " <|endoftext|>\n\n x", "<|endoftext|", "<|ENDOFTEXT|>", "no token", "é<|endoftext|>日本 <|endoftext|>"]


def test_same_ids_as_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in TEXTS:
        want = t.encode(text, add_special_tokens=False).ids
        assert encode(text).tolist() == want
        assert TOKENIZERS["byte_bpe_50k@1"](text) == len(want)
    assert 50256 in encode(TEXTS[0]).tolist()
