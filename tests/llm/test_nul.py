"""No character of a text is a mark of the encoder."""

from collections import Counter

import public_tokenizers
from odd import documents
from tokenizers import Tokenizer

from lectern.llm import bpe

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["a\0b", "\0abc", "abc\0", "\0", "\0\0 \0", "x \0<|endoftext|> y", "\0<|endoftext|>\0", "\0 <|endoftext|>", "<|startoftext|>\0a", "4\0 49407 \0" + "49407"]


def test_nul_equals_the_library():
    library = Tokenizer.from_file(WORD_FILE)
    for encoder in (bpe.TextEncoder(WORD_FILE), bpe.TextEncoder(WORD_FILE, limit=2, block=1)):
        for texts in (TEXTS, *([t] for t in TEXTS)):
            want = [library.encode(t, add_special_tokens=False).ids for t in texts]
            assert encoder.encode_batch(texts) == [
                (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)) for ids in want]


def test_documents_with_nul(spark):
    library = Tokenizer.from_file(WORD_FILE)
    got = bpe.encode_documents(documents(spark, [(i, t, "a") for i, t in enumerate(TEXTS)]), WORD_FILE).collect()
    assert Counter((r["doc_id"], r["ids"]) for r in got) == Counter(
        (i, " ".join(map(str, library.encode(t, add_special_tokens=False).ids))) for i, t in enumerate(TEXTS))
