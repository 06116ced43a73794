import base64
import random

import public_tokenizers as P
import tiktoken

from tickloom.llm.bpe import loaded, op3_byte_bpe


def _reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library():
    import numpy as np

    enc, bpe, rnd = _reference(), loaded("byte_bpe_50k.tiktoken"), random.Random(1)
    alphabet = ["a", "b", "th", "e", "ing", " ", "  ", "\n", "\n\n", "\t", " \n", "'s", "'ll", "'", "1", "23", "é", "ß", "日本", "🙂", "!", "###", " ", " ", "\x1c", "\x85", "\r\n", "٣", "ǆ", "<|endoftext|>"]
    texts = ["", " ", "\n", "a" * 5000, "é" * 700, "ab" * 40_000, "   x", "x   ", "a\n b", "a \nb", "a\n\n b\n"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    got = bpe.encode(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == enc.encode_ordinary(t), t[:80]
        assert bpe.decode(g) == t.encode()


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "hello world", None)], "doc_id long, text string, n_tokens string")
    rows = {(r.doc_id, r.n_tokens) for r in op3_byte_bpe(df).collect()}
    assert rows == {(1, 0), (2, 0), (None, 2)}
    assert op3_byte_bpe(df.limit(0)).count() == 0
