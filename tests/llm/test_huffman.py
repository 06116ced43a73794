import heapq
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tickloom.llm import huffman as H


def _plain(counts):
    heap = [(int(c), i, [i]) for i, c in enumerate(counts) if c]
    depth = {i: 0 for _, i, _ in heap}
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            depth[i] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return depth


def test_lengths_are_best_and_limited():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 1000, 300)
    lengths = H.code_lengths(counts)
    best = _plain(counts)
    assert max(best.values()) <= 16 and sum(counts[i] * d for i, d in best.items()) == (counts * lengths).sum()
    steep = np.array([2**min(i, 50) for i in range(60)])
    lengths = H.code_lengths(steep)
    assert lengths.max() <= 16 and sum(2.0 ** -int(x) for x in lengths) <= 1
    assert H.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 257, 5000):
        ids = (rng.pareto(0.7, n) * 3).astype(np.int64) % 40_000
        coder = H.Coder(H.code_lengths(np.bincount(ids, minlength=40_000)))
        back, sizes = H.unpack(H.pack(ids, np.array([n]), coder))
        assert (back == ids).all() and sizes.tolist() == [n]


def test_ids_are_the_librarys(spark):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = ["", " ", "Hello  WORLD\n\nit's <|endoftext|>x y<|startoftext|> z", "ä é b  c", "ẛ̣ 'S don't\t'll", "x" * 3000, "\x1c a \x85 b", "İstanbul DŽ ΑΣ Σ", "a.b. C,, D!!! ### ..x.. é. ١. x<|endoftext|>. <|endoftext|>", "it's. THE'S, O''re'. (a) [b]; e\u0301. x\u0338. <\u0338 a<\u0338"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(None, None)] + [(10_000 + i, x) for i, x in enumerate(odd)] + [(5, "same"), (5, "same")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in H.op4_huffman_ids(docs).collect()), key=lambda r: r[2])
    rows = [(r.doc_id is not None, r.doc_id or 0, [*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2]), zlib.crc32(np.array(r[2], "<u2").tobytes())))
    start, want = 0, []
    for a, b, ids in rows:
        want.append((a, b, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert H.op4_huffman_ids(docs.limit(0)).count() == 0
