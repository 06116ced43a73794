"""Operator 1, LM scoring: subword lattice likelihood.

The pieces of a public sentencepiece vocabulary span every word as a lattice: a piece that
begins with the word mark opens a word, others go on, single bytes spell what no piece covers,
and a stop closes it. One more arc spans a training word as a whole. A text is a sequence of
words and one end, so its probability is the product over its words of the sum over all paths;
the sum over the segmentations is a forward recursion in log space over the byte positions.

Weights: a word met c times in N training tokens has (c - d) / N on its whole arc, d being the
absolute discount n1 / (n1 + 2 n2); what is taken off, d V / N, is the weight of all spelled
paths. The vocabulary is fixed. Its scores (ranks, in this file) give the pieces' first weights;
``rounds`` of expectation maximisation over the distinct training words then fit their
probabilities, the first weights staying as a prior, so no piece gets probability 0. All words
and ends together sum to 1.

Scale: texts are cut into blocks of neighbouring rows (about ``BLOCK_BYTES`` each). A block sends
each of its distinct words once; word counts are summed by Spark, every distinct word's
lattice is summed once, and what a block needs to score its texts comes back to it by joining
on words (one row a word on that side, so a common word's rows can be split) and cogrouping by
block. What is broadcast is the vocabulary; what the driver gets is a row a piece.

Edge cases: a null or empty text is the end alone; words of any length and script have a
probability above 0; with no training text only spelled paths score and N is 0; a null doc_id
counts as the empty text for its fold; repeated rows get equal rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ASCII_LOWER, crc_fold, stored, utf8

VOCABULARY = "piece_bpe_32k.model"
BLOCK_BYTES, ROUNDS = 12 << 20, 3
#: Weight of the first scores against the training words, in pieces.
PRIOR = 2000.0
_SPACES = {9, 10, 11, 12, 13, 32}


class Vocabulary:
    """Pieces as bytes in a trie of sorted (node, byte) keys, with their first weights."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                if b not in _SPACES:
                    pieces.setdefault(bytes([b]), -float(sp.get_piece_size()))
                continue
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            raw = piece.replace("▁", " ").encode()
            if b" " in raw[1:] or raw.lower() != raw or any(c in _SPACES for c in raw[1:]):
                continue
            pieces[raw] = max(sp.get_score(i), -float(sp.get_piece_size()))
        pieces.setdefault(b" ", -float(sp.get_piece_size()))
        self.pieces = list(pieces)
        self.end = len(self.pieces)  # the stop's index
        self.opens = np.array([p[0] == 32 for p in self.pieces] + [False])
        weight = 1 / (100 - np.array(list(pieces.values())))
        self.first = self.normal(np.append(weight, weight.sum() / 4))
        children: dict[tuple[int, int], int] = {}
        terminal = [-1]
        for i, p in enumerate(self.pieces):
            node = 0
            for b in p:
                node = children.setdefault((node, b), len(terminal))
                if node == len(terminal):
                    terminal.append(-1)
            terminal[node] = i
        keys = np.array([(n << 8) | b for n, b in children], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(children.values()), np.int64)[order]
        self.terminal = np.array(terminal, np.int64)

    def normal(self, weight: np.ndarray) -> np.ndarray:
        """Opening pieces sum to 1, and so do all others with the stop."""
        return weight / np.where(self.opens, weight[self.opens].sum(), weight[~self.opens].sum())

    def arcs(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces on all words: (position they start at, position they end at, piece). The words lie in ``data``, each after its mark."""
        at = np.arange(len(data))
        stop = np.repeat(begin + size, size)
        node = np.zeros(len(data), np.int64)
        pos = at.copy()
        out = []
        while len(at):
            key = (node << 8) | data[pos]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            at, pos, node = at[hit], pos[hit] + 1, self.child[k[hit]]
            piece = self.terminal[node]
            full = piece >= 0
            out.append((at[full], pos[full], piece[full]))
            go = pos < stop[at]
            at, pos, node = at[go], pos[go], node[go]
        return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))


def _log_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(values, first)
    sizes = np.diff(np.append(first, len(values)))
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, sizes)), first))


class Lattices:
    """The lattices of many words at once."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.n = len(words)
        self.size = np.array([len(w) + 1 for w in words], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        data = np.frombuffer(b"".join(b" " + w for w in words), np.uint8).astype(np.int64)
        start, end, piece = vocabulary.arcs(data, self.begin, self.size)
        # slots: one more than bytes a word, so that every word has its own last position
        word = np.repeat(np.arange(self.n), self.size)[start]
        self.slot = np.cumsum(self.size + 1) - (self.size + 1)
        self.start = start - self.begin[word] + self.slot[word]
        self.end = end - self.begin[word] + self.slot[word]
        self.piece, self.depth = piece, end - self.begin[word]
        self.total = int((self.size + 1).sum())
        # groups of arcs that end at the same depth, and in them runs with one end
        self.order = np.lexsort((self.end, self.depth))

    def _sweep(self, logp: np.ndarray, here: np.ndarray, there: np.ndarray, depth: np.ndarray, order: np.ndarray, init: np.ndarray, reverse: bool) -> np.ndarray:
        value = np.full(self.total, -np.inf)
        value[init] = 0.0
        lp, h, t, d = logp[self.piece][order], here[order], there[order], depth[order]
        edges = np.flatnonzero(np.diff(d)) + 1
        bounds = [0, *edges.tolist(), len(d)]
        steps = list(zip(bounds[:-1], bounds[1:], strict=True))
        for a, b in reversed(steps) if reverse else steps:
            if a == b:
                continue
            x = value[t[a:b]] + lp[a:b]
            ends = h[a:b]
            first = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            with np.errstate(divide="ignore", invalid="ignore"):
                s = _log_sum(np.maximum(x, -1e300), first)
            value[ends[first]] = np.where(s < -1e299, -np.inf, s)
        return value

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log forward values of all slots; the word's own is at slot + size."""
        return self._sweep(logp, self.end, self.start, self.depth, self.order, self.slot, False)

    def marginals(self, logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, stop included, over all its segmentations."""
        return self.forward(logp)[self.slot + self.size] + logp[-1]

    def expected(self, logp: np.ndarray, counts: np.ndarray, n_pieces: int) -> np.ndarray:
        """Expected uses of every piece in ``counts`` copies of the words (forward-backward)."""
        ahead = self.forward(logp)
        word = np.searchsorted(self.slot, self.start, side="right") - 1
        from_depth = self.start - self.slot[word]
        order = np.lexsort((self.start, from_depth))
        back = self._sweep(logp, self.start, self.end, from_depth, order, self.slot + self.size, True)
        whole = ahead[self.slot + self.size]
        with np.errstate(invalid="ignore"):
            share = np.exp(ahead[self.start] + logp[self.piece] + back[self.end] - whole[word])
        return np.bincount(self.piece, np.nan_to_num(share) * counts[word], n_pieces)


_LOADED: dict[str, Vocabulary] = {}


def loaded(vocabulary: str = VOCABULARY) -> Vocabulary:
    import public_tokenizers

    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = Vocabulary(public_tokenizers.path(vocabulary))
    return _LOADED[vocabulary]


def _batches(words: list[bytes], limit: int = 400_000):
    """Slices of words of about ``limit`` bytes, shorter words first, so that a sweep is as deep as its words are long."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = total = 0
    for j, i in enumerate(order):
        total += len(words[i]) + 1
        if total >= limit:
            yield order[at : j + 1]
            at, total = j + 1, 0
    if at < len(order):
        yield order[at:]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ASCII_LOWER).split() if text else []


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, train and the block of neighbouring rows of one file that the row belongs to."""
    place = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")]
    try:
        placed = docs.select("doc_id", "text", *place)
    except AnalysisException:  # no file source underneath
        placed = stored(docs.select("doc_id", "text"), "texts").select("doc_id", "text", *place)
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    rows = max(1, min(100_000, int(block_bytes * max(size["n"], 1) / max(size["b"] or 1, 1))))
    block = F.xxhash64("f", F.floor(F.col("i") / rows))
    return placed.select("doc_id", "text", (crc_fold("doc_id", 5) != 1).alias("train"), block.alias("block"))


def block_words(blocks: DataFrame) -> DataFrame:
    """block, word, c (training tokens): a row for each distinct word of each block."""

    def run(batches):
        now, train, seen = None, Counter(), set()

        def flush():
            every = list(seen | train.keys())
            for k in range(0, len(every), 200_000):
                part = every[k : k + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(part), pa.int64()), pa.array(part, pa.binary()), pa.array([train.get(w, 0) for w in part], pa.int64())], names=["block", "word", "c"])

        for batch in batches:
            for b, t, learn in zip(batch.column(2).to_pylist(), utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if b != now:
                    if now is not None:
                        yield from flush()
                    now, train, seen = b, Counter(), set()
                if t:
                    (train if learn else seen).update(words_of(t))
        if now is not None:
            yield from flush()

    return blocks.select("text", "train", "block").mapInArrow(run, "block long, word binary, c long")


def fit(words: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of all pieces and the stop, after ``rounds`` over the distinct training words (word, c)."""
    v = loaded(vocabulary)
    p = v.first
    trained = words.where(F.col("c") > 0)
    for _ in range(rounds):
        logp = np.log(p)

        def expect(batches, logp=logp):
            own = loaded(vocabulary)
            sums = np.zeros(own.end + 1)
            for batch in batches:
                ws = batch.column(0).to_pylist()
                for at in _batches(ws):
                    sums += Lattices(own, [ws[i] for i in at]).expected(logp, np.ones(len(at)), own.end + 1)
                sums[own.end] += len(ws)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["piece", "e"])

        got = trained.select("word").mapInArrow(expect, "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()
        e = v.first * PRIOR
        e[got["piece"].to_numpy()] += got["e"].to_numpy()
        p = v.normal(e)
    return np.log(p)


def score(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    blocks = in_blocks(docs)
    pairs = stored(block_words(blocks), "block-words")
    words = stored(pairs.groupBy("word").agg(F.sum("c").alias("c")), "words")
    ends = blocks.where("train").count()  # every training text has one end
    sums = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    logp = fit(words, vocabulary, rounds)
    d, log_n = 0.0, 0.0
    if n:
        once, twice = (words.where(F.col("c") == k).count() for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        spelled, end = d * v / n, max(ends - d, 0.5 * ends) / n
        log_n = float(np.log(n))
    else:
        spelled = end = 0.5
    shared = spark.sparkContext.broadcast(logp)

    def lattice(batches):
        own = loaded(vocabulary)
        for batch in batches:
            ws = batch.column(0).to_pylist()
            out = np.zeros(len(ws))
            for at in _batches(ws):
                out[at] = Lattices(own, [ws[i] for i in at]).marginals(shared.value)
            c = batch.column(1).to_numpy()
            with np.errstate(divide="ignore"):
                out = np.logaddexp(out + np.log(spelled), np.log(np.maximum(c - d, 0)) - log_n) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["word", "c", "lp"])

    valued = words.mapInArrow(lattice, "word binary, c long, lp double")
    values = pairs.select("block", "word").join(valued, "word")
    log_all = float(np.log10(n + 0.5 * (v + 1)))
    base_end, lp_end, known_end = float(np.log10(ends + 0.5)) - log_all, float(np.log10(end or spelled)), int(ends > 0)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def block(texts: pa.Table, vals: pa.Table) -> pa.Table:
        index = {w: i for i, w in enumerate(vals.column("word").to_pylist())}
        c = vals.column("c").to_numpy()
        base, lp, known = np.log10(c + 0.5) - log_all, vals.column("lp").to_numpy(), c > 0
        rows = []
        for t in utf8(texts.column("text")):
            at = np.array([index[w] for w in words_of(t)], np.int64)
            rows.append((len(at) + 1, int(known[at].sum()) + known_end, float(base[at].sum()) + base_end, float(lp[at].sum()) + lp_end))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table([texts.column("doc_id"), pa.array([not x for x in texts.column("train").to_pylist()], pa.bool_()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([n] * texts.num_rows, pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(block, schema)


def op1_lattice_score(docs: DataFrame) -> DataFrame:
    """The thin query: learns where crc32(doc_id) mod 5 is not 1, scores every text."""
    return score(docs)
