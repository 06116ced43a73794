"""Operator 2, quality rules: an n-gram perplexity band for each language.

A modified Kneser-Ney model of order 5 over whole code points (A-Z lower-cased, white space one
symbol, runs of one mark cut to one) is counted by Spark over all texts, two models for every
language (null is one of its own), and stored as arrays sorted by the 64-bit hash of the n-gram,
for each distinct n-gram of the texts. Each learns from half the language's distinct texts and
scores the others, so no text is foretold by itself. A model's n-grams meet in one worker when it
is made. Models of ``BROADCAST_BYTES`` in all are broadcast; larger ones are dealt to partitions with
their language's texts, in as many slots as a language has text for, each slot's model before its
texts. A text has two figures: the log perplexity of all
its symbols, and the median over its blocks of ``BLOCK`` symbols, which a foreign passage does
not move. It is rejected if both lie above (or both below) [q1 - width * iqr, q3 + width * iqr]
of their language, quartiles being taken over all texts that pass the base rules.

Base rules: see ``op2_quality_rules``. Windows are found by 64-bit hashes without misses, and
every text in which some hash repeats is counted again from its words, so results are exact.

Edge cases: a null or empty text has no words and fails the base rules; a language whose
texts all fail, or with one text, has no band and rejects nothing more; repeated rows get equal rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import map_batches, mix64, span_hashes, steps, stored, utf8

#: Symbols of an n-gram; bits of a code point.
ORDER, POINT_BITS = 5, 21
#: Models of more bytes in all travel with their language's texts in place of a broadcast; results are the same.
BROADCAST_BYTES = 64 << 20
#: Text of one slot, at least; distinct n-grams that a task holds before it sends their counts.
SLOT_BYTES, HELD = 256 << 10, 1 << 21
#: Words of a repeated window, as the contract fixes it.
WINDOW = 8
#: Quartile ranges that a band reaches beyond the quartiles.
BAND_WIDTH = 5.0
#: Symbols of a block.
BLOCK = 64


def _classes() -> np.ndarray:
    """Symbol class of each byte: 0 white space, 1-26 letters, 27 digits, 28-39 marks of their own, 40 other ASCII, 41-42 UTF-8 lead bytes, 43-58 continuation bytes."""
    t = np.full(256, 40, np.uint8)
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[97:123] = t[65:91] = np.arange(1, 27)
    t[48:58] = 27
    for i, mark in enumerate(b".,!?#*$%&|<>"):
        t[mark] = 28 + i
    t[192:] = 42
    t[0xC3] = 41
    t[128:192] = 43 + (np.arange(64) & 15)
    return t


CLASSES = _classes()


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes (18 bits) over classes of bytes, an alphabet small enough to sum over; the query's are those of ``grams``.

    A run of one white-space or mark class counts as one symbol, so that long runs, which are easy to foretell, don't pay for where they stand.
    """
    data = CLASSES[np.frombuffer(b"".join(b"~ " + t + b" " for t in texts), np.uint8)]
    once = np.ones(len(data), bool)
    once[1:] = (data[1:] != data[:-1]) | ((data[1:] > 0) & (data[1:] < 28)) | (data[1:] > 40)
    end = np.cumsum([len(t) + 3 for t in texts])
    once[0] = True
    once[end[:-1]] = True
    end = np.cumsum(once)[end - 1]
    size = np.diff(end, prepend=0) - 2
    data = data[once].astype(np.int32)
    tri = (data[:-2] << 12) | (data[1:-1] << 6) | data[2:]
    keep = np.ones(len(tri), bool)
    cut = end[:-1]
    keep[cut - 1] = False  # trigrams across two texts
    keep[cut - 2] = False
    return tri[keep], size


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all texts' code points as two integers (the last three, those before), and how many each text has.

    A text is preceded by order - 1 zeros and followed by a blank. A-Z are lower-cased, white space is a blank, and a run of one
    mark or of blanks counts as one symbol, so that long runs, which are easy to foretell, don't pay for where they stand.
    """
    pad = "\0" * (order - 1)
    plain = [t.decode("utf-8", "replace") for t in texts]
    data = np.frombuffer("".join([pad + t + " " for t in plain]).encode("utf-32-le"), np.uint32).astype(np.int64)
    kind = CLASSES[np.minimum(data, 127)]
    data = np.where(kind == 0, 32, np.where((data >= 65) & (data <= 90), data + 32, data))
    end = np.cumsum([len(t) + order for t in plain])
    once = np.ones(len(data), bool)
    once[1:] = (data[1:] != data[:-1]) | ((kind[1:] > 0) & (kind[1:] < 28)) | (data[1:] > 127)
    begin = np.append(0, end[:-1])
    for k in range(order):  # the zeros and what follows
        once[begin + k] = True
    end = np.cumsum(once)[end - 1]
    data = data[once]
    n = len(data) - order + 1
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(order):
        into = low if k >= order - 3 else high
        into <<= POINT_BITS
        into |= data[k : k + n]
    keep = np.ones(n, bool)
    for k in range(1, order):  # n-grams across two texts
        keep[end[:-1] - k] = False
    return low[keep], high[keep], np.diff(end, prepend=0) - order + 1


def _hash(order: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix64(low.astype(np.uint64) ^ mix64(high.astype(np.uint64) | np.uint64(order << 56)))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes (ascending), a place of each, the number of each place's hash, and how often each stands (np.unique sorts stably, which takes longer)."""
    o = np.argsort(h)
    ordered = h[o]
    new = np.ones(len(h), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start, of = np.flatnonzero(new), np.empty(len(h), np.int64)
    of[o] = np.cumsum(new) - 1
    return ordered[start], o[start], of, np.diff(np.append(start, len(h)))


def _suffix(low: np.ndarray, high: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The last n symbols."""
    return low & ((1 << bits * min(n, 3)) - 1), high & ((1 << bits * max(n - 3, 0)) - 1)


def _context(low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All symbols but the last."""
    return (low >> bits) | ((high & ((1 << bits) - 1)) << 2 * bits), high >> bits


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the wanted keys (0 if there is none), and which there are; ``keys`` ascend."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0.0), hit


@dataclass
class KneserNey:
    """For each order the n-grams' hashes (ascending) and log probabilities, and their contexts' hashes and log back-off weights."""

    bits: int
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]

    def logprob(self, low: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
        """Natural log of p(last symbol | those before) of n-grams."""
        high = np.zeros(len(low), np.int64) if high is None else high
        low = low.astype(np.int64)
        out, todo = np.zeros(len(low)), np.arange(len(low))
        for k in range(len(self.hashes), 0, -1):
            low, high = _suffix(low, high, k, self.bits)
            value, hit = _found(self.hashes[k - 1], self.logp[k - 1], _hash(k, low, high))
            out[todo] += value
            todo, low, high = todo[~hit], low[~hit], high[~hit]
            if not len(todo):
                break
            out[todo] += _found(self.contexts[k - 1], self.backoff[k - 1], _hash(k - 1, *_context(low, high, self.bits)))[0]
        out[todo] -= np.log(_alphabet(self.bits))
        return out


def _alphabet(bits: int) -> int:
    return 0x110000 if bits == POINT_BITS else 1 << bits


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    n = [float((counts == k).sum()) for k in range(1, 5)]
    if not n[0] or not n[1]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return np.clip(np.array(d), [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.8])


def kneser_ney(low: np.ndarray, count: np.ndarray, high: np.ndarray | None = None, order: int = 3, bits: int = 6) -> KneserNey:
    """Modified Kneser-Ney of distinct n-grams: their counts give the highest order, continuation counts the lower ones."""
    low, count = low.astype(np.int64), count.astype(np.float64)
    high = np.zeros(len(low), np.int64) if high is None else high.astype(np.int64)
    levels, suffix = [(low, high, count)], []
    for k in range(order - 1, 0, -1):  # of each (k + 1)-gram its last k symbols: their left contexts are counted
        x, y = _suffix(levels[-1][0], levels[-1][1], k, bits)
        _, first, of, n = _distinct(_hash(k, x, y))
        levels.append((x[first], y[first], n.astype(np.float64)))
        suffix.append(of)
    model = KneserNey(bits, [], [], [], [])
    p = np.full(1, 1 / _alphabet(bits))
    for k, (x, y, c) in enumerate(reversed(levels), 1):
        names, _, of, _ = _distinct(_hash(k - 1, *_context(x, y, bits)))
        cut = _discounts(c)[np.minimum(c, 3).astype(int)]
        total = np.bincount(of, c)
        gamma = np.bincount(of, cut) / total
        p = (c - cut) / total[of] + gamma[of] * (p[suffix[order - k]] if k > 1 else p[0])
        h = _hash(k, x, y)
        o = np.argsort(h)
        model.hashes.append(h[o])
        model.logp.append(np.log(p[o]).astype(np.float32))
        model.contexts.append(names)
        model.backoff.append(np.log(gamma).astype(np.float32))
    return model


class Counts:
    """How often each n-gram was met."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = self.merged = 0

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        h, first, _, n = _distinct(_hash(ORDER, low, high))
        self.parts.append((h, low[first], high[first], n))
        self.rows += len(h)
        if self.rows > 2 * self.merged + (1 << 18):
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        h, low, high, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        h, first, of, _ = _distinct(h)
        self.parts = [(h, low[first], high[first], np.bincount(of, n).astype(np.int64))]
        self.rows = self.merged = len(h)
        return self.parts[0]


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text, ``own``, the name of the model that learns from the text, and ``m``, that of the one that scores it.

    A language (null too) has two models, each of half its distinct texts by their hash; a text is scored by the half it is not in.
    """
    lang = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))
    half = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(2)), F.lit(0))
    return docs.select("doc_id", F.concat(half.cast("string"), lang).alias("own"), F.concat((1 - half).cast("string"), lang).alias("m"), "text")


def _other(m: str) -> F.Column:
    """The name of the language's other model."""
    return F.concat((1 - F.substring(m, 1, 1).cast("int")).cast("string"), F.expr(f"substring({m}, 2)"))


def models(docs: DataFrame) -> DataFrame:
    """m, bytes of its texts and the model (pickled), for each m that has text."""

    def count(batches):
        sums: dict[str, Counts] = {}
        size: dict[str, int] = {}

        def flush():
            for m, c in sums.items():
                _, low, high, n = c.merge()
                o = np.lexsort((low, high))  # neighbours are alike, which makes the shuffle smaller
                low, high, n = np.append(low[o], -1), np.append(high[o], -1), np.append(n[o], size[m])  # n-gram -1: bytes of text
                for a in range(0, len(n), 50_000):
                    s = slice(a, a + 50_000)
                    names = pa.array([m], pa.string()).take(pa.array(np.zeros(len(n[s]), np.int8)))
                    yield pa.RecordBatch.from_arrays([names, pa.array(low[s]), pa.array(high[s]), pa.array(n[s])], names=["m", "low", "high", "n"])
            sums.clear()
            size.clear()

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for s in steps(texts):
                by: dict[str, list[bytes]] = {}
                for m, t in zip(names[s], texts[s], strict=True):
                    if t:
                        by.setdefault(m, []).append(t)
                for m, own in by.items():
                    low, high, _ = grams(own)
                    sums.setdefault(m, Counts()).add(low, high)
                    size[m] = size.get(m, 0) + sum(map(len, own))
                if sum(c.rows for c in sums.values()) > HELD:
                    yield from flush()
        yield from flush()

    def fit(rows: pa.Table) -> pa.Table:
        low, high, n = (rows.column(c).to_numpy() for c in ("low", "high", "n"))
        o = np.lexsort((low, high))
        low, high, n = low[o], high[o], n[o]
        model = kneser_ney(low[1:], n[1:], high[1:], ORDER, POINT_BITS)
        return pa.table({"m": rows.column("m")[:1], "bytes": [int(n[0])], "model": [pickle.dumps(model)]})

    counted = docs.select("m", "text").mapInArrow(count, "m string, low long, high long, n long").groupBy("m", "low", "high").agg(F.sum("n").alias("n"))
    return counted.groupBy("m").applyInArrow(fit, "m string, bytes long, model binary")


def dealt(docs: DataFrame, made: DataFrame) -> DataFrame:
    """Rows (m, model, doc_id, text) in partitions by m and slot, in each the model (doc null) before the texts it is for."""
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = made.select(_other("m").alias("m"), F.least(F.lit(most), F.ceil(F.col("bytes") / SLOT_BYTES)).cast("int").alias("slots"))
    wide = slots.where("slots > 1")  # as many rows as the texts have SLOT_BYTES, at most
    rows = docs.join(F.broadcast(wide), "m", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    rows = rows.select("m", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.col("slots")).cast("int").alias("slot"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("model"), "doc_id", "text")
    first = made.join(slots, "m").select("m", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(0).alias("kind"), "model", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return first.union(rows).repartition("m", "slot").sortWithinPartitions("m", "slot", "kind").select("kind", "doc_id", "m", "text", "model")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, exactly."""
    at: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        at.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    hit = np.zeros(len(words) + 1, np.int64)
    for places in at.values():
        if len(places) > 1:
            for i in places:
                hit[i] += 1
                hit[i + WINDOW if i + WINDOW < len(words) else -1] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def block_medians(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lower median over a text's whole blocks (or its only part) of the block's mean."""
    blocks = np.maximum(size // BLOCK, 1)
    owner = np.repeat(np.arange(len(size)), blocks)
    begin = np.cumsum(size) - size
    first = np.cumsum(blocks) - blocks
    nth = np.arange(len(owner)) - first[owner]
    sums = np.concatenate([[0.0], np.cumsum(values)])
    at = begin[owner] + nth * BLOCK
    end = np.minimum(at + BLOCK, (begin + size)[owner])
    mean = (sums[end] - sums[at]) / (end - at)
    order = np.lexsort((mean, owner))
    return mean[order][first + (blocks - 1) // 2]


#: Odd multipliers of a window's words.
_PLACE = np.random.default_rng(20).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def base_rules(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    start = np.cumsum(size) - size
    space = CLASSES[data] == 0
    symbol = (CLASSES[data] >= 32) & (CLASSES[data] <= 39)
    chars = ~space & ((data & 0xC0) != 0x80)
    begins = ~space & np.concatenate([[True], space[:-1]])
    out = {k: np.add.reduceat(v, start, dtype=np.int64) for k, v in (("n_words", begins), ("word_chars", chars), ("n_symbols", symbol))}
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    # word hashes from prefix sums, window hashes from word hashes; equal windows never differ in hash
    rep = np.zeros(n, np.int64)
    b = np.flatnonzero(begins)
    if len(b) >= WINDOW:
        with np.errstate(over="ignore"):
            ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
            word = span_hashes(data, b, ends)
            doc = np.searchsorted(start, b, side="right") - 1
            m = len(b) - WINDOW + 1
            h = sum((word[k : k + m] * _PLACE[k] for k in range(WINDOW)), np.zeros(m, np.uint64))
            inside = doc[:m] == doc[WINDOW - 1 :]
            h = mix64(h + mix64(doc[:m].astype(np.uint64)))[inside]
        where = doc[:m][inside]
        order = np.argsort(h)
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        for i in np.unique(where[order[same]]).tolist():
            rep[i] = repeat_words(texts[i].split())
    out["n_repeat_words"] = rep
    return out


def judge(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, the base counts, base_failed, log_perplexity, the language's band and kept, a row for each document."""
    docs = named(docs)
    table = stored(models(docs.select(F.col("own").alias("m"), "text")), "quality-models")
    small = (table.agg(F.sum(F.length("model") + F.length("m"))).first()[0] or 0) <= broadcast_bytes
    made = docs.sparkSession.sparkContext.broadcast({r["m"]: pickle.loads(r["model"]) for r in table.collect()} if small else None)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("m", T.StringType())] + [T.StructField(c, T.LongType()) for c in counts] + [T.StructField(c, T.DoubleType()) for c in ("log_perplexity", "block_perplexity")])

    def make():
        by = made.value or {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not small:
                batch = arrived(batch)
            names, texts = np.array(batch.column(1).to_pylist(), object), [t or b"" for t in utf8(batch.column(2))]
            parts = {c: [] for c in counts}
            score, middle = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
            for s in steps(texts):
                got = base_rules(texts[s])
                for c in counts:
                    parts[c].append(got[c])
                at_of: dict[str, list[int]] = {}
                for i in range(s.start, s.stop):
                    if texts[i]:
                        at_of.setdefault(names[i], []).append(i)
                for m, at in at_of.items():
                    if m not in by:  # no other text to learn from
                        continue
                    low, high, size = grams([texts[i] for i in at])
                    _, first, of, _ = _distinct(_hash(ORDER, low, high))
                    value = -by[m].logprob(low[first], high[first])[of]
                    score[at] = np.add.reduceat(value, np.cumsum(size) - size) / size
                    middle[at] = block_medians(value, size)
            cols = [batch.column(0), batch.column(1)] + [pa.array(np.concatenate(parts[c]).astype(np.int64)) if parts[c] else pa.array([], pa.int64()) for c in counts] + [pa.array(x, from_pandas=True) for x in (score, middle)]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        def arrived(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Takes the models out of a batch; of earlier ones only the last can have texts in it."""
            for m in list(by)[:-1]:
                del by[m]
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(kind == 0).tolist():
                m = batch.column(2)[i].as_py()
                if m not in by:
                    by[m] = pickle.loads(batch.column(4)[i].as_py())
            return batch.filter(pa.array(kind == 1)).select([1, 2, 3])

        return step

    rows = docs.select("doc_id", "m", "text") if small else dealt(docs, table)
    scored = map_batches(rows, make, schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = stored(scored.withColumn("base_failed", failed), "quality")
    figures = ["log_perplexity", "block_perplexity"]
    bands = scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).groupBy(F.expr("substring(m, 2)").alias("m")).agg(*[F.percentile_approx(c, [0.25, 0.75], 10_000).alias(c) for c in figures])
    edges = [F.col("m").alias("bm")]
    for c in figures:
        reach = (F.col(c)[1] - F.col(c)[0]) * BAND_WIDTH + 1e-9  # sums differ in their last bits
        edges += [(F.col(c)[0] - reach).alias(f"{c}_low"), (F.col(c)[1] + reach).alias(f"{c}_high")]
    bands = stored(bands.select(*edges), "quality-bands")
    out = scored.join(F.broadcast(bands) if bands.count() <= 100_000 else bands, F.expr("substring(m, 2)") == F.col("bm"), "left")
    above = F.lit(True)
    below = F.lit(True)
    for c in figures:
        above &= F.coalesce(F.col(c) > F.col(f"{c}_high"), F.lit(False))
        below &= F.coalesce(F.col(c) < F.col(f"{c}_low"), F.lit(False))
    return out.select("doc_id", *counts, "base_failed", *figures, *[f"{c}_{e}" for c in figures for e in ("low", "high")], (~F.col("base_failed") & ~above & ~below).alias("kept"))


def op2_quality_rules(docs: DataFrame) -> DataFrame:
    """The thin query: base rules (under 20 words, or 30 in 100 words in repeated windows) and the band's verdict."""
    return judge(docs)
