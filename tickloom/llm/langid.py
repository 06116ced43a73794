"""Operator 9, language ID: averaged hashed subword embeddings under a linear softmax.

A text becomes the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes, word
boundaries included); a linear layer and a softmax follow. Both layers are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows: a window of
``sample_chars`` characters, at a place drawn by hash, of each of at most ``docs_per_lang`` texts a
language, ``sample_docs`` in all (at least 20 a language). Every label that occurs is learned. A
temperature fitted on a fifth of that sample calibrates the scores, and a text is rejected if its
score is below the threshold that keeps all but ``reject_share`` of the calibration texts, or if
its spelling is unlike anything learned (share of n-grams seen in training).

Once trained, the two layers collapse into one table of n-gram logits in fixed point
(``2**bits`` rows by a column a language, ``bits`` shrinking from 16 so that it has at most
``TABLE_CELLS`` cells), so a whole text costs one gather and one sum. Sums are of integers, so
equal texts get equal scores however they are batched, and are made ``GATHER_CELLS`` at a time.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; an
empty table gives an empty result; with no labelled row all texts are ``und``; repeated rows
get equal rows; null labels never train; other columns are ignored, and pass through the stage
whatever their names; the stage drops what is rejected (null and empty texts too), and keeps all
rows with a letter if nothing is labelled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import crc_fold, has_letter, map_batches, steps, utf8

BITS, WIDTH, ORDERS = 16, 16, (2, 3, 4)
#: Cells of the table of logits, at most, but for its least 2**10 rows; cells gathered at a time; bytes of text handled at a time.
TABLE_CELLS, GATHER_CELLS, STEP = 1 << 24, 1 << 21, 256 << 10
#: Fixed point of the table.
UNIT = float(1 << 20)
#: Odd multipliers of the n-gram hash, one an order; fixed values.
MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35}
#: ASCII bytes that are no letter count as white space.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def bits_for(langs: int) -> int:
    return max(10, min(BITS, (TABLE_CELLS // max(langs, 1)).bit_length() - 1))


def grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, one text after the other, and the texts' counts."""
    blobs = [b" " + t.lower().encode("utf-8", "replace").translate(_FOLD) + b" " for t in texts]
    data = np.frombuffer(b"".join(blobs) + b"   ", np.uint8)
    space = data == 32
    owner_end = np.cumsum([len(b) for b in blobs])
    n = int(owner_end[-1]) if blobs else 0
    codes = data.astype(np.uint32)
    out, where = [], []
    with np.errstate(over="ignore"):
        for order in ORDERS:
            code = codes[:n].copy()
            ok = np.ones(n, bool)
            for k in range(1, order):
                code = (code << np.uint32(8)) | codes[k : n + k]
                if k < order - 1:
                    ok &= ~space[k : n + k]
            ok &= ~(space[:n] & space[order - 1 : n + order - 1])
            if order == 2:
                ok &= ~space[:n] | ~space[1 : n + 1]
            at = np.flatnonzero(ok)
            ends = np.repeat(owner_end, [len(b) for b in blobs])
            at = at[at + order <= ends[at]]
            out.append(((code[at] * np.uint32(MULTIPLIERS[order])) >> np.uint32(32 - bits)).astype(np.int32))
            where.append(np.searchsorted(at, owner_end))
    # interleave by text: order by owner, each order's run after the other
    counts = np.array([np.diff(w, prepend=0) for w in where])  # orders x texts
    total = counts.sum(0)
    begin = np.concatenate([[0], np.cumsum(total)[:-1]]) if len(total) else np.zeros(0, int)
    flat = np.empty(int(total.sum()), np.int32)
    offset = begin.copy()
    for o, w in enumerate(where):
        c = counts[o]
        src = out[o]
        pos = np.arange(len(src)) + np.repeat(offset - np.concatenate([[0], w[:-1]]), c)
        flat[pos] = src
        offset = offset + c
    return flat, total


@dataclass
class LangModel:
    """langs: the classes; table: logits an n-gram adds (fixed point, 2**bits x langs); seen: buckets met in training."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray
    seen_threshold: float

    def sums(self, flat: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the sum of its n-grams' logits (fixed point), and how many are known."""
        logits, known = np.zeros((len(total), len(self.langs)), np.int64), np.zeros(len(total), np.int64)
        end = np.cumsum(total)
        step = max(1, GATHER_CELLS // max(1, len(self.langs)))
        for k in range(0, len(flat), step):
            part = flat[k : k + step]
            first, last = np.searchsorted(end, [k, k + len(part) - 1], side="right").tolist()
            own = first + np.flatnonzero(total[first : last + 1])
            begin = np.maximum(end[own] - total[own] - k, 0)
            logits[own] += np.add.reduceat(self.table[part], begin, axis=0, dtype=np.int64)
            known[own] += np.add.reduceat(self.seen[part], begin, dtype=np.int64)
        return logits, known

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated class probabilities (texts x langs) and the share of known n-grams."""
        flat, total = grams(texts, len(self.table).bit_length() - 1)
        logits, known = self.sums(flat, total)
        size = np.maximum(total, 1)
        z = (logits / UNIT / size[:, None] + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True), known / size


def _segments(text: str, words: int = 40) -> list[str]:
    parts = text.split()
    return [" ".join(parts[i : i + words]) for i in range(0, len(parts), words)] or [text]


def train(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 2.0, batch: int = 128, reject_share: float = 0.001, seed: int = 7) -> LangModel:
    """SGD on segments of the sampled texts; each fifth text calibrates instead."""
    langs = sorted({lang for _, lang in rows})
    index = {lang: i for i, lang in enumerate(langs)}
    bits = bits_for(len(langs))
    rng = np.random.default_rng(seed)
    held = [r for i, r in enumerate(rows) if i % 5 == 4] or rows
    fit = [r for i, r in enumerate(rows) if i % 5 != 4] or rows
    pieces = [(s, index[lang]) for text, lang in fit for s in _segments(text)]
    embed = rng.normal(0, 0.05, (1 << bits, WIDTH)).astype(np.float32)
    top = np.zeros((WIDTH, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    top[:] = rng.normal(0, 0.3, top.shape)
    seen = np.zeros(1 << bits, np.uint8)
    ready = []
    order = rng.permutation(len(pieces))
    for i in range(0, len(order), batch):
        part = [pieces[j] for j in order[i : i + batch]]
        flat, total = grams([s for s, _ in part], bits)
        keep = total > 0
        seen[flat] = 1
        if keep.any():
            ready.append((flat, total[keep], np.array([y for _, y in part])[keep]))
    weight = np.bincount(np.concatenate([y for _, _, y in ready]), minlength=len(langs)) if ready else np.ones(len(langs))
    weight = (weight.sum() / np.maximum(weight, 1) / len(langs)).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for flat, total, y in ready:
            begin = np.concatenate([[0], np.cumsum(total)[:-1]])
            mean = np.add.reduceat(embed[flat], begin, axis=0) / total[:, None]
            z = mean @ top + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            g = (p * weight[y][:, None] / len(y)).astype(np.float32)
            back = (g @ top.T) * (step * 10 / total)[:, None].astype(np.float32)
            top -= step * (mean.T @ g)
            bias -= step * 0.1 * g.sum(0)
            np.subtract.at(embed, flat, np.repeat(back, total, axis=0))
    model = LangModel(langs, np.round((embed @ top) * UNIT).astype(np.int32), bias.astype(np.float64), 1.0, 0.0, seen, 0.0)
    if not rows:
        return model
    held_parts = [(s, index[lang]) for text, lang in held for s in _segments(text)]
    y = np.array([i for _, i in held_parts])
    best = (np.inf, 1.0)
    flat, total = grams([s for s, _ in held_parts], bits)
    z = model.sums(flat, total)[0] / UNIT / np.maximum(total, 1)[:, None] + model.bias
    for t in np.geomspace(0.02, 4, 60):
        at = z / t
        at -= at.max(1, keepdims=True)
        loss = (np.log(np.exp(at).sum(1)) - at[np.arange(len(y)), y]).mean()
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    p, known = model.scores([s for s, _ in held_parts])
    model.threshold = float(min(0.5, np.quantile(p.max(1), reject_share)))
    model.seen_threshold = float(np.quantile(known, reject_share) * 0.6)
    return model


def sample(docs: DataFrame, learn: F.Column | None = None, docs_per_lang: int = 200, sample_chars: int = 4000, sample_docs: int = 20_000) -> list[tuple[str, str]]:
    """Windows of at most ``docs_per_lang`` labelled texts of every label, by a hash of the row."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    counts = rows.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))
    langs = counts.count()  # a row a label
    if not langs:
        return []
    per = max(20, min(docs_per_lang, sample_docs // langs))
    ticket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.least(F.lit(1.0), 1.5 * per / F.col("n")) * (1 << 30)
    own = rows.select("lang", "text", ticket.alias("ticket")).join(F.broadcast(counts.select("l", share.alias("share"))), F.col("lang") == F.col("l")).where(F.col("ticket") < F.col("share"))
    spare = F.greatest(F.length("text") - sample_chars, F.lit(0))
    window = F.substring("text", F.pmod(F.xxhash64("ticket"), spare + 1).cast("int") + 1, F.lit(sample_chars))
    own = own.select("lang", "ticket", window.alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("ticket", "text"))
    got = own.withColumn("nth", nth).where(F.col("nth") <= per).select("text", "lang", "ticket").collect()
    return [(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (r["ticket"], r["lang"], r["text"])) if has_letter(r["text"])]


def judged(model: LangModel, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """lang_pred, score and rejected of each text."""
    n = len(texts)
    lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
    for s in steps(texts, STEP):
        own = [t.decode() if t else "" for t in texts[s]]
        good = [i for i, t in enumerate(own) if t and has_letter(t)]
        if not good or not model.langs:
            rejected[[s.start + i for i in good]] = False
            continue
        p, known = model.scores([own[i] for i in good])
        best = p.argmax(1)
        top = p[np.arange(len(good)), best]
        at = s.start + np.array(good)
        for j, i in enumerate(at.tolist()):
            lang[i] = model.langs[best[j]]
        score[at] = top
        rejected[at] = (top < model.threshold) | (known < model.seen_threshold)
    return lang, score, rejected


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row; ``text`` is read whole."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, rejected = judged(shared.value, utf8(batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

        return step

    return map_batches(docs.select("doc_id", "text"), make, schema)


def kept(docs: DataFrame, model: LangModel) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda batch: batch.filter(pa.array(~judged(shared.value, utf8(batch.column(at)))[2]))

    return map_batches(docs, make, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))


def op9_language_id(docs: DataFrame) -> DataFrame:
    """The thin query: learns where crc32(doc_id) mod 4 is not 2, predicts every row."""
    held = crc_fold("doc_id", 4) == 2
    model = train(sample(docs, ~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go."""
    return kept(docs, train(sample(docs)))
