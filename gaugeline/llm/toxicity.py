"""Toxicity scores from a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hash and of the hashes of its prefixes. Filters of several widths
run over the words, each is pooled by its maximum over the whole text, and a logistic layer reads the pooled values.
Decision thresholds are calibrated per language; the language is guessed from common words of the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, brief_shuffles, byte_codes, carried, discard, lower_table, stage, text_blocks

BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 15, 16, 16, (1, 2, 3), (4, 6, 8)
#: Bounds of the sample that the model warms up on before all rows train it: so many rows of each label, and so many bytes
#: of their texts together.
SAMPLE, SAMPLE_BYTES = 3000, 48 << 20
EPOCHS, BATCH, RATE = 4, 32, 0.02
#: Rows of a shard, which one task trains on, and shards at most; beyond that shards are longer.
SHARD, SHARDS = 4096, 64
#: Steps of a changed parameter that are summed as whole numbers, so that sums do not hang on their order, and of a logit.
FINE, CELLS = float(1 << 30), 256.0
#: Texts that each bucket's log odds are smoothed with.
SMOOTH = 4.0
#: Frequent words that tell a language.
COMMON = {
    "en": "the and of to in is that it was for with as on are this be by from",
    "de": "der die das und ist nicht ein eine den dem von mit zu auf im sich für",
    "fr": "le les des est une dans que qui pour pas sur au avec du et il elle",
    "es": "el los las una que con por para del se su no es como más y lo",
}


def _breaks() -> np.ndarray:
    """Every ASCII character but letters and digits ends a word."""
    t = np.ones(256, bool)
    t[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return t


def _buckets(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and of its prefixes (0 where it is no longer than those), first words, whole hashes."""
    words = Words(data, offsets, breaks, codes)
    whole = words.hashes()
    columns = [whole]
    for n in PREFIXES:
        columns.append(np.where(words.end - words.begin > n, words.hashes(n), np.uint64(0)))
    ids = np.stack([np.where(h == 0, 0, 1 + h % np.uint64(BUCKETS - 1)) for h in columns], axis=1).astype(np.int32)
    return ids, words.first, whole


def _common_hashes() -> list[np.ndarray]:
    codes, breaks = byte_codes(17)[lower_table()], _breaks()
    out = []
    for words in COMMON.values():
        data = np.frombuffer(words.encode(), np.uint8)
        out.append(np.sort(Words(data, np.array([0, len(data)]), breaks, codes).hashes()))
    return out


def _languages(whole: np.ndarray, first: np.ndarray, common: list[np.ndarray]) -> np.ndarray:
    """Index of the language whose common words are most frequent in each text; one past the last where there are none."""
    counts = np.zeros((len(first) - 1, len(common)), np.int64)
    for i, known in enumerate(common):
        at = np.minimum(np.searchsorted(known, whole), len(known) - 1)
        total = np.concatenate([[0], np.cumsum(known[at] == whole)])
        counts[:, i] = total[first[1:]] - total[first[:-1]]
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), len(common))


@dataclass
class TextCnn:
    """The model: embeddings, filters by width, and the logistic layer on the pooled values."""

    table: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    head: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(COMMON) + 1))

    @classmethod
    def start(cls, odds: np.ndarray, seed: int) -> TextCnn:
        """The first dimension of an embedding starts as its bucket's log odds of toxicity, and the first filters read
        it: the maximum over a long text then falls on telling words from the first step on, so that these learn."""
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        table[:, 0] = odds
        table[0] = 0
        filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        head = rng.normal(0, 0.05, FILTERS * len(WIDTHS)).astype(np.float32)
        for k, f in enumerate(filters):
            f[:, 0, : FILTERS // 4] = 1 / len(f)
            head[k * FILTERS : k * FILTERS + FILTERS // 4] = 0.2
        return cls(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], head, -1.0)

    def pooled(self, ids: np.ndarray, first: np.ndarray, where: bool = False):
        """Pooled values (texts, filters) of a block, and with ``where`` the word of each maximum (-1: none above 0)."""
        texts = len(first) - 1
        x = self.table[ids[:, 0]]
        for column in ids.T[1:]:  # one column at a time: a long text is a block of its own
            x += self.table[column]
        doc = np.repeat(np.arange(texts), np.diff(first))
        values, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.offsets):
            out = np.zeros((texts, FILTERS), np.float32)
            place = np.full((texts, FILTERS), -1, np.int64)
            n = len(x) - w + 1
            if n > 0:
                conv = x[:n] @ f[0] + b
                for j in range(1, w):
                    conv += x[j : n + j] @ f[j]
                conv[doc[:n] != doc[w - 1 :]] = 0
                full = np.flatnonzero((np.diff(first) > 0) & (first[:-1] < n))
                out[full] = np.maximum(np.maximum.reduceat(conv, first[full], axis=0), 0)
                if where:
                    for d in full:
                        seg = conv[first[d] : min(first[d + 1], n)]
                        place[d] = np.where(out[d] > 0, first[d] + seg.argmax(axis=0), -1)
            values.append(out)
            places.append(place)
        return (np.concatenate(values, axis=1), x, places) if where else np.concatenate(values, axis=1)

    def logits(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first) @ self.head + self.bias

    def step(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        """One step of Adagrad on the cross-entropy of a batch; only words that hold a maximum get a gradient."""
        p, x, places = self.pooled(ids, first, where=True)
        g = (1 / (1 + np.exp(-(p @ self.head + self.bias))) - y).astype(np.float32) / len(y)
        back = g[:, None] * self.head
        grad_head, grad_bias = p.T @ g + 1e-4 * self.head, g.sum()
        grad_x = np.zeros_like(x)
        for k, (w, place) in enumerate(zip(WIDTHS, places)):
            d, f = np.nonzero(place >= 0)
            at, amount = place[d, f], back[d, k * FILTERS + f][:, None]
            grad = np.zeros_like(self.filters[k])
            for j in range(w):
                np.add.at(grad[j].T, f, x[at + j] * amount)
                np.add.at(grad_x, at + j, self.filters[k][j].T[f] * amount)
            self._move(self.filters[k], grad, state, f"f{k}", rate)
            self._move(self.offsets[k], np.bincount(f, amount[:, 0], FILTERS).astype(np.float32), state, f"o{k}", rate)
        self._move(self.head, grad_head, state, "head", rate)
        state["bias"] = state.get("bias", 1e-6) + grad_bias**2
        self.bias -= rate * grad_bias / np.sqrt(state["bias"])
        moved = np.flatnonzero(np.abs(grad_x).sum(axis=1))
        rows, inverse = np.unique(ids[moved].ravel(), return_inverse=True)
        grad = np.zeros((len(rows), DIM), np.float32)
        np.add.at(grad, inverse.ravel(), np.repeat(grad_x[moved], ids.shape[1], axis=0))
        grad[rows == 0] = 0
        seen = state.setdefault("table", np.full(BUCKETS, 1e-6, np.float32))
        seen[rows] += (grad**2).mean(axis=1)
        self.table[rows] -= rate * grad / np.sqrt(seen[rows])[:, None]

    @staticmethod
    def _move(value: np.ndarray, grad: np.ndarray, state: dict, key: str, rate: float) -> None:
        seen = state.setdefault(key, np.full_like(value, 1e-6))
        seen += grad**2
        value -= rate * grad / np.sqrt(seen)


    def flat(self) -> np.ndarray:
        """All parameters but thresholds in one vector, filled up to rows of DIM."""
        parts = [self.table.ravel(), *(f.ravel() for f in self.filters), *self.offsets, self.head, [self.bias]]
        whole = np.concatenate(parts).astype(np.float64)
        return np.concatenate([whole, np.zeros(-len(whole) % DIM)])

    def moved(self, by: np.ndarray) -> TextCnn:
        """The model with its parameters moved by a vector like that of ``flat``."""
        new, at, arrays = self.flat() + by, 0, []
        for old in (self.table, *self.filters, *self.offsets, self.head):
            arrays.append(new[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        n = len(WIDTHS)
        return TextCnn(arrays[0], arrays[1 : 1 + n], arrays[1 + n : 1 + 2 * n], arrays[-1], float(new[at]), self.thresholds.copy())


def _threshold(score: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> float:
    """The threshold between two scores with the best F1."""
    by = np.argsort(-score, kind="stable")
    s, t, w = score[by], truth[by], weight[by]
    hit, said = np.cumsum(w * t), np.cumsum(w)
    f1 = 2 * hit / (said + (w * t).sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # equal scores fall on one side
    i = int(np.argmax(f1))
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def _odds(seen: np.ndarray, share: float) -> np.ndarray:
    """Log odds of toxicity by bucket, from the texts of each label that hold it and the share of toxic ones."""
    share = min(max(share, 0.01), 0.99)
    return np.log((seen[1] + SMOOTH * share) / (seen[0] + SMOOTH * (1 - share))) - np.log(share / (1 - share))


def fit(texts: list[np.ndarray], y: np.ndarray, languages: np.ndarray, prior: float, seed: int = 1, odds: np.ndarray | None = None) -> TextCnn:
    """Train on four fifths of the sample and set thresholds on the rest, weighted to the share ``prior`` of toxic rows.
    ``odds`` are the buckets' log odds where they have been counted on more rows."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    rest, train = order[: len(order) // 5], order[len(order) // 5 :]
    seen = np.zeros((2, BUCKETS))
    for i in train:
        seen[int(y[i]), np.unique(texts[i])] += 1
    counted = _odds(seen, y[train].mean())
    model, state = TextCnn.start(counted if odds is None else odds, seed), {}

    def block(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([texts[i] for i in rows]), np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])

    for epoch in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            model.step(*block(rows), y[rows].astype(np.float32), state, RATE * (1 - epoch / EPOCHS))
    rest = rest if len(rest) and 0 < y[rest].sum() < len(rest) else order
    score = np.concatenate([model.logits(*block(rest[at : at + 64])) for at in range(0, len(rest), 64)])
    truth, lang = y[rest], languages[rest]
    weight = np.where(truth == 1, prior / max(truth.mean(), 1e-9), (1 - prior) / max(1 - truth.mean(), 1e-9))

    def best(rows: np.ndarray) -> float:
        return _threshold(score[rows], truth[rows], weight[rows])

    general = best(np.arange(len(rest)))
    for k in range(len(COMMON) + 1):
        rows = np.flatnonzero(lang == k)
        model.thresholds[k] = best(rows) if min(truth[rows].sum(), (1 - truth[rows]).sum()) >= 20 else general
    return model


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, breaks, common = byte_codes(17)[lower_table()], _breaks(), _common_hashes()
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch.column(1)):
            ids, first, whole = _buckets(data, offsets, codes, breaks)
            packed = [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            lang = _languages(whole, first, common).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(packed, pa.binary()), pa.array(lang)],
                ["doc_id", "toxic", "ids", "lang"],
            )


def held_out(mod: int = 5, left: int = 0):
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == left, F.lit(False))


def _chosen(measured: DataFrame, label: int, sample: int, sample_bytes: int) -> list[tuple[int, int, int]]:
    """(doc_id, label, bytes) of the training rows of a label: the first by a hash of doc_id, whatever their length,
    while their texts together stay within the bytes; what no longer fits is passed over. At least the shortest."""
    own = measured.filter(F.col("toxic") == label)
    picked, total = [], 0
    for r in own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect():
        if total + r["bytes"] <= sample_bytes:
            total += r["bytes"]
            picked.append((r["doc_id"], label, r["bytes"]))
    if not picked:
        picked = [(r["doc_id"], label, r["bytes"]) for r in own.orderBy("bytes", "doc_id").limit(1).collect()]
    return picked


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label by bucket that they hold, and all of them under -1; batches of (text, toxic)."""
    codes, breaks = byte_codes(17)[lower_table()], _breaks()
    seen = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in text_blocks(batch.column(0)):
            ids, first, _ = _buckets(data, offsets, codes, breaks)
            for row, a, b in zip(toxic[lo:hi], first[:-1], first[1:]):
                seen[row, np.unique(ids[a:b])] += 1
                seen[row, BUCKETS] += 1
    at = np.flatnonzero(seen.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], ["at", "n0", "n1"])


def _shard_batches(shared):
    """One pass of steps over a shard's rows; what they changed, times the shard's rows, in rows of DIM whole numbers, and
    the number of rows under -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, breaks = byte_codes(17)[lower_table()], _breaks()
        start = shared.value
        model, state, rows = start.moved(np.zeros(1)), {}, 0
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float32)
            for lo, hi, data, offsets in text_blocks(batch.column(0), BATCH):
                ids, first, _ = _buckets(data, offsets, codes, breaks)
                model.step(ids, first, toxic[lo:hi], state, RATE / 2)
                rows += hi - lo
        change = np.rint((model.flat() - start.flat()) * FINE).astype(np.int64).reshape(-1, DIM) * rows
        at = np.flatnonzero(change.any(axis=1))
        change = np.concatenate([change[at], np.full((1, DIM), rows, np.int64)])
        columns = [pa.array(np.append(at, -1).astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in change.T)]
        yield pa.RecordBatch.from_arrays(columns, ["at", *(f"c{k}" for k in range(DIM))])

    return run


def _cell_batches(shared):
    """Rows by guessed language, label and cell of their logit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes, breaks, common = byte_codes(17)[lower_table()], _breaks(), _common_hashes()
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_blocks(batch.column(0)):
                ids, first, whole = _buckets(data, offsets, codes, breaks)
                cell = np.rint(np.clip(model.logits(ids, first), -80, 80) * CELLS)
                key = np.stack([_languages(whole, first, common), toxic[lo:hi], cell.astype(np.int64)], axis=1).astype(np.int32)
                keys, n = np.unique(key, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in keys.T), pa.array(n)], ["lang", "toxic", "cell", "n"])

    return run


def _labelled(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Texts with their labels, merged whatever the size of the labels: a small table then costs what a large one costs, in
    proportion, and no task or driver holds all labels."""
    return texts.join(known.hint("merge"), "doc_id")


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts by label and bucket, and texts by label, over all rows; at most one row a bucket reaches the driver."""
    seen, texts = np.zeros((2, BUCKETS)), np.zeros(2)
    for at, n0, n1 in rows.mapInArrow(_count_batches, "at int, n0 long, n1 long").groupBy("at").agg(F.sum("n0"), F.sum("n1")).collect():
        if at < 0:
            texts[:] = n0, n1
        else:
            seen[:, at] = n0, n1
    return seen, texts


def _trained(model: TextCnn, texts: DataFrame, known: DataFrame, count: int) -> TextCnn:
    """The model after a pass over all texts (doc_id, text) with a label (doc_id, toxic), shuffled once: shards train by themselves, and the mean of their changes,
    weighted by their rows, is taken. Shards go by doc_id and are sorted, so a repeated run gives the same model."""
    spark, shards = texts.sparkSession, int(min(SHARDS, max(1, count // SHARD)))
    dealt = _labelled(texts.repartition(shards, "doc_id"), known.repartition(shards, "doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").select("text", "toxic")
    changes = dealt.mapInArrow(_shard_batches(spark.sparkContext.broadcast(model)), ", ".join(["at int", *(f"c{k} long" for k in range(DIM))]))
    sums = changes.groupBy("at").agg(*(F.sum(f"c{k}") for k in range(DIM))).collect()
    total = max(sum(r[1] for r in sums if r[0] < 0), 1)
    by = np.zeros((len(model.flat()) // DIM, DIM))
    for at, *values in sums:
        if at >= 0:
            by[at] = values
    return model.moved(by.ravel() / (FINE * total))


def _set_thresholds(model: TextCnn, rows: DataFrame) -> None:
    """Thresholds by language from the logits of all rows (text, toxic), in cells; where there are rows of both labels."""
    told = rows.mapInArrow(_cell_batches(rows.sparkSession.sparkContext.broadcast(model)), "lang int, toxic int, cell int, n long")
    cells = np.array([tuple(r) for r in told.groupBy("lang", "toxic", "cell").agg(F.sum("n")).orderBy("lang", "toxic", "cell").collect()], np.int64).reshape(-1, 4)
    lang, truth, score, n = cells[:, 0], cells[:, 1], cells[:, 2] / CELLS, cells[:, 3].astype(np.float64)

    def least(mask: np.ndarray) -> float:
        return min(n[mask & (truth == 1)].sum(), n[mask & (truth == 0)].sum())

    every = np.ones(len(cells), bool)
    if not least(every):
        return
    general = _threshold(score, truth, n)
    for k in range(len(COMMON) + 1):
        own = lang == k
        model.thresholds[k] = _threshold(score[own], truth[own], n[own]) if least(own) >= 20 else general


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> TextCnn | None:
    """The model learned from every labelled text that is not held out; None without rows of both labels. Four fifths of the
    doc_ids train: log odds are counted on all their texts, filters warm up on a sample (``sample`` whole texts of each
    label, ``sample_bytes`` together, which the driver holds at about 8 bytes for each of a text) and then make a pass over
    all texts, shard by shard. Thresholds come from all texts of the other fifth. Texts that repeat a doc_id count each; in
    the sample the shortest counts, and of several the smallest, once."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out())
    known = known.filter("toxic IN (0, 1)").withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)))
    if known.select("toxic").distinct().count() < 2:
        return None
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    every, mine = _labelled(texts, known), known.filter("_fold <> 0")
    rows = _labelled(texts, mine).select("doc_id", "text", "toxic")
    seen, count = _counted(rows.select("text", "toxic"))
    if not count.min():  # too few rows to keep a fifth of them apart
        mine, rows = known, every.select("doc_id", "text", "toxic")
        seen, count = _counted(rows.select("text", "toxic"))
        if not count.min():
            return None
    share = count[1] / count.sum()
    lengths = texts.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).groupBy("doc_id").agg(F.min("bytes").alias("bytes"))
    measured = stage(rows.select("doc_id", "toxic").distinct().join(lengths, "doc_id"), "measured")
    chosen = docs.sparkSession.createDataFrame(_chosen(measured, 0, sample, sample_bytes) + _chosen(measured, 1, sample, sample_bytes), "doc_id long, toxic int, bytes long")
    discard(measured)
    few = texts.join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text") == F.col("bytes"))
    few = few.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    few = few.mapInArrow(_sample_batches, "doc_id long, toxic int, ids binary, lang int").orderBy("doc_id").collect()
    y = np.array([r["toxic"] for r in few])
    ids = [np.frombuffer(r["ids"], np.int32).reshape(-1, 1 + len(PREFIXES)) for r in few]
    model = fit(ids, y, np.array([r["lang"] for r in few]), share, odds=_odds(seen, share))
    model = _trained(model, texts, mine.select("doc_id", "toxic"), int(count.sum()))
    _set_thresholds(model, _labelled(texts, known.filter("_fold = 0")).select("text", "toxic"))
    return model


def _score_batches(shared, whole: bool = False):
    """Scores beside the other columns, and with ``whole`` beside the text too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes, breaks, common = byte_codes(17)[lower_table()], _breaks(), _common_hashes()
        for batch in batches:
            names = [batch.schema.names[0], *batch.schema.names[1 if whole else 2 :]]
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                ids, first, hashes = _buckets(data, offsets, codes, breaks)
                if model is None:
                    score = np.zeros(hi - lo)
                else:
                    z = model.logits(ids, first) - model.thresholds[_languages(hashes, first, common)]
                    score = np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40))), 6)
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(lo, hi - lo) for n in names), pa.array(score)], [*names, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), **bounds: int) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), and the columns of ``carry``,
    which may name the text.

    Only text is an input of a score. Labels are learned from documents that are not held out. Null text is scored
    like empty text; null doc_id is not held out and never a training row. Rows that repeat a doc_id are scored one by
    one; of labels that repeat one, the larger counts. Without rows of both labels every score is 0. Texts of any length
    are scored whole, blocks of about 500 kB at a time. Extra columns are ignored; an empty table gives an empty table.
    """
    with brief_shuffles(docs.sparkSession):
        learned = train(docs, labels, **bounds)
    model = docs.sparkSession.sparkContext.broadcast(learned)
    others = tuple(c for c in carry if c != "text")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), *others)
    columns = ["doc_id long", *(["text string"] if "text" in carry else []), *carried(docs, others), "score double"]
    scored = texts.mapInArrow(_score_batches(model, "text" in carry), ", ".join(columns))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carry)
