"""Toxicity scores by a convolutional text classifier over hashed word embeddings, written and trained in numpy.

A word's vector is the sum of two rows of one table, chosen by a hash of the word and one of its head. Filters of widths one to three slide over the
words of the whole text, each keeps its largest response, and a logistic layer weighs those. The gradient of a document only runs
through the windows that won, so training touches few rows. ``learn`` trains on every labelled row: learners, one for each so many bytes of text,
each go once over their own rows from the same network, and what they changed is averaged by rows of the table in a shuffle; that is an epoch. Thresholds
come from all rows that are kept from the gradient. Scoring is one map over all rows. ``train`` is the small form on the driver, from a bounded sample.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.langid import held_out
from wattframe.llm.text import LOWER, PUNCTUATION, ragged_index, span_hashes, text_slices, word_spans
from wattframe.session import cut_lineage

ROWS, DIMS, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
#: bytes of a word's head, which has a row of its own: words that are rare or new share it with their kin
HEAD = 4
#: text of one learner, rows of the table that are averaged together, and words of a learner's batch (or of one longer text)
LEARNER_BYTES, BLOCK, BATCH_WORDS = 48 << 20, 1 << 10, 200_000
#: up to so many labels they are broadcast, beyond they are joined by a shuffle; slices of a unit of logits that are ordered alone
BROADCAST_IDS, SLICES = 1_000_000, 16
#: bounds of the sample of ``train``: rows of each class, and words of all of them that the gradient sees
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WORDS = 3_000, 5_000, 8_000_000
EPOCHS, BATCH, RATE = 10, 64, 0.05
#: a language gets a threshold of its own from so many calibration rows of either class
LANGUAGE_ROWS = 20
PAD = max(WIDTHS)


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x 2 table rows, splits): hashed words of each text, A-Z lowered, cut at all ASCII but letters and digits."""
    data = LOWER[data]
    starts, ends, splits = word_spans(data, offsets, PUNCTUATION)
    whole, head = span_hashes(data, starts, ends), span_hashes(data, starts, np.minimum(ends, starts + HEAD))
    return np.stack([whole & np.uint64(ROWS - 1), (head >> np.uint64(32)) & np.uint64(ROWS - 1)], 1).astype(np.int32), splits


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        return cls((rng.standard_normal((ROWS + 1, DIMS)) * 0.1).astype(np.float32) * (np.arange(ROWS + 1) < ROWS)[:, None].astype(np.float32),
                   [(rng.standard_normal((w * DIMS, FILTERS)) / np.sqrt(w * DIMS)).astype(np.float32) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS], (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32), 0.0)

    def forward(self, words: np.ndarray, splits: np.ndarray, winners: bool = False):
        """(logits, pooled responses, padded words, winning windows) of texts given as table rows; an empty text is all padding."""
        sizes = np.diff(splits)
        at = np.concatenate([[0], np.cumsum(sizes + PAD)])
        padded = np.full((at[-1], 2), ROWS, np.int32)  # the last row is zero
        padded[ragged_index(at[:-1], sizes)] = words
        vectors = self.table[padded[:, 0]] + self.table[padded[:, 1]]
        pooled, won = [], []
        tail = np.zeros((PAD, DIMS), np.float32)
        longer = np.concatenate([vectors, tail])
        n, docs = len(vectors), len(sizes)
        inside = np.ones(n, bool)
        inside[ragged_index(at[:-1] + np.maximum(sizes, 1), PAD - (sizes == 0))] = False
        for width, kernel in zip(WIDTHS, self.filters, strict=True):
            response = sum(longer[j:j + n] @ kernel[j * DIMS:(j + 1) * DIMS] for j in range(width))
            response[~inside] = -np.inf
            top = np.maximum.reduceat(response, at[:-1], axis=0) if docs else np.zeros((0, FILTERS), np.float32)
            pooled.append(top)
            if winners:
                hit = response == np.repeat(top, np.diff(at), axis=0)
                place = np.where(hit, np.arange(n, dtype=np.int64)[:, None], n)
                won.append(np.minimum.reduceat(place, at[:-1], axis=0))
        raw = np.concatenate(pooled, 1) + np.concatenate(self.biases)
        kept = np.maximum(raw, 0)
        return kept @ self.weights + self.bias, kept, padded, won

    def scores(self, words: np.ndarray, splits: np.ndarray) -> np.ndarray:
        logits = self.forward(words, splits)[0].astype(np.float64) - self.shift
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


@dataclass
class Training:
    """A network and the sums of squared gradients that scale its steps."""

    net: Network
    squares: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Training:
        return cls(Network.fresh(rng), {"table": np.full(ROWS + 1, 1e-8, np.float32)})

    def dense(self) -> np.ndarray:
        """All weights but the table's, and the sums of their squared gradients."""
        net, zero = self.net, 1e-8
        values = {"weights": net.weights, "bias": np.array([net.bias])}
        values |= {f"filter{k}": v for k, v in enumerate(net.filters)} | {f"bias{k}": v for k, v in enumerate(net.biases)}
        return np.concatenate([*(v.ravel() for v in values.values()), *(np.broadcast_to(self.squares.get(k, zero), v.shape).ravel() for k, v in values.items())]).astype(np.float64)

    def move_dense(self, change: np.ndarray) -> None:
        net, at = self.net, 0
        flat, sums = np.split(self.dense() + change, 2)
        for name, value in [("weights", net.weights), ("bias", np.zeros(1)), *((f"filter{k}", v) for k, v in enumerate(net.filters)), *((f"bias{k}", v) for k, v in enumerate(net.biases))]:
            value[...] = flat[at:at + value.size].reshape(value.shape)
            self.squares[name] = sums[at:at + value.size].reshape(value.shape).astype(value.dtype)
            if name == "bias":
                net.bias = float(value[0])
            at += value.size

    def step(self, name: str, value: np.ndarray, gradient: np.ndarray, rate: float = RATE) -> None:
        self.squares[name] = self.squares.get(name, 1e-8) + gradient**2
        value -= rate * gradient / np.sqrt(self.squares[name])

    def batch(self, words: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> None:
        """A step along the gradient of a batch."""
        net, step, squares = self.net, self.step, self.squares
        splits = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        logits, kept, padded, won = net.forward(np.concatenate(words), splits, winners=True)
        error = ((1 / (1 + np.exp(-np.clip(logits, -40, 40))) - toxic) * weight / len(words)).astype(np.float32)
        back = error[:, None] * net.weights * (kept > 0)
        step("weights", net.weights, kept.T @ error)
        bias = np.array([net.bias])
        step("bias", bias, np.array([error.sum()]))
        net.bias = float(bias[0])
        rows, changes = [], []
        for k, width in enumerate(WIDTHS):
            own = back[:, k * FILTERS:(k + 1) * FILTERS]
            doc, unit = np.nonzero(own)
            amount = own[doc, unit]
            gradient = np.zeros_like(net.filters[k])
            for j in range(width):
                where = np.minimum(won[k][doc, unit] + j, len(padded) - 1)
                pair = padded[where]
                vector = net.table[pair[:, 0]] + net.table[pair[:, 1]]
                for f in range(FILTERS):
                    mine = unit == f
                    gradient[j * DIMS:(j + 1) * DIMS, f] = amount[mine] @ vector[mine]
                into = amount[:, None] * net.filters[k][j * DIMS:(j + 1) * DIMS, unit].T
                rows += [pair[:, 0], pair[:, 1]]
                changes += [into, into]
            step(f"filter{k}", net.filters[k], gradient)
            step(f"bias{k}", net.biases[k], own.sum(0))
        row, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(row), DIMS), np.float32)
        np.add.at(total, inverse, np.concatenate(changes))
        squares["table"][row] += (total**2).sum(1)
        net.table[row] -= RATE * total / np.sqrt(squares["table"][row])[:, None]
        net.table[ROWS] = 0


def class_weights(toxic: np.ndarray, share: float) -> np.ndarray:
    """Both classes weigh the same where ``share`` of the rows are toxic."""
    share = max(share, 1e-6)
    return np.where(toxic > 0, 0.5 / share, 0.5 / max(1 - share, 1e-6))


def fit(words: list[np.ndarray], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network from the hashed words of texts and their labels; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    state = Training.fresh(rng)
    weight = class_weights(toxic, toxic.mean())
    for _ in range(epochs):
        order = rng.permutation(len(words))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            state.batch([words[k] for k in pick], toxic[pick], weight[pick])
    return state.net


def best_cut(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest errors."""
    order = np.argsort(logits)
    value, label = logits[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(label > 0)]) + np.concatenate([np.cumsum(label[::-1] <= 0)[::-1], [0]])
    edges = np.concatenate([[value[0] - 2], value, [value[-1] + 2]])
    gap = np.diff(edges)
    best = np.flatnonzero((errors == errors[gap > 0].min()) & (gap > 0))
    k = best[np.argmax(gap[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def _words(rows: DataFrame) -> DataFrame:
    """doc_id, toxic, n, words of ``rows`` (doc_id, toxic, text): hashed words as bytes, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(2)):
                words, splits = word_rows(data, offsets)
                texts = pa.array([words[a:b].tobytes() for a, b in zip(splits[:-1], splits[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in (0, 1)), pa.array(np.diff(splits)), texts], names=["doc_id", "toxic", "n", "words"])

    return rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, n long, words binary")


def _logits(rows: DataFrame, net: Network) -> DataFrame:
    """doc_id, toxic, lang, logit of ``rows`` (doc_id, toxic, lang, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(3)):
                logits = shared.value.forward(*word_rows(data, offsets))[0].astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(3)), pa.array(logits)], names=["doc_id", "toxic", "lang", "logit"])

    return rows.select("doc_id", "toxic", "lang", "text").mapInArrow(run, "doc_id long, toxic int, lang string, logit double")


def epoch(rows: DataFrame, state: Training, share: float, number: int) -> Training:
    """``state`` after every learner, a partition of ``rows`` (doc_id, toxic, n, words), went once over its rows from there.

    A row of the table moves by the mean of what the learners that touched it made of it, weighed by their texts; all other weights by the mean of all
    learners. The means are made in a shuffle by blocks of the table, and the driver gets a table at most, whatever the input.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(state)  # 9 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic, words = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
            words += [np.frombuffer(w.as_buffer(), np.int32).reshape(-1, 2) for w in batch.column(3)]
        if not ids:
            return
        learner, before = TaskContext.get().partitionId(), shared.value
        own = copy.deepcopy(before)
        toxic = np.array(toxic, np.float32)
        weight = class_weights(toxic, share)
        order = np.array(sorted(range(len(ids)), key=lambda k: (ids[k], len(words[k]), zlib.crc32(words[k].tobytes()))))
        order = order[np.random.default_rng([7, number, learner]).permutation(len(order))]
        pick, size = [], 0
        for k in order.tolist():
            if pick and (len(pick) == BATCH or size + len(words[k]) > BATCH_WORDS):
                own.batch([words[j] for j in pick], toxic[pick], weight[pick])
                pick, size = [], 0
            pick.append(k)
            size += len(words[k])
        own.batch([words[j] for j in pick], toxic[pick], weight[pick])
        sums = own.squares["table"][:ROWS] - before.squares["table"][:ROWS]
        touched = np.flatnonzero(sums)
        change = np.column_stack([own.net.table[touched] - before.net.table[touched], sums[touched]]).astype(np.float32)
        cuts = np.searchsorted(touched, np.arange(0, ROWS + 1, BLOCK))
        out = [(-1, learner, len(ids), None, (own.dense() - before.dense()).tobytes())]
        out += [(b, learner, len(ids), (touched[x:y] - b * BLOCK).astype(np.int32).tobytes(), change[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                         names=["block", "learner", "n", "at", "change"])

    def mean(block: pa.Table) -> pa.Table:
        total, mass = None, None
        for r in block.sort_by("learner").to_pylist():
            if r["at"] is None:
                at, change = slice(None), np.frombuffer(r["change"], np.float64)[None]
                shape = change.shape
            else:
                at, change, shape = np.frombuffer(r["at"], np.int32), np.frombuffer(r["change"], np.float32).reshape(-1, DIMS + 1), (BLOCK, DIMS + 1)
            if total is None:
                total, mass = np.zeros(shape), np.zeros((shape[0], 1))
            total[at] += r["n"] * change.astype(np.float64)
            mass[at] += r["n"]
        moved = np.flatnonzero(mass)
        return pa.table({"block": block.column("block")[:1], "at": pa.array([moved.astype(np.int32).tobytes()], pa.binary()), "change": pa.array([(total[moved] / mass[moved]).tobytes()], pa.binary())})

    moves = rows.mapInArrow(run, "block int, learner int, n long, at binary, change binary").groupBy("block").applyInArrow(mean, "block int, at binary, change binary")
    after = copy.deepcopy(state)
    for r in moves.toArrow().to_pylist():
        change = np.frombuffer(r["change"], np.float64)
        if r["block"] < 0:
            after.move_dense(change)
            continue
        at, change = np.frombuffer(r["at"], np.int32) + r["block"] * BLOCK, change.reshape(-1, DIMS + 1)
        after.net.table[at] += change[:, :DIMS].astype(np.float32)
        after.squares["table"][at] += change[:, DIMS].astype(np.float32)
    shared.destroy()
    return after


def best_cuts(rows: DataFrame) -> DataFrame:
    """lang, cut, toxic, clean of every group of ``rows`` (lang, logit, toxic): ``best_cut`` over all of its rows, and how many of either class it has.

    Running counts are made inside slices of the logits and over the slices' totals, so no group is ordered in one task.
    """
    kinds = rows.groupBy("lang", "logit").agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean"))
    kinds = cut_lineage(kinds.withColumn("slice", F.floor(F.col("logit") * SLICES)))
    group = Window.partitionBy("_l")
    earlier = group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = kinds.groupBy(F.col("lang").alias("_l"), F.col("slice").alias("_s")).agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.min("logit").alias("least"))
    slices = slices.select("_l", "_s", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t_before"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c_before"),
                           F.sum("t").over(group).alias("t_all"), F.sum("c").over(group).alias("c_all"), F.lead("least").over(group.orderBy("_s")).alias("then"),
                           (F.row_number().over(group.orderBy("_s")) == 1).alias("first"), "least")
    met = kinds.join(slices, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("slice") == F.col("_s")))
    inside = Window.partitionBy("lang", "slice").orderBy("logit")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    after = F.coalesce(F.lead("logit").over(inside), F.col("then"), F.col("logit") + 2)
    wrong = F.col("t_before") + F.sum("toxic").over(upto) + F.col("c_all") - F.col("c_before") - F.sum("clean").over(upto)
    cuts = met.select("lang", "t_all", "c_all", "first", "least", "logit", after.alias("after"), wrong.alias("wrong"))
    edge = cuts.where(F.col("first") & (F.col("logit") == F.col("least"))).select("lang", "t_all", "c_all", F.col("c_all").alias("wrong"), F.lit(-2.0).alias("gap"), (F.col("logit") - 1).alias("cut"))
    cuts = cuts.select("lang", "t_all", "c_all", "wrong", (F.col("logit") - F.col("after")).alias("gap"), ((F.col("logit") + F.col("after")) / 2).alias("cut")).unionByName(edge)
    best = cuts.groupBy("lang").agg(F.min(F.struct("wrong", "gap", "cut")).alias("best"), F.first("t_all").alias("toxic"), F.first("c_all").alias("clean"))
    return best.select("lang", "best.cut", "toxic", "clean")


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network from all labelled rows that aren't held out; None if they don't hold both classes.

    A quarter of the rows, by a hash of doc_id, is kept from the gradient and calibrates: the cut with fewest errors becomes a score of 0.5, and each
    language with enough rows gets a threshold of its own. All others train, each row in every epoch; rows that repeat a doc_id count each. The number of
    learners grows with the text. Text alone makes the score.
    """
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"]).join(known, "doc_id")
    texts = texts.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0)
    counts = texts.groupBy("own", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).collect()  # four rows at most
    if len({r.toxic for r in counts}) < 2:
        return None
    splits = len(counts) == 4
    fits = texts.where(~F.col("own")) if splits else texts
    counted = [r for r in counts if not (splits and r.own)]
    learners = 1 + sum(r.bytes for r in counted) // LEARNER_BYTES
    share = sum(r.n for r in counted if r.toxic) / sum(r.n for r in counted)
    dealt = cut_lineage(_words(fits).repartitionById(learners, F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(learners)).cast("int")))
    state = Training.fresh(np.random.default_rng(7))
    for number in range(EPOCHS):
        state = epoch(dealt, state, share, number)
    net = state.net
    if not splits:
        return net
    seen = _logits(texts.where("own"), net).select("lang", "logit", "toxic")
    # the group of all rows has a name that no language can have, as languages are marked
    marked = seen.select(F.explode(F.array(F.lit("*"), F.concat(F.lit("="), "lang"))).alias("lang"), "logit", "toxic").where("lang IS NOT NULL")
    cuts = {r.lang: r.cut for r in best_cuts(marked).where((F.col("lang") == "*") | (F.least("toxic", "clean") >= LANGUAGE_ROWS)).collect()}  # a row for each such language
    net.shift = cuts.pop("*")
    net.thresholds = {name[1:]: float(1 / (1 + np.exp(net.shift - cut))) for name, cut in cuts.items()}
    return net


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network from a bounded sample of the labelled rows that aren't held out; None if they don't hold both classes.

    The sample is drawn by a hash of doc_id: SAMPLE_TOXIC and SAMPLE_CLEAN rows at most, about, whatever their length. A quarter of it, by hash, is kept
    from the gradient and calibrates: the cut with fewest errors becomes a score of 0.5, and each language with enough rows gets a threshold of
    its own; those rows are scored whole by tasks, and the driver gets a number for each. Of the others the gradient sees as many as hold
    SAMPLE_WORDS words together, in the order of their hash. Text alone makes the score.
    """
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") > 0, min(1.0, SAMPLE_TOXIC / counts[1])).otherwise(min(1.0, SAMPLE_CLEAN / counts[0]))
    drawn = known.where(F.expr("pmod(xxhash64(doc_id, 8), 1000003)") < share * 1000003)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"]).join(F.broadcast(drawn), "doc_id")  # bounded by the sample
    texts = cut_lineage(texts.withColumn("order", F.xxhash64("doc_id", F.lit(9))))
    classes = {(r["own"], r["toxic"]) for r in texts.select((F.pmod("order", F.lit(4)) == 0).alias("own"), "toxic").distinct().collect()}  # four rows at most
    if len({toxic for _, toxic in classes}) < 2:  # labels without a document
        return None
    splits = len(classes) == 4
    fits = texts.where(F.pmod("order", F.lit(4)) != 0) if splits else texts
    sizes = _words(fits).drop("words").toPandas().merge(fits.select("doc_id", "order").distinct().toPandas(), on="doc_id").sort_values(["order", "n"]).drop_duplicates("doc_id")
    taken, left = [], SAMPLE_WORDS
    for doc_id, n in zip(sizes.doc_id, sizes.n, strict=True):
        if n <= left:
            taken.append(int(doc_id))
            left -= n
    rows = _words(fits.where(F.col("doc_id").isin(taken)) if len(taken) < len(sizes) else fits).toPandas().sort_values(["doc_id", "words"]).drop_duplicates("doc_id")
    if rows.toxic.nunique() < 2:  # one text of a class is longer than all that the gradient may see
        return None
    net = fit([np.frombuffer(w, np.int32).reshape(-1, 2) for w in rows.words], rows.toxic.to_numpy().astype(np.float32))
    if not splits:
        return net
    seen = _logits(texts.where(F.pmod("order", F.lit(4)) == 0), net).toPandas().sort_values(["doc_id", "logit"]).drop_duplicates("doc_id")
    logits, truth, lang = seen.logit.to_numpy(), seen.toxic.to_numpy().astype(np.float32), seen.lang.to_numpy()
    net.shift = best_cut(logits, truth)
    for name in {x for x in lang if isinstance(x, str)}:
        own = lang == name
        if min((truth[own] > 0).sum(), (truth[own] <= 0).sum()) >= LANGUAGE_ROWS:
            net.thresholds[name] = float(1 / (1 + np.exp(net.shift - best_cut(logits[own], truth[own]))))
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, toxic of every row of ``docs`` (doc_id, text, lang).

    score is made from the whole text alone; predicted is score >= 0.5; threshold is the one calibrated for the row's language (0.5
    where there is none or lang is null) and toxic applies it. A null text is an empty one, without words. Without a network
    every score is 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(2)):
                values = own.scores(*word_rows(data, offsets)) if own else np.zeros(last - first)
                thresholds = [own.thresholds.get(x, 0.5) if own else 0.5 for x in batch.column(1).slice(first, last - first).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(values), pa.array(thresholds, pa.float64())],
                                                 names=["doc_id", "score", "threshold"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double, threshold double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold",
                         (F.col("score") >= F.col("threshold")).alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
