"""Toxicity by class-conditional Kneser-Ney models of word forms.

Each class has an interpolated Kneser-Ney model of the bytes of a word given the bytes before them, up to ``ORDER - 1`` back
to the word's start. The highest order is counted by class; all lower orders are continuation counts that both classes
share, so that rare expressions are smoothed alike and cancel, while a word form that is common in one class alone, or
resembles one, does not. A text's evidence is the difference of its log-likelihoods divided by its number of words, in all and in strongly toxic words. A
logistic curve, fitted to labelled rows that were not counted, turns it into a probability.

Word counts are gathered from all labelled rows that may be learned from, whole texts, on Spark; n-grams come from the
counted words. Where neither class has seen an n-gram, the classes' difference depends on its context alone, so the model
holds seen n-grams and contexts only, all of them: it is a table in the shared folder that tasks read in sorted chunks, so
its size bounds no result and no memory.

Defined results: null and empty texts have score 0. A row without an id has no label and a null ``held_out``. Texts are scored one by one, whole, equal or not. Labels that are null
are ignored; of several labels for one id the largest holds. Without any labels of both classes every score is 0. An empty
table gives an empty result. Extra columns, whatever their names, are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkit
from .common import in_slots, materialized, new_folder, partitions, texts, with_rest, without_rest

ORDER = 6
DISCOUNT = 0.75
#: Observations that the shared model counts for in every context of a class.
SHARED_MASS = 8.0
#: Entries of a model that a worker keeps from block to block of a task; larger ones are read anew for each block, with the same results.
KEPT_ENTRIES = 1 << 21
#: Labelled rows, about, to which the curve is fitted; under twice as many.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
#: Log-ratio from which a single word counts as strong evidence; three times as much counts fully.
STRONG = 2.0
U64 = np.uint64


def fold(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, n) of lower-cased words, summed inside tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in textkit.blocks(batches):
            words = textkit.Words(data, offs, lower=True)
            toxic = rows.column(2).to_numpy(zero_copy_only=False)[words.row]
            kind, n = np.unique(2 * words.number[0] + toxic, return_counts=True)
            word = pa.array(words.distinct, pa.binary()).take(pa.array(kind // 2))
            yield pa.RecordBatch.from_arrays([word, pa.array((kind % 2).astype(np.int32)), pa.array(n)], names=["word", "toxic", "n"])

    return labelled.mapInArrow(run, "word binary, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def _grams(counts: DataFrame) -> DataFrame:
    """(gram, toxic, n): the n-grams of the counted words; a word begins and ends with a space, and an n-gram never reaches before its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[bytes, int], int] = {}
            for word, toxic, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                text = b" " + word + b" "
                for end in range(2, len(text) + 1):
                    key = (text[max(0, end - ORDER) : end], toxic)
                    held[key] = held.get(key, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.binary()), pa.array([k[1] for k in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["gram", "toxic", "n"])

    return counts.mapInArrow(run, "gram binary, toxic int, n long").groupBy("gram").pivot("toxic", [0, 1]).agg(F.sum("n")).select("gram", F.coalesce(F.col("0"), F.lit(0)).alias("n0"), F.coalesce(F.col("1"), F.lit(0)).alias("n1"))


def _shared(grams: DataFrame) -> DataFrame:
    """(gram, p): the shared probability of a gram's last byte after the bytes before it less the first: interpolated over continuation counts."""
    cut = lambda c: F.expr(f"substring({c}, 2, length({c}) - 1)")
    head = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    # Distinct left extensions of each shorter n-gram, from the level above. A gram that starts at its word has no left extension but itself.
    levels = [grams.select(F.col("gram").alias("g"))]
    for _ in range(ORDER - 1):
        shorter = levels[-1].filter("length(g) > 1").select(cut("g").alias("g"))
        levels.append(materialized(shorter.groupBy("g").agg(F.count("*").alias("c")).filter("length(g) > 0"), "toxicity-level").select("g", "c"))
    counted = levels[1]
    for more in levels[2:]:
        counted = counted.unionByName(more)
    counted = materialized(counted.groupBy("g").agg(F.max("c").alias("c")), "toxicity-shared")
    context = counted.groupBy(head("g").alias("h")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    rows = counted.withColumn("h", head("g")).join(context, "h").withColumn("own", F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.col("total")).withColumn("rest", DISCOUNT * F.col("kinds") / F.col("total"))
    rows = materialized(rows.select("g", "own", "rest"), "toxicity-shared")
    p = rows.filter("length(g) = 1").select("g", (F.col("own") + F.col("rest") / 256).alias("p"))
    done = p
    for n in range(2, ORDER):
        lower = p.select(F.col("g").alias("low"), F.col("p").alias("p_low"))
        p = rows.filter(f"length(g) = {n}").withColumn("low", cut("g")).join(lower, "low", "left").select("g", (F.col("own") + F.col("rest") * F.coalesce("p_low", F.lit(1 / 256))).alias("p"))
        p = materialized(p, "toxicity-order")
        done = done.unionByName(p)
    return done


def fit_model(labelled: DataFrame) -> DataFrame:
    """(entry, value): log-ratios of the classes for seen n-grams, and, for contexts, of the mass that each leaves to unseen ones.

    labelled: doc_id, text, toxic. An entry is an n-gram, or a context with a byte 0 behind it (no word has one there).
    """
    grams = materialized(_grams(_word_counts(labelled)), "toxicity-grams")
    head = F.expr("substring(gram, 1, length(gram) - 1)")
    both = [F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1")]
    context = grams.groupBy(head.alias("h")).agg(*[F.sum(n).alias(f"t{k}") for k, n in enumerate(both)], *[F.sum((n > 0).cast("int")).alias(f"k{k}") for k, n in enumerate(both)])
    left = [(DISCOUNT * F.col(f"k{k}") + SHARED_MASS) / (F.col(f"t{k}") + SHARED_MASS) for k in (0, 1)]
    context = context.select("h", "t0", "t1", "t2", "k2", left[0].alias("l0"), left[1].alias("l1"))
    low = _shared(grams).select(F.col("g").alias("low"), "p")
    seen = grams.withColumn("h", head).withColumn("low", F.expr("substring(gram, 2, length(gram) - 1)")).join(context, "h").join(low, "low", "left")
    # The highest order of both classes together, over the shared lower orders; each class backs off to it.
    shared = (F.greatest(F.col("n0") + F.col("n1") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("k2") * F.coalesce("p", F.lit(1 / 256))) / F.col("t2")
    p = [F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0.0)) / (F.col(f"t{k}") + SHARED_MASS) + F.col(f"l{k}") * shared for k in (0, 1)]
    entries = seen.select(F.col("gram").alias("entry"), F.log(p[1] / p[0]).alias("value"))
    contexts = context.select(F.concat("h", F.lit(b"\0")).alias("entry"), F.log(F.col("l1") / F.col("l0")).alias("value"))
    return entries.unionByName(contexts)


def entry_keys(entries: pa.Array) -> np.ndarray:
    data, offs = textkit.text_bytes(entries)
    return textkit.spans_hash(textkit.prefix_sums(textkit.byte_codes(data)), offs[:-1], offs[1:])


def _hashed(model: DataFrame) -> DataFrame:
    """The model with 64-bit keys for its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(entry_keys(batch.column(0)).view(np.int64)), batch.column(1)], names=["key", "value"])

    return model.mapInArrow(run, "key long, value double")


def written(model: DataFrame) -> Scorer:
    """A scorer of the whole model, which is written to the shared folder, by hashed key."""
    spark = model.sparkSession
    folder = new_folder(spark, "toxicity-model")
    _hashed(model).repartition(partitions(spark), "key").sortWithinPartitions("key").write.parquet(folder)
    store, path = fs.FileSystem.from_uri(folder)
    files = sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet"))
    return Scorer(folder, files)


#: The chunks of the model that a worker keeps for a task, by folder.
_KEPT: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}


class Scorer:
    """Sums of log-ratios of rows' words, by a table of hashed entries in files sorted by key."""

    def __init__(self, folder: str, files: list[str], kept: int = KEPT_ENTRIES):
        self.folder, self.files, self.kept = folder, files, kept

    def _chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.folder in _KEPT:
            yield from _KEPT[self.folder]
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        held, n = [], 0
        for path in self.files:
            with store.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(1 << 17, columns=["key", "value"]):
                    chunk = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()
                    # Files are sorted as signed numbers; from here on as unsigned ones.
                    order = np.argsort(chunk[0], kind="stable")
                    chunk = chunk[0][order], chunk[1][order]
                    n += len(chunk[0])
                    held = [*held, chunk] if n <= self.kept else []
                    yield chunk
        if n <= self.kept:
            _KEPT.clear()
            _KEPT[self.folder] = held

    def _values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of keys, 0 for unknown ones, and which are known."""
        wanted, which = np.unique(keys, return_inverse=True)
        value, known = np.zeros(len(wanted)), np.zeros(len(wanted), bool)
        for held, values in self._chunks():
            if len(held) and len(wanted):
                at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                hit = held[at] == wanted
                value[hit], known = values[at[hit]], known | hit
        return value[which], known[which]

    def evidence(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's words: the mean log-ratio, and the mean of what single words have beyond STRONG; 0 without words."""
        words = textkit.Words(data, offs, lower=True)
        if not len(words.start):
            return np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        which, at = words.number
        start, size = words.start[at], words.end[at] - words.start[at]
        # The distinct words, each between spaces, and a 0 behind for the contexts' own entries.
        begin = np.append(0, np.cumsum(size + 2))
        text = np.full(begin[-1], 32, np.uint8)
        place = np.repeat(begin[:-1] + 1 - np.append(0, np.cumsum(size))[:-1], size) + np.arange(int(size.sum()))
        text[place] = words.data[np.repeat(start - np.append(0, np.cumsum(size))[:-1], size) + np.arange(int(size.sum()))]
        number = np.repeat(np.arange(len(size)), size + 1)
        end = np.arange(len(number)) + number + 2
        first = np.maximum(begin[:-1][number], end - ORDER)
        codes = textkit.byte_codes(text)
        sums = textkit.prefix_sums(codes)
        grams = textkit.spans_hash(sums, first, end)
        zero = textkit.byte_codes(np.zeros(1, np.uint8))[0]
        raw = (sums[end - 1] - sums[first]) * textkit.powers(len(sums))[1][first]
        length = (end - 1 - first).astype(np.int64)
        contexts = textkit.mix(raw + zero * textkit.powers(len(sums))[0][length] + (length + 1).astype(U64) * U64(0x8EBC6AF09C88C6E3))
        # Unseen n-grams have their context's value.
        value, known = self._values(np.concatenate([grams, contexts]))
        value = np.where(known[: len(grams)], value[: len(grams)], value[len(grams) :])
        by_word = np.bincount(number, weights=value, minlength=len(size))
        n = np.diff(words.first)
        by_row = lambda x: np.bincount(words.row, weights=x[which], minlength=len(n)) / np.maximum(n, 1)
        return by_row(by_word), by_row(np.clip(by_word - STRONG, 0, 2 * STRONG))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression of y on the columns of x and a constant, by Newton's method, a little regularised."""
    scale = np.append(np.maximum(x.std(0), 1e-9), 1.0)
    z = np.column_stack([x, np.ones(len(x))]) / scale
    ridge = np.append(np.full(x.shape[1], 0.05), 1e-6)
    w = np.zeros(len(scale))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


_EVIDENCE = "doc_id long, evidence double, strong double, n_words long"


def _evidence(rows: DataFrame, scorer, first: int = 2) -> DataFrame:
    """doc_id, evidence, strong, n_words and the columns of ``rows`` (doc_id, text, ...) from number ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in textkit.blocks(batches):
            n = np.diff(textkit.Words(data, offs).first)
            arrays = [part.column(0), *map(pa.array, scorer.evidence(data, offs)), pa.array(n), *part.columns[first:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "evidence", "strong", "n_words", *part.schema.names[first:]])
        # Workers are used again by other operators.
        _KEPT.clear()
        textkit.release()

    return rows.mapInArrow(run, StructType([*StructType.fromDDL(_EVIDENCE).fields, *rows.schema.fields[first:]]))


def _fitted(docs: DataFrame, labels: DataFrame) -> tuple[Scorer, Column]:
    """The scorer, and the score of evidence. Labels of held-out rows (crc32 of the id mod 4 = 2) are never read."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold() != 2)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = in_slots(texts(docs).filter(fold() != 2), marks).join(marks, "doc_id").select("doc_id", "text", "toxic")
    step = max(1, marks.filter(fold() == 3).count() // CALIBRATION_ROWS)
    calibrates = (fold() == 3) & (F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    scorer = written(fit_model(labelled.filter(~calibrates)))
    sample = labelled.filter(calibrates).filter("length(text) > 0")
    held = _evidence(sample, scorer).select("evidence", "strong", "toxic").toArrow()
    x, y = np.column_stack([held.column(c).to_numpy() for c in ("evidence", "strong")]), held.column("toxic").to_numpy().astype(float)
    weights = _curve(x, y) if 0 < y.sum() < len(y) else [0.0, 0.0, -30.0]
    linear = F.col("evidence") * float(weights[0]) + F.col("strong") * float(weights[1]) + float(weights[2])
    return scorer, F.when(F.col("n_words") > 0, 1 / (1 + F.exp(-linear))).otherwise(0.0)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a row of ``docs``."""
    scorer, score = _fitted(docs, labels)
    out = _evidence(texts(docs), scorer).withColumn("score", score)
    return out.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence", "strong")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, scored in one pass that carries them along."""
    scorer, score = _fitted(docs, labels)
    return without_rest(_evidence(with_rest(docs), scorer, 1).filter(score < THRESHOLD), docs.columns)
