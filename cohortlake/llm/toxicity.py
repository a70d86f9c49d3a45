"""Toxicity by compression distance: which zstandard dictionary shortens a window more.

One dictionary is trained on windows of ordinary text, one on windows of toxic text. The toxic one is put before the ordinary
one, so ordinary words cost the same under both and only toxic matter tells them apart. Beside it a third holds single telling
words (those far more frequent in toxic text), joined rather than trained, as the trainer passes over words that are rare in
the toxic text as a whole. A document is cut in windows of eight words; from the bytes that each window saves under either
toxic dictionary come a few features, and a logistic curve calibrated on documents that the dictionaries were not trained on
gives the score.

The dictionaries are trained on a bounded sample: SAMPLE labelled documents of each class, chosen by a hash of doc_id, none
of the held-out fold, and of their windows WINDOWS of each class and half, chosen by a hash of the window. The sampled documents are
taken whole whatever their length; their texts stay in the tasks, which send windows, telling words and features only.
Everything else covers whole texts of all documents.

Defined results: null and empty texts have no windows and get the score of a text without any toxic saving; if labels of
either class are missing, every score is 0; labels that are null or neither 0 nor 1 are ignored; a doc_id with several
labels counts as toxic if one of them is; rows without doc_id are not held out; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import common

#: Labelled documents of each class to learn from, and windows of each class and half of them.
SAMPLE = 4000
WINDOWS = 30_000
#: Text that a task takes apart at a time when learning; words as objects take some fifty times as much.
LEARN_BYTES = 1 << 18
#: Words a window.
WINDOW = 8
#: Bytes of either trained dictionary.
DICTIONARY_BYTES = 8192
#: A word is telling if it stands in this many surroundings for each toxic document, and so many times rarer in ordinary ones.
TELLING_SHARE = 0.004
TELLING_RATIO = 40
#: zstandard level, and the shortest match it looks for.
LEVEL = 12
MIN_MATCH = 3


def windows(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def _trained(samples: list[bytes]) -> bytes:
    """Content of a dictionary trained on samples; where they are too few for training, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=6, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))


class Dictionaries:
    """The ordinary, the toxic and the telling dictionary; savings() compares window lengths under them."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], telling: list[bytes]) -> None:
        """From windows of either class, and telling words, the most telling last."""
        trained = []
        for windows_ in (ordinary, toxic):
            shuffled = sorted(windows_)
            random.Random(7).shuffle(shuffled)
            trained.append(_trained(shuffled))
        self.ordinary, self.toxic = trained
        self.telling = b"".join(b" " + w + b" " for w in telling)
        self._open()

    def _open(self) -> None:
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_dict_id=False)
        make = lambda content: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
        self.plain, self.marked = make(self.ordinary), [make(first + self.ordinary) for first in (self.telling, self.toxic)]

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic, "telling": self.telling}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that each window saves under the telling words (first row) and under toxic text (second row)."""
        plain, (words, toxic) = self.plain.compress, (m.compress for m in self.marked)
        cut = windows(text)
        lengths = [len(plain(w)) for w in cut]
        return np.array([[n - len(c(w)) for n, w in zip(lengths, cut, strict=True)] for c in (words, toxic)], np.int64)


def features(savings: np.ndarray) -> list[float]:
    """For each toxic dictionary: largest saving, and by word count the mean saving and the shares of windows that save 3 and 5 bytes."""
    if not savings.size:
        return [0.0] * 10
    out = []
    for own in savings:
        top = np.sort(own)[-3:]
        out += [float(top[-1]), float(top.sum()) / 3, 10 * float(own.clip(0).mean()), 100 * float((own >= 3).mean()), 100 * float((own >= 5).mean())]
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = 1e-2 * np.r_[0, np.ones(x.shape[1] - 1)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class ToxicityModel:
    """Dictionaries and a calibrated curve."""

    def __init__(self, dictionaries: Dictionaries, beta: np.ndarray) -> None:
        self.dictionaries, self.beta = dictionaries, beta

    def score(self, text: str | None) -> float:
        z = self.beta[0] + float(np.dot(self.beta[1:], features(self.dictionaries.savings(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, half, h, w): all windows with a hash."""
    for batch in common.chunks(batches, limit=LEARN_BYTES):
        rows = [(t, f, xxhash.xxh64_intdigest(w) >> 1, w) for t, f, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "half", "text")), strict=True) for w in windows(text)]
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["toxic", "half", "h", "w"])


def _surroundings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, half, w, h): words, and hashes of the words on either side with them, each once for a text."""
    for batch in common.chunks(batches, limit=LEARN_BYTES):
        rows = []
        for t, f, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "half", "text")), strict=True):
            words = [b"", *text.encode("utf-8", "surrogatepass").lower().split(), b""]
            rows += [(t, f, x[1], xxhash.xxh64_intdigest(b" ".join(x)) >> 1) for x in set(zip(words, words[1:], words[2:], strict=False))]
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["toxic", "half", "w", "h"])


def _measured(halves: list[Dictionaries]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(toxic, x): features of each text under the dictionaries of the other half."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            found = [features(halves[1 - f].savings(t)) for f, t in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def _telling(rows: DataFrame, sizes: dict[tuple[int, int], int]) -> list[list[bytes]]:
    """The telling words of either half and of both (part 2). Surroundings are counted once, so that copies count once.

    A word comes here only where it stands in TELLING_SHARE surroundings for each toxic document and is TELLING_RATIO
    times rarer in ordinary ones.
    """
    each = rows.mapInArrow(_surroundings, "toxic int, half int, w binary, h long").select("toxic", "w", "h", F.explode(F.array("half", F.lit(2))).alias("part")).distinct()
    counts = each.groupBy("part", "w").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("o"))
    test = F.lit(False)
    for part in (0, 1, 2):
        toxic, ordinary = (sum(n for (k, half), n in sizes.items() if k == c and part in (half, 2)) for c in (1, 0))
        test |= (F.col("part") == part) & (F.col("t") >= max(2, math.ceil(TELLING_SHARE * toxic))) & (F.col("t") * ordinary >= TELLING_RATIO * toxic * (F.col("o") + 0.5))
    found: list[list[tuple]] = [[], [], []]
    for r in counts.where(test).collect():
        found[r["part"]].append((r["t"], bytes(r["w"])))
    return [[w for _, w in sorted(own)] for own in found]


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """Fits on SAMPLE documents of each class at most; None if either half of a class is missing."""
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(common.held() != 0)
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order).limit(SAMPLE).union(known.where("toxic = 0").orderBy(order).limit(SAMPLE))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")
    rows = common.written(docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id").select("toxic", half, "text").repartition(32), "labelled")
    sizes = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 4:
        return None
    cut = common.written(rows.mapInArrow(_cut, "toxic int, half int, h long, w binary"), "windows")
    sampled = {}
    for toxic, own in sizes:
        sampled[toxic, own] = [bytes(r["w"]) for r in cut.where((F.col("toxic") == toxic) & (F.col("half") == own)).orderBy("h", "w").limit(WINDOWS).select("w").collect()]
    telling = _telling(rows, sizes)
    halves = [Dictionaries(sampled[1, h], sampled[0, h], telling[h]) for h in (0, 1)]
    measured = rows.mapInArrow(_measured(halves), "toxic int, x array<double>").toPandas()  # a row a sampled document
    measured = measured.assign(key=[tuple(x) for x in measured["x"]]).sort_values(["toxic", "key"])
    beta = _logistic(np.array(measured["x"].tolist()), measured["toxic"].to_numpy())
    # the sample has more toxic documents than the labels: the curve is moved to the share that the labels have
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = [sizes[c, 0] + sizes[c, 1] for c in (0, 1)]
    beta[0] += math.log(share[1] / share[0]) - math.log(taken[1] / taken[0])
    return ToxicityModel(Dictionaries(sampled[1, 0] + sampled[1, 1], sampled[0, 0] + sampled[0, 1], telling[2]), beta)


def _scores(model: ToxicityModel | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            found = [model.score(t) if model else 0.0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = docs.select("doc_id", (common.held() == 0).alias("held_out"), "text").mapInArrow(_scores(learn(docs, labels)), "doc_id long, held_out boolean, text string, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, unchanged."""
    model = learn(docs, labels)
    columns = docs.columns

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.remember("toxicity", lambda: None)
        for batch in common.chunks(batches):
            yield batch.filter(pa.array([model is None or model.score(t) < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema).select(*columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
