"""Language ID by nearest centroid over normalised TF-IDF vectors of character n-grams.

Letters are lower-cased, runs of anything else become one space; n-grams of one to three characters
are hashed to DIMENSIONS. Document frequencies come from all documents to learn from. Each language
has several centroids, made by spherical k-means on a bounded sample of its documents. A document
gets the language of the centroid with the largest cosine; one that is much further from it than any
document of the sample with about as many different n-grams is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docquarry.llm.common import BROADCAST_ROWS, slices

NAME = "op1_language_id"
SQL = None  # vectors and clusters: held-out accuracy is tested

DIMENSIONS = 8192
#: The most sampled documents of a language, and of all unless there are more languages; centroids of a language; rounds of k-means.
PER_LANGUAGE, SAMPLED, CENTROIDS, ROUNDS = 400, 40_000, 4, 12
#: A document is rejected below this part of the smallest cosine in the sample; the largest richness.
REJECT, RICHEST = 0.4, DIMENSIONS.bit_length()
UNKNOWN = "und"
#: Longest n-gram; odd factors that mix 32-bit codes.
ORDERS, SPACE = 3, 32
FACTORS = (np.uint32(0x01000193), np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


class Features:
    """Hashed n-gram counts of a text; the table of letters is made once per worker."""

    def __init__(self):
        self.letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(dimensions, counts), or None without a letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letters[codes]
        if not letter.any():
            return None
        codes = np.where(letter, codes, SPACE)[letter | np.concatenate(([True], letter[:-1]))]  # one space for each run
        codes = np.concatenate(([SPACE], codes[int(codes[0] == SPACE) :], [SPACE][: int(codes[-1] != SPACE)])).astype(np.uint32)
        hashed, grams = codes, []
        for order in range(1, ORDERS + 1):
            if order > 1:
                hashed = hashed[:-1] * FACTORS[0] + codes[order - 1 :]
            mixed = (hashed + np.uint32(order)) * FACTORS[1]
            grams.append((mixed ^ (mixed >> np.uint32(15))) * FACTORS[2] % np.uint32(DIMENSIONS))
        bins = np.bincount(np.concatenate(grams), minlength=DIMENSIONS)
        at = np.flatnonzero(bins)
        return at, bins[at]

    def vector(self, text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(dimensions, weights) of length 1."""
        found = self.counts(text)
        if found is None:
            return None
        at, n = found
        weights = np.log1p(n) * idf[at]
        length = np.sqrt(weights @ weights)
        return (at, weights / length) if length > 0 else None


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    of: np.ndarray  # the language of each centroid
    centroids: np.ndarray  # a row per dimension
    least: np.ndarray  # by richness, the cosine below which a document is rejected


def richness(at: np.ndarray) -> int:
    """The number of different n-grams in powers of two."""
    return len(at).bit_length()


def frequencies(batches):
    features, seen, n = Features(), np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if (found := features.counts(text.as_py())) is not None:
                seen[found[0]] += 1
                n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *seen[at]], pa.int64())], ["dimension", "n"])


def vectors(idf: np.ndarray):
    def run(batches):
        features = Features()
        for batch in batches:
            rows = [(lang, v) for text, lang in zip(*batch.columns, strict=True) if (v := features.vector(text.as_py(), idf)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang.as_py() for lang, _ in rows], pa.string()), pa.array([v[0].astype("<i4").tobytes() for _, v in rows], pa.binary()), pa.array([v[1].astype("<f4").tobytes() for _, v in rows], pa.binary())],
                ["lang", "at", "weights"],
            )

    return run


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; the first centres are far apart, and nothing is random."""
    centre = x.mean(0)
    chosen = [int(np.argmax(x @ centre))]
    nearest = x @ x[chosen[0]]
    for _ in range(1, min(k, len(x))):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, 1)
        for c in range(len(centres)):
            if (of == c).any():
                centre = x[of == c].mean(0)
                centres[c] = centre / max(np.linalg.norm(centre), 1e-12)
    return centres


def fit(learn: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learns from all rows of learn (id, text, lang); every language of theirs that has a text with a letter can be predicted.

    The sample takes a language's documents by a hash of id and text, per_language of them or fewer.
    The driver holds a sparse vector of each, and the model a dense one of each centroid.
    """
    spark = learn.sparkSession
    learn = learn.where("lang is not null")
    seen = learn.select("text").mapInArrow(frequencies, "dimension int, n long").groupBy("dimension").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS + 1 at most
    df, n = np.zeros(DIMENSIONS), 0
    for r in seen:
        if r["dimension"] < 0:
            n = r["n"]
        else:
            df[r["dimension"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1.0
    dealt = learn.where(F.col("text").rlike(r"\p{L}")).withColumn("dealt", F.xxhash64("id", "text"))
    sizes = dealt.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("dealt").alias("first")).collect()  # a row for each language
    per_language = max(1, min(per_language, SAMPLED // max(1, len(sizes))))
    rates = [(r["lang"], min(1.0, 2 * per_language / r["n"]), r["first"]) for r in sizes]
    if not rates:
        return Model(idf, [], np.zeros(0, int), np.zeros((DIMENSIONS, 0), np.float32), np.zeros(RICHEST + 1))
    among = spark.createDataFrame(rates, "lang string, rate double, first long")
    among = F.broadcast(among) if len(rates) <= BROADCAST_ROWS else among
    low = (F.pmod("dealt", F.lit(1_000_003)) / 1_000_003.0 < F.col("rate")) | (F.col("dealt") == F.col("first"))  # each language has one at least
    some = dealt.join(among, "lang").where(low)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("dealt"))
    sample = some.withColumn("_n", first).where(F.col("_n") <= per_language).select("text", "lang").mapInArrow(vectors(idf), "lang string, at binary, weights binary")
    by: dict[str, list] = {}
    for r in sample.collect():  # per_language a language at most
        by.setdefault(r["lang"], []).append((np.frombuffer(r["at"], "<i4"), np.frombuffer(r["weights"], "<f4")))
    languages, made, of = sorted(by), [], []
    for k, lang in enumerate(languages):
        rows = sorted(by[lang], key=lambda v: (v[0].tobytes(), v[1].tobytes()))
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, (at, weights) in enumerate(rows):
            x[i, at] = weights
        full = x[np.argsort([-len(at) for at, _ in rows], kind="stable")[: max(centroids, len(rows) * 3 // 4)]]  # the shortest texts make poor centres
        centres = cluster(full, centroids)
        made += list(centres)
        of += [k] * len(centres)
    model = Model(idf, languages, np.array(of), np.ascontiguousarray(np.array(made, np.float32).T), np.zeros(RICHEST + 1))
    nearest = [(richness(at), float(np.max(weights @ model.centroids[at]))) for rows in by.values() for at, weights in rows]
    most = max((k for k, _ in nearest), default=0)
    for k in range(RICHEST + 1):
        model.least[k] = REJECT * min((cosine for r, cosine in nearest if abs(r - min(k, most)) <= 1), default=0.0)
    return model


def predict(model: Model, text_at: int, names: list[str]):
    """Adds lang_pred, score (cosine) and rejected to rows."""

    def run(batches):
        features = Features()
        for batch in slices(batches):
            langs, scores, rejected = [], [], []
            for text in batch.column(text_at):
                v = features.vector(text.as_py(), model.idf) if model.languages else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                cosines = v[1].astype(np.float32) @ model.centroids[v[0]]
                k = int(np.argmax(cosines))
                lang, cosine = int(model.of[k]), float(cosines[k])
                langs.append(model.languages[lang])
                scores.append(min(1.0, max(0.0, cosine)))
                rejected.append(cosine < float(model.least[richness(v[0])]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names)

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, keep: list[str], model: Model | None = None) -> DataFrame:
    """kept (a struct of the kept columns of docs, text among them) with lang_pred, score and rejected.

    Without a model, one is learned from the text and lang of the rows whose doc_id is not held out
    (null ids are not). A null text or one without a letter is `und`, rejected, with score 0; so is
    every text if nothing can be learned. Kept columns may have any names.
    """
    if model is None:
        known = docs.where(~held_out(docs["doc_id"]))
        model = fit(known.select(known["doc_id"].cast("string").alias("id"), known["text"].alias("text"), known["lang"].alias("lang")))
    kept = docs.select(*[docs[c].alias(f"_{i}") for i, c in enumerate(keep)])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    found = kept.mapInArrow(predict(model, keep.index("text"), schema.names), schema)
    return found.select(F.struct(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]).alias("kept"), "lang_pred", "score", "rejected")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, ["doc_id", "text"])
    return found.select("kept.doc_id", held_out(F.col("kept.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
