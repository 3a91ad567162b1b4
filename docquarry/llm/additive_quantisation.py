"""Approximate nearest neighbours by additive quantisation, largest inner product first.

A vector is the sum of one full-dimensional codeword from each of BOOKS codebooks. The codebooks are
trained on a bounded sample: k-means on residuals, then a round of beam-search encoding and means.
Every different vector is encoded by beam search and stored with its codes and the ratio of its norm
to the decoded one's, which scales a reconstruction to the length of what it stands for. A query
makes one table of its inner products with all codewords, and a row's score is a sum of BOOKS
entries. The RERANK best of a query are joined with their original vectors and scored exactly.

The queries meet all codes block by block, in a grid of cells that get codes and queries, never
the rows' vectors. Work on the grid is queries times rows, as every row is a candidate of every
query; a cell returns few rows for each query. Equal vectors are one row of the grid and carry
their k + 1 smallest ids, more of which no result can have, so a group of copies crowds nothing out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import Workspace, hot_join, with_row_id

NAME = "op10_additive_quantisation"
SQL = None  # approximate: recall is tested against brute force

BOOKS, WORDS, BEAM = 24, 256, 4
#: The most rows the codebooks are trained on; rounds of k-means, and of means after encoding by beam search.
SAMPLE, ROUNDS, REFINE = 16_384, 5, 1
#: Different vectors that are reranked for a query; neighbours returned; one in so many ids is a query.
RERANK, K, EVERY = 100, 20, 20
#: Pairs of a row and a query in a cell, about, and the fewest cells.
CELL, LEAST_CELLS = 2**36, 16
#: Rows and queries that are scored at a time.
ROWS_AT_A_TIME, QUERIES_AT_A_TIME = 2048, 128


def nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmax(x @ words.T - (words**2).sum(1) / 2, 1)


def means(x: np.ndarray, of: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The mean of the rows of each word; words without rows stay."""
    order, n = np.argsort(of, kind="stable"), np.bincount(of, minlength=len(words))
    out, used = words.copy(), n > 0
    starts = np.cumsum(n)[used] - n[used]
    out[used] = np.add.reduceat(x[order], starts, axis=0) / n[used, None]
    return out


def kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        centres = means(x, nearest_word(x, centres), centres)
    return centres


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = BEAM) -> np.ndarray:
    """Codes by beam search: of all continuations of a vector's beam, those with the smallest error stay."""
    n = len(x)
    codes, left = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
    for book in books:
        half = (book**2).sum(1) / 2
        gain = left @ book.T - half  # larger is nearer; the error falls by twice this
        error = (left**2).sum(2)[:, :, None] - 2 * gain
        flat = error.reshape(n, -1)
        take = min(beam, flat.shape[1])
        best = np.argpartition(flat, take - 1, 1)[:, :take]
        came, word = best // len(book), best % len(book)
        row = np.arange(n)[:, None]
        codes = np.concatenate([codes[row, came], word[:, :, None].astype(np.uint8)], 2)
        left = left[row, came] - book[word]
    final = np.argmin((left**2).sum(2), 1)
    return codes[np.arange(n), final]


def decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def train(x: np.ndarray, n_books: int = BOOKS, words: int = WORDS) -> list[np.ndarray]:
    x = x.astype(np.float32)
    left, books = x, []
    for _ in range(n_books):
        books.append(kmeans(left, words, ROUNDS))
        left = left - books[-1][nearest_word(left, books[-1])]
    for _ in range(REFINE):
        codes = np.concatenate([encode(x[k : k + 1024], books) for k in range(0, len(x), 1024)])
        left = x - decode(codes, books)
        for m, book in enumerate(books):  # each book to the means of what the others leave
            target = left + book[codes[:, m]]
            books[m] = means(target, codes[:, m], book)
            left = target - books[m][codes[:, m]]
    return books


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id and vector of rows with an id and a vector without nulls, not all zero and finite throughout."""
    named = vectors.select(vectors[key].cast("long").alias("id"), vectors[column].alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return named.where("id is not null and vector is not null and size(vector) > 0").where(~odd & F.exists("vector", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def encode_rows(books: list[np.ndarray]):
    """(vector, members) to (vector, members, codes, scale): scale is the norm over the decoded vector's."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                x = matrix(part.column(0))
                codes = encode(x.astype(np.float32), books)
                made = np.sqrt((decode(codes, books).astype(np.float64) ** 2).sum(1))
                scale = np.sqrt((x.astype(np.float64) ** 2).sum(1)) / np.maximum(made, 1e-12)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32))], ["vector", "members", "codes", "scale"])

    return run


def best_of(query: np.ndarray, row: np.ndarray, score: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The depth best entries of each query, best first."""
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    place = np.arange(len(query)) - np.repeat(starts, np.diff([*starts, len(query)]))
    kept = place < depth
    return query[kept], row[kept], score[kept]


def scan(q: np.ndarray, codes: np.ndarray, scale: np.ndarray, books: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the depth best rows of each query, scored by lookup tables.

    A table holds a codeword's products with all queries of a group side by side, so a row's scores
    for them are sums of whole table rows. What is below a query's depth-th best so far goes at once.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    near, more = (np.empty((ROWS_AT_A_TIME, QUERIES_AT_A_TIME), np.float32) for _ in range(2))
    for first in range(0, len(q), QUERIES_AT_A_TIME):
        group = q[first : first + QUERIES_AT_A_TIME].astype(np.float32)
        tables = [np.ascontiguousarray(book @ group.T) for book in books]
        held, n_held = [], 0
        least = np.full(len(group), -np.inf, np.float32)
        for low in range(0, len(codes), ROWS_AT_A_TIME):
            part = codes[low : low + ROWS_AT_A_TIME].astype(np.intp)
            a, b = near[: len(part), : len(group)], more[: len(part), : len(group)]
            if not a.flags.c_contiguous:
                a, b = np.empty(a.shape, np.float32), np.empty(a.shape, np.float32)
            np.take(tables[0], part[:, 0], axis=0, out=a, mode="clip")
            for m in range(1, len(books)):
                np.take(tables[m], part[:, m], axis=0, out=b, mode="clip")
                a += b
            a *= scale[low : low + len(part), None]
            row, query = np.nonzero(a > least)
            held.append((query, row + low, a[row, query]))
            n_held += len(row)
            if n_held > 4 * depth * len(group):
                held = [best_of(*map(np.concatenate, zip(*held, strict=True)), depth)]
                n_held = len(held[0][0])
                full = np.bincount(held[0][0], minlength=len(group)) >= depth
                last = np.full(len(group), np.inf, np.float32)
                np.minimum.at(last, held[0][0], held[0][2])
                least = np.where(full, last, -np.inf).astype(np.float32)
        query, row, score = best_of(*map(np.concatenate, zip(*held, strict=True)), depth)
        out.append((query + first, row, score))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def scan_cell(books: list[np.ndarray], depth: int):
    """The depth best units of a cell for each of its queries, by the codes' scores."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "unit", "near"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names=names)
        units = rows["unit"].to_numpy()
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(units), -1)
        query, row, score = scan(matrix(queries["vector"].combine_chunks()), codes, rows["scale"].to_numpy(), books, depth)
        return pa.table([pa.array(queries["id"].to_numpy()[query]), pa.array(units[row]), pa.array(score)], names=names)

    return run


def product(a: str, b: str) -> Column:
    """The inner product of two vectors, in double precision, in order."""
    each = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(each, F.lit(0.0), lambda total, x: total + x)


def grid(n_rows: int, n_queries: int) -> tuple[int, int]:
    """Blocks of rows and of queries: cells of about CELL pairs, shaped so that little is copied (a query weighs about seven rows)."""
    cells = max(LEAST_CELLS, -(-n_rows * n_queries // CELL))
    row_blocks = min(n_rows, math.ceil(math.sqrt(cells * n_rows / (7 * n_queries))))
    return max(1, row_blocks), max(1, min(n_queries, -(-cells // max(1, row_blocks))))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vector and members, its k + 1 smallest ids, of every different vector. Copies go before they are shuffled."""
    hashed = rows.select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    by_id = Window.partitionBy("h1", "h2").orderBy("id")
    least = hashed.select("h1", "h2", "id").distinct().withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    members = least.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("members"))  # k + 1 at most
    return hashed.groupBy("h1", "h2").agg(F.first("vector").alias("vector")).join(members, ["h1", "h2"]).select("vector", "members")


def candidates(ws: Workspace, coded: DataFrame, asked: DataFrame, books: list[np.ndarray], rerank: int) -> DataFrame:
    """query_id and unit of the best of all units for each query, by the codes. coded and asked are saved."""
    n_rows, n_queries = coded.count(), asked.count()
    row_blocks, query_blocks = grid(n_rows, max(1, n_queries))
    even = rerank / row_blocks  # units are dealt to blocks by hash: a block's part of the best strays little from this
    depth = min(rerank, math.ceil(even + 6 * math.sqrt(even) + 6))
    block = lambda n, by: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = coded.select("unit", "codes", "scale", block(row_blocks, "unit").alias("r"), each(query_blocks).alias("q"))
    queries = asked.select("id", "vector", block(query_blocks, "id").alias("q"), each(row_blocks).alias("r"))
    found = queries.groupBy("r", "q").cogroup(data.groupBy("r", "q")).applyInArrow(scan_cell(books, depth), "query_id long, unit long, near float")
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "unit")
    return ws.save(found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= rerank).select("query_id", "unit"), "candidates")


def search(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = EVERY, k: int = K, rerank: int = RERANK, ws: Workspace | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each row whose id is divisible by every.

    Candidates are all rows of another id; ties go to the smaller id. Rows without an id, and vectors
    that are null, empty, zero or hold null or non-finite components take no part. A shorter vector
    counts as filled up with zeros. Rows that repeat both id and vector are one candidate; rows of one
    id are one query, by the smallest vector. Other columns are not looked at, whatever their names.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ws = ws or Workspace(spark, "vectors")
    rows = usable(vectors, key, column)
    schema = "query_id long, rank int, vec_id long, score double"
    shortest, longest = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if longest is None:
        return spark.createDataFrame([], schema)
    if shortest < longest:
        kind = rows.schema["vector"].dataType.elementType
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast(kind), F.lit(longest) - F.size("vector"))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    books = train(matrix(sample["vector"].combine_chunks()))
    kind = rows.schema["vector"].dataType.elementType.simpleString()
    coded = distinct_vectors(rows, k).mapInArrow(encode_rows(books), f"vector array<{kind}>, members array<long>, codes binary, scale float")
    coded = ws.save(with_row_id(coded, "unit"), "coded")
    asked = ws.save(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector")), "asked")
    pairs = candidates(ws, coded, asked, books, rerank)
    wanted = pairs.join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    uses = ws.save(pairs.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).join(coded.select("unit", "vector", "members"), "unit"), "wanted")
    scored = hot_join(wanted, uses, ["unit"], "n", pairs.count()).select("query_id", product("query", "vector").alias("score"), F.explode("members").alias("vec_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.where("vec_id <> query_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
