"""Secret scan: patterns, and Markov models of random strings and ordinary identifiers.

Two first-order character models are trained from labelled strings; a run of key characters is
flagged if its log-likelihood ratio says random. Everything is a DataFrame expression: patterns
split a text into pieces and matches, whose lengths, summed up within a document, give the
positions, so a document of any number of matches takes linear work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.common import with_row_id

NAME = "op2_secret_scan"
SQL = None  # SQL lacks match positions: held against a plain matcher in the tests

# The patterns by kind, in the order in which kinds are listed, and what a match needs at least.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: A shorter match is never within a longer one here, so the least length can stand in the pattern.
ACCESS = rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"
HEX = rf"[0-9a-f]{{{HEX_LEAST},}}"
#: Runs that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
ORDINARY = r"[A-Za-z0-9_]{4,}"

#: Random strings that are made; smoothing; nats for a flag, in all and per character.
LEARN_RANDOM, SMOOTHING, LEAST_NATS, LEAST_RATE = 3000, 0.5, 10.0, 0.5
CODES = 128


def random_strings(spark: SparkSession, n: int = LEARN_RANDOM) -> DataFrame:
    """Labelled strings (text) as keys look: base 64, hexadecimal and upper-case letters with digits."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    alphabet = F.translate(F.upper(F.base64(F.unhex(digest))), "+/=", "27")
    made = F.array(F.translate(F.base64(F.unhex(digest)), "=", ""), digest, F.substring(alphabet, 1, 24))
    return spark.range(n).select(F.explode(made).alias("text"))


def ordinary_words(docs: DataFrame) -> DataFrame:
    """Labelled strings (text): the words outside all patterns, of all documents."""
    text = docs["text"]
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    return docs.select(F.explode(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0))).alias("text"))


def train(random: DataFrame, ordinary: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratios, random against ordinary, by code of the character before (0: none) times CODES plus code."""
    labelled = random.select("text", F.lit(1).alias("label")).unionAll(ordinary.select("text", F.lit(0).alias("label")))
    chars = F.split("text", "")
    pairs = F.arrays_zip(F.concat(F.array(F.lit("")), chars).alias("a"), chars.alias("b"))
    each = labelled.select("label", F.explode(pairs).alias("p")).select("label", F.ascii("p.a").alias("a"), F.ascii("p.b").alias("b")).where(F.col("b").between(1, CODES - 1) & F.col("a").between(0, CODES - 1))
    counts: dict = {}
    for r in each.groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect():  # 2 * CODES ** 2 at most
        counts[r["label"], r["a"], r["b"]] = r["n"]
    symbols = 65

    def log_p(label: int, a: int, row: list[int]) -> list[float]:
        total = sum(row) + smoothing * symbols
        return [math.log((n + smoothing) / total) for n in row]

    table: list[float] = []
    for a in range(CODES):
        rows = [[counts.get((label, a, b), 0) for b in range(CODES)] for label in (0, 1)]
        ordinary_p, random_p = log_p(0, a, rows[0]), log_p(1, a, rows[1])
        table += [round(r - o, 4) for o, r in zip(ordinary_p, random_p, strict=True)]
    return table


def score(value: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string of key characters; null for null."""
    table = F.from_json(F.lit(str(model)), "array<double>")
    start = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("s"))
    step = lambda acc, c: F.struct(F.ascii(c).alias("a"), (acc["s"] + F.get(table, acc["a"] * CODES + F.ascii(c))).alias("s"))
    return F.when(value.isNotNull(), F.aggregate(F.split(value, ""), start, step, lambda acc: acc["s"]))


def matches(text: Column, kind: int, pattern: str, value_group: int, when: Column) -> Column:
    """(kind, i, before, found, value) of each match, and a last one without found."""
    empty = F.array().cast("array<struct<kind:int,i:int,before:int,found:int,value:string>>")
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value"),
    )
    each = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["before"]).alias("before"), F.length(x["found"]).alias("found"), x["value"].alias("value")))
    return F.when(when, each).otherwise(empty)


def spans(docs: DataFrame, model: list[float], keep: list[str], nats: float = LEAST_NATS, rate: float = LEAST_RATE) -> DataFrame:
    """kept (a struct of the kept columns) of every row of docs, and found: an array of (start, kind, end, base), by start and kind.

    Positions are code points, ends exclusive; kind counts in KINDS. Spans that the models add never
    overlap one of a pattern. A null or empty text has none. Equal rows are scanned each; an empty
    table gives no rows; kept columns may have any names.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = with_row_id(docs.select(F.struct(*[docs[c].alias(c) for c in keep]).alias("kept"), text.alias("text")))
    text, lowered = F.col("text"), F.lower("text")
    named = lowered.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        named = named | lowered.contains(word)
    kinds = F.concat(
        matches(text, 0, ASSIGN, 2, named),
        matches(text, 1, ACCESS, 0, text.contains("AKIA")),
        matches(text, 2, HEX, 0, text.rlike(HEX)),
        matches(text, 3, CANDIDATE, 0, text.rlike(CANDIDATE)),
    )
    each = rows.select("_rid", "kept", F.explode_outer(kinds).alias("m")).select("_rid", "kept", "m.*")
    least = F.when(F.col("kind") == 0, F.length("value") >= ASSIGN_LEAST).otherwise(F.col("found").isNotNull())
    judged = F.when(F.col("kind") == 3, score(F.col("value"), model))
    each = each.withColumn("nats", judged).withColumn("good", F.coalesce(least, F.lit(False)) & F.when(F.col("kind") == 3, (F.col("nats") >= nats) & (F.col("nats") >= rate * F.col("found"))).otherwise(F.lit(True)))
    each = each.drop("value", "nats").repartition("_rid")
    so_far = Window.partitionBy("_rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("before") + F.coalesce("found", F.lit(0))).over(so_far))
    each = each.withColumn("start", F.col("end") - F.coalesce("found", F.lit(0)))
    base = F.col("good") & (F.col("kind") < 3)
    before = Window.partitionBy("_rid").orderBy("start", "kind", "i").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_rid").orderBy(F.desc("start"), F.desc("kind"), F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.max(F.when(base, F.col("end"))).over(before)
    later = F.min(F.when(base, F.col("start"))).over(after)  # from the end, so that the frame grows by a row at a time
    free = (F.coalesce(earlier, F.lit(0)) <= F.col("start")) & (F.coalesce(later, F.col("end")) >= F.col("end"))
    each = each.where("good or i is null or i = 0").withColumn("free", free)
    real = F.when(F.col("good") & ((F.col("kind") < 3) | F.col("free")), F.struct(F.col("start"), F.col("kind"), F.col("end"), (F.col("kind") < 3).alias("base")))
    return each.groupBy("_rid").agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list(real)).alias("found")).select("kept", "found")


def listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """spans() with models trained from the documents themselves and from made random strings."""
    return spans(docs, train(random_strings(docs.sparkSession), ordinary_words(docs)), keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    numbers = [count_of(F.col("found"), k).alias(f"n_{KINDS[k]}") for k in range(3)]
    base = F.sha2(listed(F.filter("found", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256")
    return found.select("kept.doc_id", *numbers, base, listed(F.col("found")).alias("spans"))
