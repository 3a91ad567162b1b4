"""Packing of tokenised documents into sequences by linear grouping, then best fit.

A packing depends only on how many pieces of each length there are, so it is planned on the
histogram of lengths, which has no more than seq_len entries at any size of the input. Large
lengths are split by size into groups of equal cardinality and rounded up to their group's largest;
configurations of these few sizes are optimised as a linear program by column generation; actual
lengths take the rounded ones' places; what rounding down left over and the small lengths are added
by best fit, largest first. The plan says which ranks of a length go to which sequences; the pieces
are numbered within their length and look their place up.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import BROADCAST_ROWS, Workspace, attach, ranked, with_row_id

NAME = "op7_best_fit_packing"
SQL = None  # SQL has no tokenizer: held against the tokenizer and a lower bound in the tests

SEQ_LEN, END = 4096, 1
#: Numbers of groups that are tried; a length is large from seq_len / LARGE.
GROUPS, LARGE = (6, 12, 24), 8
#: Cells that the pieces of a length are numbered in, at least, and about how many of them one may get.
SALTS, CELL_PIECES = 64, 500_000
#: Entries of a worker's cache before it becomes the old one; longer words are not kept; words encoded at a time.
CACHED, LONG, AT_A_TIME = 250_000, 64, 5000
#: Texts that are not taken apart: those with letters whose small forms depend on more than themselves, and with runs of punctuation.
FAR = re.compile("[^\\x00-\u012f]")
RUN = re.compile(r"[.,](?<![^\W_][.,])(?<!\s[.,])")
# Fixed value: the pattern by which the vocabulary's rules split what has no white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies show each byte as: itself if it is seen, else one from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Token ids as bytes, with a cache of words.

    The vocabulary's rules split at white space first, so a text's ids are those of its words in a row,
    and a word's those of its pieces. Commas and full stops after a word are words of their own; a
    text where that could be otherwise goes through the tokenizer as it is. New pieces are joined, as
    byte letters, and encoded by the merges alone; the tokens that end a word part them again. A full
    cache becomes the old one, from which what is still used is taken over.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece_ids(self, pieces: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for low in range(0, len(pieces), AT_A_TIME):
            part = pieces[low : low + AT_A_TIME]
            shown = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in part]
            ids = np.array(self.merges.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not mark the ends of words")
            data = ids.tobytes()
            out |= zip(part, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True)
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that the cache lacks; all but the long ones are kept."""
        old = self.old.get
        found = {w: ids for w in words if (ids := old(w)) is not None} if self.old else {}
        words = words.difference(found) if found else words
        plain = [w for w in words if w.isalpha()]
        found |= self.piece_ids(plain)
        if len(plain) < len(words):
            cut = {w: PIECES.findall(w) for w in words if not w.isalpha() and w.isprintable()}
            rest = list(words.difference(plain, cut))  # white space of other kinds and what is not seen
            found |= zip(rest, self.ids(rest), strict=True)
            made: dict[str, bytes] = {}
            for piece in {x for pieces in cut.values() for x in pieces}:
                made[piece] = found.get(piece) or self.words.get(piece)
            made |= self.piece_ids([x for x, ids in made.items() if ids is None])
            found |= {w: b"".join([made[x] for x in pieces]) for w, pieces in cut.items()}
        self.words |= found
        for word in [w for w in found if len(w) > LONG]:
            del self.words[word]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHED:
            self.old, self.words = self.words, {}
        out, odd, open_, get = [b""] * len(texts), [], [], self.words.get
        missing: set[str] = set()
        for i, text in enumerate(texts):
            if RUN.search(text) or not (text.isascii() or not FAR.search(text)):
                odd.append(i)
                continue
            words = (text + " ").lower().replace("\n", " ").replace(", ", " , ").replace(". ", " . ").split(" ")
            found = list(map(get, words))
            if holes := [(k, words[k]) for k, ids in enumerate(found) if ids is None]:
                missing.update([w for _, w in holes])
                open_.append((i, found, holes))
            else:
                out[i] = b"".join(found)
        learned = self.learn(missing)
        for i, found, holes in open_:
            for k, word in holes:
                found[k] = learned[word]
            out[i] = b"".join(found)
        for i, data in zip(odd, self.ids([texts[i] for i in odd]), strict=True):
            out[i] = data
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def tokenise(path: str, seq_len: int, end: int):
    """(doc_id, text) to (doc_id, piece, start, length, ids): 32-bit ids, cut every seq_len."""
    last = array("I", [end]).tobytes()

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                at, pieces, starts, ids = [], [], [], []
                for i, data in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    data += last
                    for k in range(0, len(data), 4 * seq_len):
                        at.append(i)
                        pieces.append(k // (4 * seq_len))
                        starts.append(k // 4)
                        ids.append(data[k : k + 4 * seq_len])
                lengths = pa.array([len(x) // 4 for x in ids], pa.int64())
                columns = [part.column(0).take(pa.array(at, pa.int32())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), lengths, pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])

    return run


def best_pattern(sizes: list[int], values: np.ndarray, room: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes within room: an unbounded knapsack, item by item."""
    best, choices = np.zeros(room + 1), []
    for _ in range(room // min(sizes)):
        following, chosen = best.copy(), np.full(room + 1, -1)
        for k, size in enumerate(sizes):
            gained = best[: room + 1 - size] + values[k]
            better = gained > following[size:] + 1e-12
            following[size:][better] = gained[better]
            chosen[size:][better] = k
        choices.append(chosen)
        if (chosen < 0).all():
            break
        best = following
    pattern, left = [0] * len(sizes), room
    for chosen in reversed(choices):
        if (k := chosen[left]) >= 0:
            pattern[k] += 1
            left -= sizes[k]
    return float(best[room]), pattern


def configurations(sizes: list[int], needs: list[int], room: int) -> list[tuple[int, list[int]]]:
    """Patterns of few sizes with whole multiplicities: the linear program's optimum, rounded down."""
    n = len(sizes)
    basis = np.diag([float(room // s) for s in sizes])
    for _ in range(40 * n):
        inverse = np.linalg.inv(basis)
        value, pattern = best_pattern(sizes, np.ones(n) @ inverse, room)
        if value <= 1 + 1e-9:
            break
        direction, level = inverse @ pattern, inverse @ np.array(needs, float)
        rising = direction > 1e-9
        if not rising.any():
            break
        steps = np.where(rising, level / np.where(rising, direction, 1), np.inf)
        basis[:, int(np.argmin(steps))] = pattern
    level = np.linalg.inv(basis) @ np.array(needs, float)
    return [(int(x + 1e-9), [int(v) for v in basis[:, j]]) for j, x in enumerate(level) if x >= 1]


class Plan:
    """Places for ranks of lengths: rows (length, from, to, sequence, offset). Rank r in [from, to) goes to sequence + r - from."""

    def __init__(self, counts: dict[int, int], room: int):
        self.room, self.places, self.sequences = room, [], 0
        self.left = {length: n for length, n in counts.items() if n}
        self.next = dict.fromkeys(self.left, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.open = 0  # a bit for each gap that some sequence has

    def add_gap(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            self.gaps[gap].append((first, n))
            self.open |= 1 << gap

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        rank = self.next[length]
        self.places.append((length, rank, rank + n, sequence, offset))
        self.next[length] += n
        self.left[length] -= n

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def substitute(self, groups: list[list[list[int]]], patterns: list[tuple[int, list[int]]]) -> None:
        """Fills the configurations with actual lengths, largest first within each group."""
        for times, pattern in patterns:
            slots = [k for k, a in enumerate(pattern) for _ in range(a)]
            queues = []
            for k in slots:  # the next `times` pieces of the group, as runs of one length
                run, need = [], times
                while need and groups[k]:
                    length, n = groups[k][-1]
                    take = min(n, need)
                    run.append([length, take])
                    need -= take
                    groups[k][-1][1] -= take
                    if not groups[k][-1][1]:
                        groups[k].pop()
                run.append([0, need])
                queues.append([x for x in run[::-1] if x[1]])
            first = self.new(times)
            while times:
                n, offset = min(q[-1][1] for q in queues), 0
                for q in queues:
                    if length := q[-1][0]:
                        self.place(length, n, first, offset)
                        offset += length
                    q[-1][1] -= n
                    if not q[-1][1]:
                        q.pop()
                self.add_gap(self.room - offset, first, n)
                first, times = first + n, times - n

    def best_fit(self) -> None:
        """Every piece that is left, largest first, into the smallest gap that holds it, or else a new sequence."""
        for length in sorted(self.left, reverse=True):
            while n := self.left[length]:
                if fits := self.open >> length:
                    gap = length + (fits & -fits).bit_length() - 1
                    first, have = self.gaps[gap].pop()
                    took = min(n, have)
                    if took < have:
                        self.gaps[gap].append((first + took, have - took))
                    if not self.gaps[gap]:
                        self.open &= ~(1 << gap)
                else:
                    gap, took = self.room, -(-n // (self.room // length))
                    first = self.new(took)
                self.place(length, took, first, self.room - gap)
                self.add_gap(gap - length, first, took)


def linear_grouping(counts: dict[int, int], room: int, n_groups: int) -> Plan:
    plan = Plan(counts, room)
    large = [(length, n) for length, n in sorted(counts.items(), reverse=True) if length * LARGE > room and n]
    total = sum(n for _, n in large)
    if total:
        each = -(-total // n_groups)
        groups: list[list[list[int]]] = [[]]
        space = each
        for length, n in large:
            while n:
                if not space:
                    groups.append([])
                    space = each
                take = min(n, space)
                groups[-1].append([length, take])
                n, space = n - take, space - take
        sizes = [g[0][0] for g in groups]
        needs = [sum(n for _, n in g) for g in groups]
        plan.substitute([g[::-1] for g in groups], configurations(sizes, needs, room))
    plan.best_fit()
    return plan


def plan_packing(counts: dict[int, int], room: int = SEQ_LEN) -> Plan:
    """The plan with the fewest sequences of those with different numbers of groups."""
    return min((linear_grouping(counts, room, g) for g in GROUPS), key=lambda p: (p.sequences, len(p.places)))


def pack(docs: DataFrame, tokenizer_path: str, payload: Column | None = None, seq_len: int = SEQ_LEN, end: int = END, ws: Workspace | None = None) -> DataFrame:
    """doc_id, piece, start, length, payload, sequence_id and offset of every piece of every document.

    docs needs doc_id and text; other columns are not looked at. A null or empty text is the end token
    alone. Only documents of over seq_len tokens are cut. payload is a column made of ids, the
    piece's tokens as little-endian unsigned 32-bit numbers, and by default these. Equal rows are
    packed as often as they occur; null ids are kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "pack")
    named = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()
    pieces = named.mapInArrow(tokenise(tokenizer_path, seq_len, end), f"doc_id {kind}, piece int, start long, length long, ids binary")
    pieces = ws.save(with_row_id(pieces.select("doc_id", "piece", "start", "length", (F.col("ids") if payload is None else payload).alias("payload"))), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # seq_len rows at most
    plan = plan_packing(counts, seq_len)
    places = spark.createDataFrame(plan.places, "length long, low long, high long, first long, offset long")
    if len(plan.places) <= BROADCAST_ROWS:
        places = F.broadcast(places)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "_rid"), F.lit(max(SALTS, max(counts.values(), default=0) // CELL_PIECES))).cast("int")
    narrow = pieces.select("_rid", "doc_id", "piece", "length", salt.alias("salt"))
    numbered = ranked(narrow, ["length"], ["salt"], ["doc_id", "piece", "_rid"], "rank")
    inside = (F.col("rank") >= places["low"]) & (F.col("rank") < places["high"])
    placed = numbered.join(places, (numbered["length"] == places["length"]) & inside)
    found = placed.select("_rid", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
    return attach(pieces, found).drop("_rid")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), payload=F.crc32("ids"))
    return packed.withColumnRenamed("payload", "ids_crc32").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
