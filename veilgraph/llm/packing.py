"""Sequence packing as a cutting-stock problem solved by column generation.

Every text is tokenized and closed by an end token, then cut into pieces of `capacity` tokens and one
remainder. A full piece is a sequence of its own. Remainders are counted by size class (`width`
tokens); the linear program "fewest sequences that hold all remainders" over patterns (how many of each
class a sequence holds) is solved by the revised simplex method, where a knapsack dynamic program over
the duals prices new patterns. Pattern counts are rounded down, what is left is packed first-fit
decreasing, and pieces, ranked within their class, are dealt to the slots of the patterns.

The program sees a histogram of at most capacity / width classes, whatever the corpus' size. Ranks come
from counts per partition and class, so no class is gathered in one task; the table of slot ranges is
bounded by the number of classes and patterns, and is broadcast. Offsets sum up lengths per sequence.

Defined results: a null or empty text is the end token alone. Rows are ranked by position, so ties and
repeats need no rule. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.llm._common import materialize, small_batches

CAPACITY, WIDTH, END = 2048, 8, 1
CACHE = 300_000
MAX_COLUMNS = 6000
#: Pricing stops when the program is proven to be within this part of its optimum.
GAP = 2e-4

#: The pre-tokenizer's pieces, as the tokenizer's public format has them.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^SLN]+|S+(?![^S])|S+"
#: The pre-tokenizer's classes within U+0000-U+00FF.
_LATIN = {"L": "A-Za-zªµºÀ-ÖØ-öø-ÿ", "N": "0-9²³¹¼½¾", "S": "\\t-\\r \\x85\\xa0"}


def _latin_pattern() -> str:
    out, inside = [], False
    for ch in _PIECES.replace("'s|'t|'re|'ve|'m|'ll|'d", ""):
        inside = ch == "[" or (inside and ch != "]")
        out.append((_LATIN[ch] if inside else f"[{_LATIN[ch]}]") if ch in _LATIN else ch)
    return "'s|'t|'re|'ve|'m|'ll|'d" + "".join(out)


LATIN_PATTERN = _latin_pattern()
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of the byte sequences in a byte-level BPE file, and of its added tokens."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    return {bytes(of[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in added}, added


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes; remembers the ids of pre-tokens.

    An added token in a text is its own id, and what stands before and after is tokenized apart.
    """

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int], end: int) -> None:
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = self.bpe._core_bpe.encode_single_piece
        self.split = re.compile(LATIN_PATTERN).finditer
        self.find = re.compile(LATIN_PATTERN).findall
        self.end = int(end).to_bytes(4, "little")
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")").split
        self.known: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        own = self.single(piece.encode())
        ids = struct.pack(f"<{len(own)}I", *own)
        if len(piece) < 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join([self.added.get(x) or self._plain(x) for x in self.cut(text)]) + self.end
        return self._plain(text) + self.end

    def _plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        get = self.known.get
        if len(text) < 1 << 20:
            return b"".join([get(p) or self._ids(p) for p in self.find(text)])
        parts, pieces = [], (m.group() for m in self.split(text))
        while chunk := list(itertools.islice(pieces, 1 << 16)):
            parts.append(b"".join([get(p) or self._ids(p) for p in chunk]))
        return b"".join(parts)


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end: int, capacity: int, width: int, with_ids: bool) -> DataFrame:
    """One row for each piece, with its partition, size class and rank among that partition's pieces of the class."""
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(("ranks", "added"), byte_ranks(tokenizer), strict=True)))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "__class", "__rank", "__part", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = known.value
        if "encoder" not in shared:
            shared["encoder"] = Encoder(shared["ranks"], shared["added"], end)
        encode, ranks, part = shared["encoder"].encode, Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows, owner = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "")
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    size = 0 if length == capacity else -(-length // width)
                    rows.append((start, length, zlib.crc32(own), n, size, ranks[size], own))
                    owner.append(k)
                    ranks[size] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            out = [batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, t) for c, t in zip(columns[:6], kinds, strict=True)], pa.array([part] * len(rows), pa.int32())]
            yield pa.record_batch(out + [pa.array(columns[6], pa.binary())] * with_ids, names)

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    kind = rows.schema.fields[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, __class int, __rank long, __part int"
    return rows.mapInArrow(run, schema + ", ids binary" * with_ids)


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern; values[i] is that of size i + 1."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        n = min(c, len(values))
        got = values[:n] + best[c - n : c][::-1]
        i = int(got.argmax())
        if got[i] > best[c - 1]:
            best[c], pick[c] = got[i], i + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if pick[c]:
            pattern[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return best[capacity], pattern


def solve(demand: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, pattern) so that all of the demand (size: pieces) has slots, in nearly the fewest sequences."""
    sizes = sorted(s for s, n in demand.items() if n)
    if not sizes:
        return []
    m = len(sizes)
    need = np.array([demand[s] for s in sizes], float)
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // s) for i, s in enumerate(sizes)]
    cost = np.ones(m)
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ need
    for _ in range(MAX_COLUMNS):
        duals = cost @ inverse
        values = np.zeros(capacity)
        values[np.array(sizes) - 1] = np.maximum(duals, 0.0)
        worth, pattern = best_pattern(values, capacity)
        low = int(duals.argmin())
        if duals[low] < -1e-9 and -duals[low] > worth - 1:
            entering, price = -np.eye(m, dtype=np.int64)[low], 0.0  # leave a slot of that size empty
        elif worth > 1 + GAP:
            entering, price = pattern[np.array(sizes) - 1], 1.0
        else:
            break
        d = inverse @ entering
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1.0), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * d, 0.0)
        x[out] = step
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        columns[out], cost[out] = entering, price
    plan, left = [], need.astype(np.int64).copy()
    for column, often, price in zip(columns, x, cost, strict=True):
        if price and (n := int(often + 1e-9)):
            plan.append((n, {sizes[i]: int(column[i]) for i in np.flatnonzero(column)}))
            left -= n * column
    bins: list[list] = []
    for i in reversed(range(m)):
        for _ in range(max(0, int(left[i]))):
            for b in bins:
                if b[0] >= sizes[i]:
                    break
            else:
                bins.append(b := [capacity, Counter()])
            b[0] -= sizes[i]
            b[1][sizes[i]] += 1
    return plan + [(1, dict(b[1])) for b in bins]


def slot_ranges(demand: dict[int, int], plan: list[tuple[int, dict[int, int]]], first: int) -> list[tuple[int, int, int, int, int]]:
    """(class, from rank, to rank, sequence of the first, pieces in each sequence)."""
    out, done, at = [], Counter(), first
    for often, pattern in plan:
        for size, each in pattern.items():
            if done[size] < demand[size]:
                out.append((size, done[size], done[size] + often * each, at, each))
                done[size] += often * each
        at += often
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = END,
    capacity: int = CAPACITY,
    width: int = WIDTH,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = materialize(cut_pieces(docs, id_col, text_col, tokenizer, end, capacity, width, with_ids), "pieces")
    counts = pieces.groupBy("__part", "__class").agg((F.max("__rank") + 1).alias("n"))
    totals = {r["__class"]: r["n"] for r in counts.groupBy("__class").agg(F.sum("n").alias("n")).collect()}
    full = totals.pop(0, 0)
    ranges = [(0, 0, full, 0, 1)] * bool(full) + slot_ranges(totals, solve(totals, capacity // width), full)
    slots = spark.createDataFrame(ranges, "__class int, __lo long, __hi long, __seq long, __each long")
    earlier = Window.partitionBy("__class").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", "__class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    ranked = pieces.join(starts, ["__part", "__class"]).withColumn("__r", F.col("__before") + F.col("__rank"))
    r = F.col("__r") - F.col("__lo")
    placed = ranked.join(F.broadcast(slots), "__class").where("__r >= __lo AND __r < __hi")
    placed = placed.withColumn("sequence_id", F.col("__seq") + F.expr("(__r - __lo) div __each")).withColumn("__slot", r % F.col("__each"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("__class"), "__slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return out.select(F.col(f"`{id_col}`"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
