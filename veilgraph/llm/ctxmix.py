"""Language-model scoring by online logistic context mixing.

A text is a sequence of tokens: words between ASCII white space, A-Z lower-cased, and one end token.
A frequent token (of the `vocabulary` most frequent training tokens) is one symbol; any other, and any seen once, is an
escape and its bytes, two at a time, closed by a byte that UTF-8 never has. Each symbol is a path through a Huffman tree, so coding a text is a
sequence of binary decisions. For each decision four predictors know how often the bit was 1: in the
training texts after (tree node), (node, previous symbol) and (node, two previous symbols), the latter
two in hashed tables, and in the text so far after (node). Their log-odds are mixed with weights that a
gate selects (kind of symbol, depth, how much the longest context has seen), and the mix is refined by an
adaptive probability map. Weights and map are learned on the training texts of remainder 1 of 50, which the
tables leave out: `STEPS` Newton steps on the sums over all of these texts, then the map's counts, so that
the order and layout of rows don't matter. Through each text both are learned on online, one block of
`BLOCK` symbols at a time, from that start. The score is the log10 probability of all decisions;
bits per byte follow from it.

Counting covers all training texts. Token counts are summed by token, tables by block of slots, non-zero
slots only, in two levels and 64 bits. A hashed table has about a slot for each training token, up to
`bits`, which bounds the memory of a worker (8 bytes a slot and table counting, 1 byte scoring) and what
is broadcast; beyond that, contexts share slots. The vocabulary and the trees are bounded by `vocabulary`;
counts of tokens beyond it are joined, never broadcast.

Defined results: null text is empty (the end token only); a null id counts as ''. Without training
texts every count is 0 and the base is that of one unseen token kind. Rows are scored each on its own.
"""

from __future__ import annotations

import itertools
import struct
import sys
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm._common import materialize, small_batches

VOCABULARY = 131_072
TABLE_BITS = 21
BLOCK, LANES = 64, 64
#: Bytes of texts that are taken at once; these and LANES hold memory, results don't depend on them.
SLICE = 4 << 20
#: Counters of a table that are summed as one row; how many partitions are summed at a time first.
PART, FAN = 1 << 14, 1024
#: A partition's counts are handed on before one of 32 bits can overflow.
MOST = 1 << 31
#: Symbols that are held, so that equal ones after equal contexts are counted at once.
HELD = 1 << 21
#: Log-odds are kept in steps of 1 / SCALE; slots of each text's own counts.
SCALE, OWN_BITS = 15, 12
#: Where a decision's kind (spelled or not, depth), place and log-odds by node lie, above its bit and own slot.
KIND, PLACE, KNOWN = 1 + OWN_BITS, 4 + OWN_BITS, 24
#: Levels of a tree whose slots share 1 << GROUP neighbours in each table, so that memory is reached once for all of them.
GROUP = 4
RATE, MAP_PRIOR, MAP_CELLS = 0.008, 24.0, 33
CHUNK = 4096
GATES = 24
STEPS, RIDGE = 2, 50.0
#: Weights (node, one, two symbols, own text) from which they are learned.
START = (0.4, 0.4, 0.2, 0.1)
#: What log-odds of each predictor are in steps of; the weights of lanes are divided by it in place of the log-odds.
UNITS = (SCALE, SCALE, SCALE, 1)
#: Where the upper half of 64 bits lies.
HIGH = int(sys.byteorder == "little")
_K1, _K2, _K3 = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one after another, and how many each text has; the end tokens are not among them."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, n = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    word = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    text = np.repeat(np.arange(len(n)), n)
    return flat.filter(pa.array(word)).cast(pa.binary()), np.bincount(text[word], minlength=len(n))


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """Stretches of a column with the place where each begins; of at most about `most` bytes, beyond one text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, column.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if len(sizes) > begin:
        yield begin, column.slice(begin)


def pieces(batches: Iterator[pa.RecordBatch], texts: int, most: int = SLICE, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """All rows in order, dealt anew: at most about `most` bytes of column `texts` at a time, beyond one text, and so many rows.

    Spark's batches have a number of rows; cut one by one they would leave short ends, whose groups are small and cost more.
    """
    held: list[pa.RecordBatch] = []
    total = count = 0
    for batch in batches:
        begin = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_pylist()):
            if count and (total + size > most or count == rows):
                yield pa.concat_batches([*held, batch.slice(begin, i - begin)])
                held, begin, total, count = [], i, 0, 0
            total += size
            count += 1
        held.append(batch.slice(begin))
    if count:
        yield pa.concat_batches(held)


def huffman(weights: list[int]) -> tuple[np.ndarray, array, bytearray]:
    """Code lengths, and the inner nodes and bits on the paths of all symbols, one after another.

    Leaves in order of weight and merged nodes in order of creation are two sorted queues.
    """
    n = len(weights)
    leaves = sorted(range(n), key=weights.__getitem__)
    merged: list[int] = []
    parent, side = array("i", [-1]) * (2 * n - 1), bytearray(2 * n - 1)
    i = j = 0

    def take() -> tuple[int, int]:
        nonlocal i, j
        if i < n and (j >= len(merged) or weights[leaves[i]] <= merged[j]):
            i += 1
            return leaves[i - 1], weights[leaves[i - 1]]
        j += 1
        return n + j - 1, merged[j - 1]

    for at in range(n, 2 * n - 1):
        (x, a), (y, b) = take(), take()
        parent[x] = parent[y] = at
        side[y] = 1
        merged.append(a + b)
    lengths, nodes, bits = np.zeros(n, np.int64), array("i"), bytearray()
    for k in range(n):
        path, turns, at = [], [], k
        while parent[at] >= 0:
            path.append(parent[at] - n)
            turns.append(side[at])
            at = parent[at]
        lengths[k] = len(path)
        nodes.extend(path[::-1])
        bits.extend(turns[::-1])
    return lengths, nodes, bits


def pairs(word: bytes) -> tuple[int, ...]:
    """The word's bytes with a closing 255, two at a time."""
    closed = word + (b"\xff" if len(word) % 2 else b"\xff\xff")
    return struct.unpack(f"<{len(closed) // 2}H", closed)


def build_codes(words: list[bytes], counts: list[int], rare: int) -> dict:
    """Symbols: the words, the escape, pairs of bytes. Arrays with every symbol's nodes, bits and gates."""
    spelled: Counter = Counter()
    for w in words:
        spelled.update(pairs(w))
    inner = len(words) or 1
    top, low = huffman([*[max(1, c) for c in counts], max(1, rare)]), huffman([1 + 64 * spelled.get(i, 0) for i in range(1 << 16)])
    length = np.concatenate([top[0], low[0]])
    node = np.concatenate([np.frombuffer(top[1], np.int32), np.frombuffer(low[1], np.int32) + inner]).astype(np.int32)
    return {"words": words, "length": length, "start": np.cumsum(length) - length, "node": node, "inner": inner, "bit": np.frombuffer(bytes(top[2] + low[2]), np.uint8), "nodes": inner + (1 << 16)}


def _derived(codes: dict) -> dict:
    """What follows from the codes for each of their decisions; worked out where it is used, to ship less.

    Decisions are taken in groups of `GROUP` levels, whose slots lie side by side: a slot is a hash of the
    group's first node, xor a place that the bits since then tell. One number of 64 bits has all of a decision, so
    that memory is reached once for it: 32 bits of the hash, 8 of the log-odds by node (unfolded() adds them), 4 zeros,
    GROUP of the place, 3 of the kind, OWN_BITS of the own slot, and the bit.
    """
    word = np.empty(len(codes["node"]), np.uint64)
    # Some symbols at a time: the arrays between would take several times the memory of the result.
    for i in range(0, len(codes["length"]), 1 << 14):
        start, length = codes["start"][i : i + (1 << 14)], codes["length"][i : i + (1 << 14)]
        some = slice(int(start[0]), int(start[-1] + length[-1]))
        node, bit = codes["node"][some], codes["bit"][some]
        at = np.arange(len(node))
        # No path is longer than 255: weights would have to grow as fast as Fibonacci's numbers.
        depth = (at - np.repeat(start - start[0], length)).astype(np.uint8)
        below, since = node >= codes["inner"], depth % GROUP
        first, place = at - since, np.ones(len(node), np.uint8)
        for k in range(GROUP - 1):
            place = np.where(since > k, 2 * place + bit.take(first + k, mode="clip"), place)
        head = node[first].astype(np.uint32)
        own = ((head * _K1) >> np.uint32(32 - OWN_BITS)).astype(np.int32) ^ place
        packed = place.astype(np.int32)
        for value, bits in ((4 * below.view(np.uint8) + np.minimum(depth >> 2, 3), PLACE - KIND), (own, OWN_BITS), (bit, 1)):
            packed <<= bits
            packed |= value
        word[some] = (head * _K2).astype(np.uint64) << np.uint64(32) | packed.astype(np.uint64)
    return codes | {"word": word}


class Coder:
    """Texts to symbols, and symbols to decisions."""

    def __init__(self, codes: dict, bits: int) -> None:
        self.codes = _derived(codes)
        self.words = pa.array(codes["words"], pa.binary())
        self.escape = len(codes["words"])
        self.end = pc.index(self.words, b"").as_py() if self.escape else -1
        self.shift = np.uint32(32 - bits)

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts with their ends, and where each text stops there; their rare tokens, and where each text
        stops there; vocabulary ids of all tokens (-1: rare), and where each text begins there."""
        flat, n = tokens(column)
        known = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n + 1) - 1
        ids, word = np.full(len(known) + len(n), self.end, np.int64), np.ones(len(known) + len(n), bool)
        word[ends] = False
        ids[word] = known
        at = np.flatnonzero(ids < 0)
        rare = flat.filter(pa.array(known < 0))
        if self.end < 0:
            inner = word[at]
            rare = pc.fill_null(rare.take(pa.array(np.cumsum(inner) - 1, mask=~inner)), b"")
        spelled, size = spelling(rare)
        width = np.ones(len(ids), np.int64)
        width[at] += size
        last = np.cumsum(width)
        first = last - width
        out = np.empty(int(width.sum()), np.int64)
        out[first] = np.where(ids < 0, self.escape, ids)
        inside = np.repeat(first[at] + 1 - (np.cumsum(size) - size), size) + np.arange(len(spelled))
        out[inside] = spelled.astype(np.int64) + self.escape + 1
        return out, last[ends], rare, np.searchsorted(at, ends, side="right"), ids, ends - n

    def symbols(self, text: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Symbols of one text, its rare tokens, and the vocabulary ids of the others."""
        out, _, rare, _, ids, _ = self.encoded(pa.array([text], pa.binary()).cast(pa.string()))
        return out, rare.to_pylist(), ids[ids >= 0]

    def groups(self, column: pa.Array) -> Iterator[list[np.ndarray]]:
        """Symbols of texts of like length."""
        for _, texts in slices(column):
            parts = parted(*self.encoded(texts)[:2])
            for group in _groups([len(p) for p in parts]):
                yield [parts[i] for i in group]

    def count_nodes(self, symbols: np.ndarray, counts: np.ndarray) -> None:
        """Add the decisions of so many of each symbol to the interleaved counts of the nodes, and start the symbols anew."""
        c = self.codes
        np.add.at(counts, 2 * c["node"].astype(np.int64) + c["bit"], np.repeat(symbols, c["length"]))
        symbols[:] = 0

    def count_contexts(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add the decisions of symbols after contexts to the interleaved counts of slots; a key is a symbol above the 32 bits of its context.

        Sorts the keys: equal ones are looked up once, and so are neighbours in the codes.
        """
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(first, append=len(keys)).astype(np.uint32)
        for i in range(0, len(first), CHUNK):
            own = keys[first[i : i + CHUNK]]
            packed, _, length, (slot,) = self._paths((own >> np.uint64(32)).astype(np.int64), (own.astype(np.uint32),), self.codes["word"])
            slot *= 2
            slot += (packed & 1).view(np.uint32)
            np.add.at(counts, slot, times[i : i + CHUNK].repeat(length))

    def decisions(self, now: np.ndarray, one: np.ndarray, two: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """For symbols and the two before each: what is packed of each decision, its index into the codes, and the hashed slots."""
        packed, flat, _, slots = self._paths(now, contexts(one, two), self.codes["word"] if word is None else word)
        return packed, flat, *slots

    def _paths(self, now: np.ndarray, hashes: tuple[np.ndarray, ...], word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        c = self.codes
        length = c["length"].take(now, mode="clip")
        # Arrays of 32 bits, here and in score_group: they are read and written many times and should stay in a core's cache.
        flat = np.repeat((c["start"].take(now, mode="clip") - (np.cumsum(length) - length)).astype(np.int32), length)
        flat += np.arange(len(flat), dtype=np.int32)
        halves = word.take(flat, mode="clip").view(np.uint32)
        step, packed = halves[HIGH::2].copy(), halves[1 - HIGH :: 2].copy()
        place = packed >> np.uint32(PLACE)
        place &= np.uint32((1 << GROUP) - 1)
        slots = []
        for h in hashes:
            x = h.repeat(length)
            x ^= step
            x *= _K3
            x >>= self.shift
            x ^= place
            slots.append(x)
        return packed.view(np.int32), flat, length, slots


def spelling(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What pairs() gives for each word, one after another, and how many each has."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    many = size // 2 + 1
    out = np.full(2 * int(many.sum()), 255, np.uint8)
    if size.any():
        _, places, data = words.buffers()
        begin = int(np.frombuffer(places, np.int32)[words.offset])
        to = np.repeat(2 * (np.cumsum(many) - many) - (np.cumsum(size) - size), size)
        to += np.arange(len(to))
        out[to] = np.frombuffer(data, np.uint8)[begin : begin + len(to)]
    return out.view("<u2"), many


def parted(flat: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    return [flat[a:b] for a, b in itertools.pairwise([0, *stops.tolist()])]


def contexts(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the symbol before, and of the two before."""
    h1 = (one + 1).astype(np.uint32) * _K1
    h1 ^= h1 >> np.uint32(15)
    h2 = (h1 * _K2 + (two + 1).astype(np.uint32)) * _K3
    h2 ^= h2 >> np.uint32(13)
    return h1, h2


def tallies(rare: pa.Array, stops: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Each text's different rare tokens, and how often it has each: two lists for each text."""
    coded = rare.dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    text = np.repeat(np.arange(len(stops)), np.diff(stops, prepend=0))
    own, times = np.unique(text * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    at = pa.array(np.searchsorted(own, np.arange(len(stops) + 1) * kinds), pa.int32())
    return pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(own % kinds))), pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))


def before(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each, and that before it; -1 where a text begins."""
    one = np.concatenate([[-1], symbols[:-1]])
    one[starts] = -1
    two = np.concatenate([[-1], one[:-1]])
    two[starts] = -1
    return one, two


def remainder(id_col: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % n


def token_counts(texts: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(token, n) over all texts; the end token is the empty one. About `most` tokens are counted at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            counted = pa.concat_arrays(held).value_counts()
            held.clear()
            pa.default_memory_pool().release_unused()
            return pa.record_batch([counted.field(0), counted.field(1)], ["token", "n"])

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                held += [tokens(texts)[0], pa.array([b""] * len(texts), pa.binary())]
                if sum(map(len, held)) > most:
                    yield out()
        if held:
            yield out()

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


_COUNTS = "t int, b int, s int, wide boolean, at binary, n binary"


def _sparse(counts: np.ndarray) -> Iterator[tuple[bool, bytes, bytes]]:
    """The non-zero counters: those that fit a byte with a bitmap, the others (wide) with their places."""
    small = (counts > 0) & (counts < 256)
    if small.any():
        yield False, np.packbits(small).tobytes(), counts[small].astype("u1").tobytes()
    wide = np.flatnonzero(counts > 255)
    if len(wide):
        yield True, wide.astype("<u2").tobytes(), counts[wide].astype("<u8").tobytes()


def _flush(counts: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    """The non-zero counters, a row or two for each PART of a table."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    for t, own in enumerate(counts):
        rows = [(t, b // PART, part // FAN, *x) for b in range(0, len(own), PART) for x in _sparse(own[b : b + PART])]
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["t", "b", "s", "wide", "at", "n"])
        own[:] = 0


def _summed(rows: pd.DataFrame) -> np.ndarray:
    out = np.zeros(PART, np.uint64)
    for wide, at, n in zip(rows["wide"], rows["at"], rows["n"], strict=True):
        if wide:
            out[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u8")
        else:
            out[np.flatnonzero(np.unpackbits(np.frombuffer(at, "u1")))] += np.frombuffer(n, "u1")
    return out


def log_odds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of slots whose counts of 0 and 1 are interleaved: log-odds in steps, and how much they have seen (0, 1, 2)."""
    zero, one = counts[0::2].astype(float), counts[1::2].astype(float)
    seen = zero + one
    return np.rint(np.clip(np.log((one + 0.4) / (zero + 0.4)), -8, 8) * SCALE).astype(np.int8), (seen >= 4).astype(np.uint8) + (seen >= 32).astype(np.uint8)


def predictors(texts: DataFrame, codes: dict, bits: int) -> dict:
    """Log-odds by node and by slot of the two hashed tables, over all texts, and what the longest contexts have seen."""
    known = texts.sparkSession.sparkContext.broadcast({"codes": codes})
    sizes = [codes["nodes"], 1 << bits, 1 << bits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, done = kept(known.value, lambda: Coder(known.value["codes"], bits)), TaskContext.get().partitionId(), 0
        counts, symbols = [np.zeros(2 * n, np.uint32) for n in sizes], np.zeros(len(known.value["codes"]["length"]), np.uint32)
        # Keys for both tables, of the symbols that aren't counted yet.
        held, n = [np.empty(HELD, np.uint64) for _ in range(2)], 0

        def count() -> None:
            for own, keys in zip(counts[1:], held, strict=True):
                coder.count_contexts(keys[:n], own)

        for batch in pieces(batches, 0):
            flat, stops, *_ = coder.encoded(batch.column(0))
            hashes = contexts(*before(flat, np.append(0, stops[:-1])))
            np.add.at(symbols, flat, np.uint32(1))
            at = 0
            while at < len(flat):
                s = slice(at, at + HELD - n)
                now = flat[s].astype(np.uint64) << np.uint64(32)
                for keys, h in zip(held, hashes, strict=True):
                    keys[n : n + len(now)] = now | h[s]
                at, n, done = at + len(now), n + len(now), done + int(coder.codes["length"].take(flat[s]).sum())
                if n == HELD:
                    count()
                    n = 0
                    if done > MOST:
                        coder.count_nodes(symbols, counts[0])
                        yield from _flush(counts, part)
                        done = 0
        count()
        coder.count_nodes(symbols, counts[0])
        yield from _flush(counts, part)

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        own = list(_sparse(_summed(rows)))
        same = {c: [rows[c].iloc[0]] * len(own) for c in ("t", "b", "s")}
        return pd.DataFrame(same | {c: [x[i] for x in own] for i, c in enumerate(("wide", "at", "n"))})

    def final(rows: pd.DataFrame) -> pd.DataFrame:
        odds, seen = log_odds(_summed(rows))
        t = rows["t"].iloc[0]
        return pd.DataFrame({"t": [t], "b": [rows["b"].iloc[0]], "odds": [odds.tobytes()], "seen": [seen.tobytes() if t == 2 else b""]})

    partial = texts.mapInArrow(run, _COUNTS).groupBy("t", "b", "s").applyInPandas(total, _COUNTS)
    odds, seen = [np.zeros(n, np.int8) for n in sizes], np.zeros(sizes[2], np.uint8)
    for r in partial.groupBy("t", "b").applyInPandas(final, "t int, b int, odds binary, seen binary").collect():
        at = r["b"] * (PART // 2)
        own = np.frombuffer(r["odds"], np.int8)[: sizes[r["t"]] - at]
        odds[r["t"]][at : at + len(own)] = own
        if r["t"] == 2:
            seen[at : at + len(own)] = np.frombuffer(r["seen"], np.uint8)[: len(own)]
    known.unpersist()
    return {"odds": odds, "seen": seen} | fresh()


def fresh() -> dict:
    """Weights of each predictor and gate, and the map's ones and all, as they are before any learning."""
    middle = (np.arange(MAP_CELLS) - MAP_CELLS // 2) / 2.0
    return {
        "weights": np.repeat(np.array(START, np.float32)[:, None], GATES, axis=1),
        "ones": np.tile(MAP_PRIOR / (1 + np.exp(-middle)), 2),
        "all": np.full(2 * MAP_CELLS, MAP_PRIOR),
    }


def _groups(sizes: list[int]) -> list[list[int]]:
    """Places of texts of like length, in groups of at most LANES."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    return [order[i : i + LANES] for i in range(0, len(order), LANES)]


def unfolded(coder: Coder, model: dict) -> dict:
    """model with what scoring looks up for each decision: log-odds by node beside its code, those of two symbols beside what they have seen."""
    both = model["odds"][2].astype(np.int16)
    both *= 4
    both += model["seen"]
    word, node, odds = coder.codes["word"].copy(), coder.codes["node"], model["odds"][0].view(np.uint8)
    for i in range(0, len(word), 1 << 18):
        word[i : i + (1 << 18)] |= odds.take(node[i : i + (1 << 18)], mode="clip").astype(np.uint64) << np.uint64(KNOWN)
    return model | {"word": word, "both": both}


def kept(shared: dict, make: Callable[[], object]) -> object:
    """What make() gives, made once for a broadcast value in each worker, where several tasks use it in turn."""
    # A worker may hold what the task before it needed.
    pa.default_memory_pool().release_unused()
    if "kept" not in shared:
        shared["kept"] = make()
    return shared["kept"]


def ready(shared: dict, bits: int) -> tuple[Coder, dict]:
    """Coder and unfolded model of a broadcast value."""

    def make() -> tuple[Coder, dict]:
        coder = Coder(shared["codes"], bits)
        model = unfolded(coder, shared["model"])
        coder.codes["word"] = model["word"]
        return coder, model

    return kept(shared, make)


class Lanes:
    """What each text's decisions know: weights, map and own counts."""

    def __init__(self, model: dict, lanes: int) -> None:
        self.weights = [np.tile(w / np.float32(unit), lanes) for w, unit in zip(model["weights"], UNITS, strict=True)]
        self.ones, self.all = np.tile(model["ones"], lanes), np.tile(model["all"], lanes)
        self.refined = (self.ones / self.all).astype(np.float32)
        self.counts = np.full((lanes << OWN_BITS) * 2, 0.4, np.float32)


class Lesson:
    """Sums over decisions: gradient and curvature of each gate's weights, and the map's counts."""

    def __init__(self, map_only: bool = False) -> None:
        n, self.map_only = len(START), map_only
        self.slope, self.curve = np.zeros((n, GATES)), np.zeros((n, n, GATES))
        self.ones, self.all = np.zeros(2 * MAP_CELLS), np.zeros(2 * MAP_CELLS)

    def add(self, gate: np.ndarray, cell: np.ndarray, bit: np.ndarray, p: np.ndarray, x: list[np.ndarray]) -> None:
        error, spread = bit - p, p * (1 - p)
        for i, v in enumerate([] if self.map_only else x):
            self.slope[i] += np.bincount(gate, error * v, minlength=GATES)
            own = spread * v
            for j in range(i, len(x)):
                self.curve[i, j] += np.bincount(gate, own * x[j], minlength=GATES)
        self.ones += np.bincount(cell, bit, minlength=2 * MAP_CELLS)
        self.all += np.bincount(cell, minlength=2 * MAP_CELLS)

    def values(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.slope, self.curve, self.ones, self.all)])

    def fill(self, values: np.ndarray) -> Lesson:
        at = 0
        for x in (self.slope, self.curve, self.ones, self.all):
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def weights(self, now: np.ndarray) -> np.ndarray:
        """After a Newton step; RIDGE holds back gates that have seen little."""
        out = now.astype(float)
        for g in range(GATES):
            upper = np.triu(self.curve[:, :, g])
            out[:, g] += np.linalg.solve(upper + np.triu(upper, 1).T + RIDGE * np.eye(len(now)), self.slope[:, g])
        return out.astype(np.float32)


def score_group(coder: Coder, model: dict, parts: list[np.ndarray], lesson: Lesson | None = None) -> np.ndarray:
    """Natural log probability of each text's symbols; with a lesson, weights and map stay as they are and their sums go there."""
    if "both" not in model:
        model = unfolded(coder, model)
    order = np.argsort([-len(p) for p in parts], kind="stable")
    parts = [parts[i] for i in order]
    size = np.array([len(p) for p in parts])
    flat, first = np.concatenate(parts), np.cumsum(size) - size
    one, two = before(flat, first)
    lanes, f = len(parts), np.float32
    now = Lanes(model, lanes)
    out = np.zeros(lanes)
    pair = now.counts.view(np.complex64)
    for s in range(0, int(size.max(initial=0)), BLOCK):
        active = int((size > s).sum())
        length = np.minimum(BLOCK, size[:active] - s)
        lane = np.repeat(np.arange(active), length)
        at = np.repeat(first[:active] + s - (np.cumsum(length) - length), length) + np.arange(len(lane))
        symbol = flat[at]
        packed, _, slot1, slot2 = coder.decisions(symbol, one[at], two[at], model["word"])
        who = lane.astype(np.int32).repeat(coder.codes["length"].take(symbol, mode="clip"))
        bit = packed & 1
        mine = packed >> 1
        mine &= (1 << OWN_BITS) - 1
        mine += who << OWN_BITS
        both = model["both"].take(slot2, mode="clip")
        x = [v.astype(f) for v in (packed >> KNOWN, model["odds"][1].take(slot1, mode="clip"), both >> 2)]
        # A lane has 8 kinds of decisions: GATES with what the longest context has seen, and two halves, each with cells.
        packed >>= KIND
        packed &= 7
        own = who << 3
        own += packed
        cell = own >> 2
        cell *= MAP_CELLS
        cell += MAP_CELLS // 2
        own *= 3
        both &= 3
        own += both
        own = own.astype(np.int64)
        times = pair.take(mine, mode="clip")
        ratio = times.imag / times.real
        x.append(np.log(ratio, out=ratio))
        dot = now.weights[0].take(own, mode="clip") * x[0]
        for w, v in zip(now.weights[1:], x[1:], strict=True):
            part = w.take(own, mode="clip")
            part *= v
            dot += part
        np.clip(dot, f(-8), f(8), out=dot)
        p = np.exp(-dot)
        p += f(1)
        np.reciprocal(p, out=p)
        dot *= f(2)
        cell += np.rint(dot, out=dot).astype(np.int32)
        error = bit.astype(f)
        q = now.refined.take(cell, mode="clip")
        q += p
        q *= f(0.5)
        q += error
        q -= f(1)
        np.abs(q, out=q)
        np.maximum(q, f(1e-7), out=q)
        out[:active] += np.add.reduceat(np.log(q, out=q), np.searchsorted(who, np.arange(active, dtype=np.int32)), dtype=float)
        if lesson:
            lesson.add(own % GATES, cell % (2 * MAP_CELLS), error, p, [v / f(unit) for v, unit in zip(x, UNITS, strict=True)])
        else:
            error -= p
            top, cells = active * GATES, active * 2 * MAP_CELLS
            for w, v, unit in zip(now.weights, x, UNITS, strict=True):
                v *= error
                slope = np.zeros(top, f)
                np.add.at(slope, own, v)
                slope *= f(RATE / unit)
                w[:top] += np.clip(slope, f(-0.2), f(0.2)) / f(unit)
            cell *= 2
            cell += bit
            seen = np.bincount(cell, minlength=2 * cells).reshape(-1, 2)
            now.ones[:cells] += seen[:, 1]
            now.all[:cells] += seen[:, 0]
            now.all[:cells] += seen[:, 1]
            now.refined[:cells] = now.ones[:cells] / now.all[:cells]
        mine *= 2
        mine += bit
        np.add.at(now.counts, mine, f(1))
    back = np.empty(lanes)
    back[order] = out
    return back


def learned(texts: DataFrame, codes: dict, model: dict, bits: int) -> dict:
    """model with the weights and the map that these texts teach."""
    known = texts.sparkSession.sparkContext.broadcast({"codes": codes, "model": model})

    def pass_over(weights: np.ndarray, map_only: bool = False) -> Lesson | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, lesson = ready(known.value, bits)[0], Lesson(map_only)
            own = ready(known.value, bits)[1] | {"weights": weights}
            for batch in pieces(batches, 0):
                for parts in coder.groups(batch.column(0)):
                    score_group(coder, own, parts, lesson)
            values = lesson.values()
            yield pa.record_batch([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["i", "v"])

        sums = dict(texts.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect())
        return Lesson().fill(np.array([sums[i] for i in range(len(sums))])) if sums else None

    weights, start = model["weights"], fresh()
    for _ in range(STEPS):
        if not (lesson := pass_over(weights)):
            return model
        weights = lesson.weights(weights)
    lesson = pass_over(weights, map_only=True)
    known.unpersist()
    # A text starts with the rates learned, held with the weight of the map's prior.
    rates = (start["ones"] + lesson.ones) / (start["all"] + lesson.all)
    return model | {"weights": weights, "ones": rates * MAP_PRIOR, "all": start["all"]}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, bits: int = TABLE_BITS) -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"), remainder(id_col, 50).alias("__part")).withColumn("held_out", F.col("__part") % 10 == 0)
    training = source.where(~F.col("held_out")).select("__text")
    counts = materialize(token_counts(training), "tokens")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Tokens seen once are spelled out in training too: they stand for those that training never saw.
    top = counts.where("n > 1").orderBy(F.desc("n"), "token").limit(vocabulary).toArrow()
    often = np.array(top.column("n").to_pylist(), np.int64)
    codes = build_codes(top.column("token").to_pylist(), often.tolist(), total - int(often.sum()))
    bits = min(bits, max(10, int(total).bit_length()))
    model = predictors(source.where("NOT held_out AND __part <> 1").select("__text"), codes, bits)
    model = learned(materialize(source.where("__part = 1").select("__text"), "lessons"), codes, model, bits)
    over = total + 0.1 * (kinds + 1)
    base = np.log10((often + 0.1) / over)
    known = spark.sparkContext.broadcast({"codes": codes, "model": model, "base": base})
    del top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = known.value
        (coder, model), price = ready(shared, bits), np.append(shared["base"], 0.0)
        for batch in pieces(batches, 3):
            column = batch.column(3)
            flat, stops, rare, ends, ids, first = coder.encoded(column)
            # The place -1, of rare tokens, adds nothing here.
            base, seen = np.add.reduceat(price[ids], first), np.add.reduceat(ids >= 0, first, dtype=np.int64)
            symbols, scores = parted(flat, stops), np.empty(len(column))
            for group in _groups([len(x) for x in symbols]):
                scores[group] = score_group(coder, model, [symbols[i] for i in group])
            sizes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            columns = [*(pa.array(x) for x in (np.diff(ends, prepend=0) + seen, seen, base, scores)), sizes, *tallies(rare, ends)]
            yield pa.record_batch([*batch.columns[:3], *columns], names)

    names = ["__row", id_col, "held_out", "n_tokens", "__known", "__base", "__score", "__bytes", "__rare", "__times"]
    kind = source.schema.fields[0].dataType.simpleString()
    schema = f"__row long, `{id_col}` {kind}, held_out boolean, n_tokens long, __known long, __base double, __score double, __bytes long, __rare array<binary>, __times array<long>"
    rows = source.select(F.monotonically_increasing_id().alias("__row"), id_col, "held_out", "__text")
    scored = materialize(rows.mapInArrow(run, schema), "scored")
    rare = scored.select("__row", F.explode(F.arrays_zip("__rare", "__times")).alias("x")).select("__row", F.col("x.__rare").alias("token"), F.col("x.__times").alias("times"))
    chance = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / over)
    found = rare.join(counts, "token", "left").groupBy("__row").agg(F.sum(F.col("times") * chance).alias("__more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("__also"))
    out = scored.drop("__rare", "__times").join(found, "__row", "left")
    return out.select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("__known") + F.coalesce("__also", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("__more", F.lit(0.0))).alias("base_score"),
        (F.col("__score") / float(np.log(10))).alias("score"),
        (-F.col("__score") / float(np.log(2)) / F.greatest(F.lit(1), F.col("__bytes"))).alias("bits_per_byte"),
    )
