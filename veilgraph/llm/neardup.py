"""Near-duplicate documents by DartMinHash signatures and banded joining.

A text is the weighted set of its shingles of `shingle` words, weighted by how often they occur. Its
signature is found by throwing hashed darts: over every unit cell of (element, weight, rank) there is
a Poisson number of darts, placed by hashes alone, so that all texts see the same darts. The darts
below an element's weight count; each has a coordinate and a rank, and each coordinate keeps the dart
of least rank. Two texts agree in a coordinate with probability equal to their weighted Jaccard
similarity. About k log k darts are looked at whatever a text's length, beyond one per shingle.

Equal texts (same words) are joined into one class before anything else. Signatures are cut into bands;
texts that share a band are candidates. First every text of a band's bucket is compared with the least of
the bucket. Buckets that then still hold several classes are open: their texts meet in blocks (of about
`BLOCK` texts or `BLOCK_WORDS` words), each two blocks once. Sketches of the signatures tell which texts
agree in `LIKELY` of the coordinates (5 standard deviations below 0.8) with a text of another class; the
shingle sets of these are then compared exactly, all of a block at once as a product of 0/1 matrices. No
pair is a row of a table: a block gives the texts that need comparing, and then at most as many links as
join its classes. Classes are the connected components of verified pairs. So a pair of similarity 0.8 or
more is missed only if it shares no band (7 in 100,000 at 0.8) or fails the sketch test, and nothing else
connects its classes. Texts of one bucket that stay in different classes cost a comparison of each two.

Defined results: a text without words (null, empty) is its own class. A text of fewer than `shingle`
words is one shingle. A class is named by its least id; null ids come last. Repeated rows are in one
class, of which remove_near_duplicates() keeps one row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm._common import as_bytes, materialize, small_batches, words
from veilgraph.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
LIKELY = 0.6
#: Open buckets are dealt in blocks of about so many texts and words; every two blocks meet.
BLOCK, BLOCK_WORDS = 512, 1 << 20
#: Elements of a block's texts that are compared at a time.
COLUMNS = 2048
WORDS_KNOWN = 400_000
#: Texts signed together; a text of more words ends its group.
GROUP, LONG = 64, 20_000
#: Texts, and pairs, of a block whose signatures are compared at a time.
STEP, PAIRS = 64, 16_384

_P, _Q, _R, _S = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
#: P(Poisson(1) <= i).
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _Q
    x = (x ^ (x >> np.uint64(27))) * _R
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of a text's shingles; remembers the hashes of words."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.known: dict[bytes, bytes] = {}

    def _hash(self, word: bytes) -> bytes:
        h = xxhash.xxh3_64_digest(word)
        if len(self.known) >= WORDS_KNOWN:
            self.known.clear()
        self.known[word] = h
        return h

    def __call__(self, w: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and their counts."""
        get = self.known.get
        h = np.frombuffer(b"".join([get(x) or self._hash(x) for x in w]), np.uint64)
        n = max(1, len(h) - self.size + 1)
        if len(h) < self.size:
            h = np.concatenate([h, np.zeros(self.size - len(h), np.uint64)])
        h = mix(h + _S)
        out = h[:n].copy()
        for i in range(1, self.size):
            out *= _P
            out += h[i : i + n]
        out = np.sort(mix(out))
        new = np.flatnonzero(out[1:] != out[:-1]) + 1
        if len(new) == n - 1:
            return out, np.ones(n, np.int64)
        starts = np.concatenate([[0], new])
        return out[starts], np.diff(starts, append=n)


def dart_minhashes(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """For each weighted set, and each of k coordinates, the dart of least rank.

    A set is (distinct 64-bit hashes, positive weights). All sets are worked on together: a unit cell
    is (element, weight cell, rank cell), and the ranks looked at grow for sets with empty coordinates.
    """
    n_sets = len(sets)
    sizes = np.array([len(e) for e, _ in sets])
    elements = np.concatenate([e for e, _ in sets])
    weights = np.concatenate([w for _, w in sets]).astype(float)
    owner = np.repeat(np.arange(n_sets), sizes)
    cells = np.ceil(weights).astype(np.int64)
    if (cells > 1).any():
        at = np.repeat(np.arange(len(cells)), cells)
        base = (np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)).astype(float)
        key, top, owner = elements[at], weights[at], owner[at]
        more = base > 0
        key[more] = mix(key[more] + base[more].astype(np.uint64) * _P)
    else:
        key, top, base = elements, weights, np.zeros(len(elements))
    whole = bool((top - base >= 1).all())
    low, high = np.zeros(n_sets), (k * math.log(k) + 2 * k) / np.bincount(np.repeat(np.arange(n_sets), sizes), weights, n_sets)
    best, dart = np.full(n_sets * k, np.inf), np.zeros(n_sets * k, np.uint64)
    open_ = np.arange(len(key))
    while True:
        own = owner[open_]
        first, times = np.floor(low[own]).astype(np.int64), (np.ceil(high[own]) - np.floor(low[own])).astype(np.int64)
        at = np.repeat(open_, times)
        r = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        cell = mix(key[at] + (r + 1).astype(np.uint64) * _S)
        count = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype(float) * 2.0**-53)
        some = np.repeat(np.arange(len(cell)), count)
        nth = np.arange(len(some)) - np.repeat(np.cumsum(count) - count, count)
        thrown = mix(cell[some] + (nth + 1).astype(np.uint64) * _R)
        place = mix(thrown)
        rank = r[some] + (place >> np.uint64(32)).astype(float) * 2.0**-32
        at = at[some]
        whose = owner[at]
        keep = (rank >= low[whose]) & (rank < high[whose])
        if not whole:
            keep &= base[at] + (place & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 < top[at]
        thrown, rank, whose = thrown[keep], rank[keep], whose[keep]
        slot = whose * k + (thrown % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, slot, rank)
        least = rank == best[slot]
        dart[slot[least]] = thrown[least]
        empty = ~np.isfinite(best).reshape(n_sets, k).all(axis=1)
        if not empty.any():
            return dart.reshape(n_sets, k)
        open_ = np.flatnonzero(empty[owner])
        low, high = high, 2 * high


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The signature of one weighted set."""
    return dart_minhashes([(elements, weights)], k)[0]


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of the bands of each signature."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _S, (len(signatures), 1))
    for i in range(rows):
        key = mix(key * _P + parts[:, :, i])
    return key.view(np.int64)


def _text_hash(text_col: str) -> Column:
    """128 bits, as the digest of the words has."""
    return F.unhex(F.md5(F.col(f"`{text_col}`").cast("string").cast("binary")))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, __thash (of the raw text), digest (of the words; null without words), band keys, sketch and words of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            digests, sets, of = [], [], {}
            keys: list[list[int]] = []
            sketches: list[bytes] = []
            n_words: list[int] = []

            def sign() -> None:
                if sets:
                    signed = dart_minhashes(sets, bands * rows)
                    keys.extend(band_keys(signed, bands, rows).tolist())
                    sketches.extend(x.tobytes() for x in (signed >> np.uint64(56)).astype(np.uint8))
                    sets.clear()

            for text in as_bytes(batch.column(2)):
                w = words(text or b"")
                n_words.append(len(w))
                digests.append(hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None)
                if w and digests[-1] not in of:
                    of[digests[-1]] = len(of)
                    sets.append(shingler(w))
                    if len(sets) == GROUP or len(w) > LONG:
                        sign()
            sign()
            own = [pa.array([None if d is None else x[of[d]] for d in digests], t) for x, t in ((keys, pa.list_(pa.int64())), (sketches, pa.binary()))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), *own, pa.array(n_words, pa.int64())], [id_col, "__thash", "__digest", "__keys", "__sketch", "__words"])

    source = docs.select(F.col(f"`{id_col}`"), _text_hash(text_col).alias("__thash"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    kind = source.schema.fields[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, __thash binary, __digest binary, __keys array<long>, __sketch binary, __words long")


def _verify(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            keep, last, own = [], None, None
            for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                if x != last:
                    last, own = x, shingler(words(x))
                other = shingler(words(y))
                _, i, j = np.intersect1d(own[0], other[0], assume_unique=True, return_indices=True)
                both = np.minimum(own[1][i], other[1][j]).sum()
                keep.append(bool(both >= threshold * (own[1].sum() + other[1].sum() - both)))
            yield pa.record_batch([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    x = texts.select(F.col("__digest").alias("a"), F.col("__text").alias("x"))
    y = texts.select(F.col("__digest").alias("b"), F.col("__text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _crowded(rows: DataFrame, least: float) -> DataFrame:
    """(key, i, j, own, __digest, label): of blocks i and j of a bucket, the texts that agree in `least` of the
    coordinates with a text of another class, where this bucket is the first that the two share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, _, _), group in _groups(batches, 3):
            n = group.num_rows
            own = group.column(5).to_numpy()
            sketches = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint8).reshape(n, -1)
            keys = group.column(7).combine_chunks().flatten().to_numpy().reshape(n, -1)
            classes = np.unique(np.array([*group.column(4).to_pylist(), None], object)[:-1], return_inverse=True)[1]
            left, right = _sides(own)
            wanted = np.zeros(n, bool)
            for at in range(0, len(left), STEP):
                x = left[at : at + STEP]
                p, q = np.nonzero(classes[x][:, None] != classes[right])
                for part in range(0, len(p), PAIRS):
                    i, j = x[p[part : part + PAIRS]], right[q[part : part + PAIRS]]
                    near = np.count_nonzero(sketches[i] == sketches[j], axis=1) >= least * sketches.shape[1]
                    i, j = i[near], j[near]
                    first = keys[i, (keys[i] == keys[j]).argmax(axis=1)] == key
                    wanted[i[first]] = wanted[j[first]] = True
            if wanted.any():
                kept = group.select(range(6)).filter(pa.array(wanted))
                yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], names)

    names = ["key", "i", "j", "__digest", "label", "own"]
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("n_words") / BLOCK_WORDS)).cast("int")
    own = F.pmod(F.xxhash64("__digest"), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "__digest", "label", "own", "__sketch", "__keys")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "key long, i int, j int, __digest binary, label binary, own int")


def _sides(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of either block; all rows twice where there is but one block."""
    first = own == own.min()
    return (np.flatnonzero(first), np.flatnonzero(~first)) if not first.all() else (np.arange(len(own)),) * 2


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with the same first columns, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for x, y in zip(starts, starts[1:], strict=False):
            key = tuple(int(c[x]) for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def unary(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A multiset as a set: an element's second and later occurrences are elements of their own."""
    if (counts == 1).all():
        return elements
    at = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = elements[at]
    out[nth > 0] = mix(out[nth > 0] + nth[nth > 0].astype(np.uint64) * _P)
    return out


def shared_elements(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each left set has in common with each other right set, as products of 0/1 matrices, some columns at a time."""
    size = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    several = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[several], number[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [start, start + COLUMNS])
        own = np.zeros((len(sets), COLUMNS), np.float32)
        own[row[x:y], column[x:y] - start] = 1
        out += own[left] @ own[right].T
    return out


def _verify_crowds(crowds: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(a, b): labels of classes that a pair of at least that similarity links; in each two blocks, as many as join them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)

        def condensed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [unary(*shingler(words(t))).tobytes() for t in as_bytes(batch.column(5))]
                yield pa.record_batch([*batch.columns[:5], pa.array(sets, pa.binary())], ["key", "i", "j", "label", "own", "set"])

        for _, group in _groups(condensed(), 3):
            sets = [np.frombuffer(x, np.uint64) for x in group.column(5).to_pylist()]
            names, classes = np.unique(np.array([*group.column(3).to_pylist(), None], object)[:-1], return_inverse=True)
            left, right = _sides(group.column(4).to_numpy())
            size = np.array([len(x) for x in sets], float)
            both = shared_elements(sets, left, right)
            near = both >= threshold * (size[left][:, None] + size[right] - both)
            near &= classes[left][:, None] != classes[right]
            p, q = np.nonzero(near)
            root = list(range(len(names)))
            out = []
            for code in np.unique(classes[left[p]] * len(names) + classes[right[q]]).tolist():
                x, y = divmod(code, len(names))
                while root[x] != x:
                    x = root[x] = root[root[x]]
                while root[y] != y:
                    y = root[y] = root[root[y]]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((names[x], names[y]))
            if out:
                yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    rows = crowds.join(texts, "__digest").select("key", "i", "j", "label", "own", "__text")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a binary, b binary")


def _mixed(rows: DataFrame) -> DataFrame:
    """rows of buckets with several classes, with n, their number in the bucket, and their words."""
    own = [F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.sum("__words").alias("n_words")]
    found = rows.groupBy("key").agg(*own).where("least <> most").select("key", "n", "n_words")
    return rows.drop("__words").join(found, "key")


def _pairs(rows: DataFrame) -> DataFrame:
    """Unordered distinct pairs."""
    return rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, signed: DataFrame, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """(node, label) of all digests that are linked with another."""
    distinct = signed.where("__digest IS NOT NULL").groupBy("__digest").agg(*[F.first(c).alias(c) for c in ("__keys", "__sketch", "__words")], F.min("__thash").alias("__thash"))
    rows = distinct.select("__digest", "__thash", "__words", F.explode("__keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("__digest").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = materialize(rows.join(shared, "key"), "buckets")

    wanted = buckets.select("__digest", "__thash").distinct()
    raw = docs.select(_text_hash(text_col).alias("__thash"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    texts = materialize(raw.join(wanted, "__thash").groupBy("__digest").agg(F.first("__text").alias("__text")), "texts")

    found = materialize(_verify(_pairs(buckets.select(F.col("center").alias("a"), F.col("__digest").alias("b"))), texts, shingle, threshold), "links")
    labels = components(found)
    labelled = buckets.join(labels, buckets["__digest"] == labels["node"], "left").select("key", "__digest", "__words", F.coalesce("label", "__digest").alias("label"))
    open_ = materialize(_mixed(labelled), "open")
    if open_.isEmpty():
        return labels
    sketches = distinct.select("__digest", "__sketch", "__keys")
    crowds = materialize(_crowded(open_.join(sketches, "__digest"), LIKELY), "crowds")
    more = materialize(_verify_crowds(crowds, texts, shingle, threshold), "links")
    return labels if more.isEmpty() else components(found.unionByName(more))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row for each document: id, class_id (least id of its class), class_size, __thash and __first.

    __first marks the row that stands for its class: of the least id that with the least text hash.
    """
    signed = materialize(signatures(docs, id_col, text_col, shingle, bands, rows), "signatures")
    labels = links(docs, signed, text_col, shingle, threshold)
    order = F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col("__thash").alias("thash"))
    own = signed.where("__digest IS NOT NULL").groupBy("__digest").agg(F.min(order).alias("least"), F.count("*").alias("size"))
    joined = own.join(labels, own["__digest"] == labels["node"], "left").select("__digest", "least", "size", F.coalesce("label", "__digest").alias("label"))
    classes = joined.groupBy("label").agg(F.min("least").alias("first"), F.sum("size").alias("class_size"))
    named = joined.join(classes, "label").select("__digest", "first", "class_size")
    rows_ = signed.select(id_col, "__thash", "__digest", order.alias("own")).join(named, "__digest", "left")
    first = F.coalesce("first", "own")
    return rows_.select(
        id_col,
        first["id"].alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "__thash",
        first.eqNullSafe(F.col("own")).alias("__first"),
    )


def remove_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, all columns kept, whatever their names."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("__first").select(F.col(f"`{id_col}`").alias("id"), F.col("__thash").alias("thash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("own_id"), _text_hash(text_col).alias("own_thash"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_thash").eqNullSafe(F.col("thash"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["own_id", "own_thash"]).select("row.*")
