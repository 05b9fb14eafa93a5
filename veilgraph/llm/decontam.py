"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of `window` consecutive words (an item of fewer words, but
not none, is one window). A window is the set of its shingles of `shingle` consecutive words. Shingles
are ordered by how often the whole corpus has them, rarest first. Containment of every shingle is
asked for, so the necessary prefix of a window with m shingles is m - m + 1 = 1 shingle: its rarest.
Documents are joined on prefix shingles; a candidate must have room for the window before and after
the shingle (length and positional bounds), and then the words themselves are compared.

The index of a block of windows has a bounded size (`block_bytes` of window text) and is broadcast.
A benchmark beyond one block is joined in as many blocks as it takes, each in a scan of its own, so
no side without a bound is ever broadcast, and no document text is shuffled.

Defined results: null texts have no words; null item ids count as ''. Documents without words, and
every document against an empty benchmark, are clean. Repeated rows are judged each on its own.
Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm._common import as_bytes, materialize, renamed, restored, row_id, small_batches, words

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 32 << 20

_FOUND = "array<struct<start:int,end:int>>"


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (window, item) rows; a window is its words joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = [], []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                w = words(text or b"")
                own = {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ()
                found += own
                owners += [item] * len(own)
            yield pa.record_batch([pa.array(found, pa.binary()), pa.array(owners, pa.string())], ["window", "item"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, "window binary, item string").distinct()


def _shingles(window: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(window[i : i + size]) for i in range(max(1, len(window) - size + 1))]


def _heads(shingles: list[bytes]) -> dict[bytes, tuple[int, ...]]:
    """First word of the shingles: the lengths in words that they have."""
    out = defaultdict(set)
    for s in shingles:
        own = s.split(b" ")
        out[own[0]].add(len(own))
    return {k: tuple(v) for k, v in out.items()}


def _at(w: list[bytes], heads: dict[bytes, tuple[int, ...]]) -> Iterator[tuple[int, bytes]]:
    """Each position where a shingle of the index may start, with that shingle."""
    n = len(w)
    for i in [i for i, x in enumerate(w) if x in heads]:
        for size in heads[w[i]]:
            if i + size <= n:
                yield i, b" ".join(w[i : i + size])


def shingle_counts(docs: DataFrame, text_col: str, shingles: list[bytes]) -> dict[bytes, int]:
    """How often all texts together have each of the (bounded) shingles."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((set(shingles), _heads(shingles)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, heads = known.value
        seen: dict[bytes, int] = {}
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                for _, s in _at(words(text or b""), heads):
                    if s in wanted:
                        seen[s] = seen.get(s, 0) + 1
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["shingle", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "shingle binary, n long")
    return {bytes(r[0]): r[1] for r in rows.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}


def prefix_index(windows: dict[bytes, list[str]], counts: dict[bytes, int], shingle: int) -> dict[bytes, list]:
    """Rarest shingle of each window that can occur at all: (words, offset of the shingle, items)."""
    index = defaultdict(list)
    for window, items in windows.items():
        w = window.split(b" ")
        own = _shingles(w, shingle)
        if all(s in counts for s in own):
            rarest = min(own, key=lambda s: (counts[s], s))
            index[rarest].append((w, own.index(rarest), items))
    return dict(index)


def _scan(docs: DataFrame, carry: list[str], text_col: str, index: dict[bytes, list]) -> DataFrame:
    """Carried columns, n_words, merged spans of hit words and items of one block."""
    heads = _heads(list(index))
    known = docs.sparkSession.sparkContext.broadcast((index, heads))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, heads = known.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in as_bytes(batch.column(len(carry))):
                w = words(text or b"")
                n, found, own = len(w), set(), set()
                for i, s in _at(w, heads):
                    for window, offset, owners in index.get(s, ()):
                        start = i - offset
                        if start >= 0 and start + len(window) <= n and w[start : start + len(window)] == window:
                            found.add((start, start + len(window)))
                            own.update(owners)
                merged: list[dict] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1]["end"]:
                        merged[-1]["end"] = max(b, merged[-1]["end"])
                    else:
                        merged.append({"start": a, "end": b})
                n_words.append(n)
                spans.append(merged)
                items.append(sorted(own))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch(
                [*batch.columns[: len(carry)], pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                [*carry, "__n_words", "__spans", "__items"],
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(probe, f"{schema}{', ' if carry else ''}__n_words long, __spans {_FOUND}, __items array<string>")


def scan(
    docs: DataFrame,
    items: DataFrame,
    carry: list[str],
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The carried columns of docs, with __n_words, __spans (word offsets) and __items."""
    small_batches(docs.sparkSession)
    found = materialize(item_windows(items, window, item_id_col, item_text_col), "windows")
    size = found.agg(F.sum(F.length("window") + F.length("item"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        docs = materialize(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text_col])], row_id("__row")), "documents")

    parts = []
    for k in range(blocks):
        windows: dict[bytes, list[str]] = defaultdict(list)
        for r in found.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).collect():
            windows[bytes(r["window"])].append(r["item"])
        shingles = list({s for w in windows for s in _shingles(w.split(b" "), shingle)})
        counts = shingle_counts(docs, text_col, shingles) if shingles else {}
        parts.append(_scan(docs, carry if blocks == 1 else ["__row"], text_col, prefix_index(windows, counts, shingle)))
    if blocks == 1:
        return parts[0]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    merged = union.groupBy("__row").agg(
        F.max("__n_words").alias("__n_words"), F.flatten(F.collect_list("__spans")).alias("__spans"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items")
    )
    return docs.drop(*({text_col} - set(carry))).join(merged, "__row").drop("__row")


def _hit_words() -> Column:
    """Words in the union of __spans."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.sort_array("__spans"),
        start,
        lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n")),
        lambda a: a["n"],
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans."""
    rows = scan(docs, items, [id_col], **options)
    return rows.select(
        id_col,
        F.col("__n_words").alias("n_words"),
        _hit_words().alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"),
        F.array_join(F.array_sort("__items"), ",").alias("items"),
        F.array_join(F.transform(F.sort_array("__spans"), lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents of which no word lies in an occurrence of a benchmark window, all columns kept, whatever their names."""
    own, names = renamed(docs)
    rows = scan(own, items, own.columns, text_col=names[text_col], **options)
    return rows.where(F.size("__spans") == 0).select(*restored(names))
