"""Repeated passages by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text, h = 2 h + gear[byte] in 16 bits, so it depends on the
last 16 bytes only. A chunk ends where h is among the lowest 1 in `EVERY` values, unless one ended in
the `LEAST` bytes before; chunks of more than `MOST` bytes are cut. Borders thus depend on nearby
content alone, and an insertion shifts no border beyond its neighbourhood. Chunks are identified by
digest and counted over the whole corpus. A run of consecutive chunks that all occur elsewhere too, of
`WORDS` words or more, is a repeated passage; it stays where its chunks occur first, and what other places
have of it in `WORDS` words or more on end is removed there.

Digests are pre-aggregated before the shuffle; only digests that occur twice or more are joined back.
Texts aren't shuffled unless the cleaned text is asked for.

Defined results: null and empty texts have no chunks. The first occurrence is that in the earliest row,
then the earliest place. Repeated rows are repeated passages.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm._common import as_bytes, materialize, row_id, small_batches

EVERY, LEAST, MOST, WORDS = 28, 4, 512, 20
#: Bytes of a digest: of 1e12 different chunks fewer than one pair in 1e5 corpora would be taken for equal.
DIGEST = 12

#: 16-bit values by a multiplicative rule.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.uint16)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint16(step)
        h = h + shifted
    return h


def borders(text: bytes) -> np.ndarray:
    """Ends of the text's chunks, in bytes."""
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(gear_hashes(raw) < (1 << 16) // EVERY) + 1
    ends = ends[np.diff(ends, prepend=-LEAST - 1) > LEAST]
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > MOST:
        out: list[int] = []
        for end, gap in zip(ends.tolist(), gaps.tolist(), strict=True):
            out += [*range(end - gap + MOST, end, MOST), end]
        ends = np.array(out)
    return ends


def chunks(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """Carried columns; of each chunk its end in code points, how many words begin in it, whether the text had it before, and its digest."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, begun, again, digests = [], [], [], []
            for text in as_bytes(batch.column(len(carry))):
                if not text:
                    ends.append([])
                    begun.append([])
                    again.append([])
                    digests.append([])
                    continue
                raw = np.frombuffer(text, np.uint8)
                cut = borders(text)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                space = _SPACE[raw]
                starts = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
                ends.append(points[cut].astype(np.int32))
                begun.append(np.diff(starts[cut], prepend=0).astype(np.int32))
                own = [hashlib.blake2b(text[a:b], digest_size=DIGEST).digest() for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]
                seen: set[bytes] = set()
                again.append([d in seen or seen.add(d) is not None for d in own])
                digests.append(own)
            columns = [pa.array(c, pa.list_(k)) for c, k in ((ends, pa.int32()), (begun, pa.int32()), (again, pa.bool_()), (digests, pa.binary()))]
            yield pa.record_batch([*batch.columns[: len(carry)], *columns], [*carry, "__ends", "__begun", "__again", "__digests"])

    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, __ends array<int>, __begun array<int>, __again array<boolean>, __digests array<binary>")


def _judge(rows: DataFrame, carry: list[str], least: int) -> DataFrame:
    """Carried columns and what find_repeats() reports, from __ends, __begun, __again, __dups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ends, begun, again, dups in zip(*[batch.column(len(carry) + i).to_pylist() for i in range(4)], strict=True):
                found: list[tuple[int, int]] = []
                removed: list[tuple[int, int]] = []
                words = n = 0
                dups = sorted((d["at"], d["first"] and not again[d["at"]]) for d in dups or [])
                i = 0
                while i < len(dups):
                    j = i
                    while j + 1 < len(dups) and dups[j + 1][0] == dups[j][0] + 1:
                        j += 1
                    a, b = dups[i][0], dups[j][0]
                    if (w := sum(begun[a : b + 1])) >= least:
                        n += b - a + 1
                        words += w
                        found.append((ends[a - 1] if a else 0, ends[b]))
                        for first, own in itertools.groupby(dups[i : j + 1], key=lambda d: d[1]):
                            x, *_, y = [at for at, _ in own] * 2
                            if not first and sum(begun[x : y + 1]) >= least:
                                removed.append((ends[x - 1] if x else 0, ends[y]))
                    i = j + 1
                show = [",".join(f"{x}:{y}" for x, y in spans) for spans in (found, removed)]
                out.append((len(ends), n, len(found), words, sum(y - x for x, y in removed), *show))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch([*batch.columns[: len(carry)], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*carry, *names])

    names = ["n_chunks", "n_repeated_chunks", "n_passages", "repeated_words", "removed_chars", "passages", "removed"]
    source = rows.select(*[F.col(f"`{c}`") for c in carry], "__ends", "__begun", "__again", "__dups")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(carry)])
    return source.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} long" for c in names[:5]) + ", passages string, removed string")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WORDS, with_text: bool = False) -> DataFrame:
    """One row for each document: id, n_chunks, n_repeated_chunks, n_passages, repeated_words, removed_chars,
    passages and removed (code point spans, end exclusive), has_repeats, and if asked for clean_text."""
    carry = ["__row", id_col, *["__text_kept"] * with_text]
    source = docs.select(row_id("__row"), F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__t"), *[F.col(f"`{text_col}`").cast("string").alias("__text_kept")] * with_text)
    cut = materialize(chunks(source, carry, "__t"), "chunks")
    one = cut.select("__row", F.posexplode("__digests").alias("at", "digest"))
    twice = one.groupBy("digest").agg(F.count("*").alias("n"), F.min("__row").alias("least")).where("n > 1").drop("n")
    joined = one.join(twice, "digest").select("__row", F.struct("at", (F.col("least") == F.col("__row")).alias("first")).alias("dup"))
    dups = joined.groupBy("__row").agg(F.collect_list("dup").alias("__dups"))
    out = _judge(cut.drop("__digests").join(dups, "__row", "left"), carry, least).withColumn("has_repeats", F.col("n_passages") > 0).drop("__row")
    if with_text:
        spans = F.filter(F.split("removed", ","), lambda s: s != "")
        starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: F.split_part(s, F.lit(":"), F.lit(2)).cast("int")))
        ends = F.concat(F.transform(spans, lambda s: F.split_part(s, F.lit(":"), F.lit(1)).cast("int")), F.array(F.length("__text_kept")))
        clean = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col("__text_kept"), a + 1, b - a)), "")
        out = out.withColumn("clean_text", clean).drop("__text_kept")
    return out
