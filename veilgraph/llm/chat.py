"""Transcript parsing with a hidden Markov model.

A transcript comes as blocks of lines (rows with a key, an order and a text). Each line has features:
which speaker its marker names, whether a blank line precedes it, whether it ends in a question mark,
and its length. States are a role, and whether the line begins a turn. Emission and transition
probabilities are counted (with add-one smoothing) on blocks whose role is known. Viterbi decoding finds
the likeliest states, and turns are rendered in canonical form without their markers.

Transcripts of any length are decoded exactly: rows are range partitioned by (key, order), and for a
transcript that spans partitions each piece is first reduced to a max-plus matrix, from entry state to
exit state. The driver chains these matrices (at most two for each partition) and tells every piece its
entry and exit state; then each piece is decoded on its own. No transcript is gathered in one task.

Defined results: a null text is one empty line; null keys form one transcript; equal orders keep the
order in which rows are read. Ties between states go to the first. Transitions across a partition
border aren't counted in fitting.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm._common import materialize, row_id, small_batches

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
#: Fixed speaker words.
SPEAKERS = {
    "system": ("system", "instructions", "instruction", "context", "note"),
    "user": ("user", "human", "customer", "client", "question", "q", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a"),
}
MARKER = re.compile(
    r"^\s*(?:[#>*]+\s*)?(?:(?P<open><\|?|\[|\(|\*\*)\s*)?(?P<who>" + "|".join(sorted((w for v in SPEAKERS.values() for w in v), key=len, reverse=True)) + r")\s*(?(open)(?:\|?>|\]|\)|\*\*)\s*:?|:)[ \t]?",
    re.IGNORECASE,
)
_ROLE_OF = {w: r for r, v in SPEAKERS.items() for w in v}
N_FEATURES = 4


def line_features(line: str, after_blank: bool) -> tuple[tuple[int, ...], str]:
    """Values of the features, and the line without its marker."""
    m = MARKER.match(line)
    rest = line[m.end() :] if m else line
    who = 1 + ROLES.index(_ROLE_OF[m["who"].lower()]) if m else 0
    n = len(rest)
    return (who, int(after_blank), int(rest.rstrip().endswith("?")), 0 if not n else 1 if n < 40 else 2 if n < 120 else 3), rest


def block_lines(text: str | None) -> list[tuple[tuple[int, ...], str]]:
    out, blank = [], False
    for line in (text or "").split("\n"):
        out.append(line_features(line, blank))
        blank = not line.strip()
    return out


class Model:
    """Log probabilities: first (state), move (state, state), emit[feature] (state, value)."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> None:
        self.first, self.move, self.emit = first, move, emit

    @classmethod
    def of_counts(cls, counts: Counter) -> Model:
        k = len(STATES)
        first, move = np.zeros(k), np.zeros((k, k))
        emit = [np.zeros((k, n)) for n in (4, 2, 2, 4)]
        for (kind, a, b), n in counts.items():
            if kind == "first":
                first[a] += n
            elif kind == "move":
                move[a, b] += n
            else:
                emit[int(kind)][a, b] += n
        log = lambda x: np.log((x + 1) / (x + 1).sum(axis=-1, keepdims=True))
        begins = np.array([b for _, b in STATES])
        role = np.array([ROLES.index(r) for r, _ in STATES])
        move = log(move)
        # A line that continues a turn has the role of the line before.
        move[:, ~begins] = np.where(role[:, None] == role[None, ~begins], move[:, ~begins], -math.inf)
        return cls(np.where(begins, log(first), -math.inf), move, [log(e) for e in emit])

    def scores(self, features: list[tuple[int, ...]]) -> np.ndarray:
        f = np.array(features, int).reshape(-1, N_FEATURES)
        return sum(self.emit[i][:, f[:, i]].T for i in range(N_FEATURES))

    def matrix(self, features: list[tuple[int, ...]], starts: bool) -> np.ndarray:
        """Best log probability from each state before (or, at the start, from nothing) to each last state."""
        e = self.scores(features)
        m = (np.tile(self.first, (len(STATES), 1)) if starts else self.move) + e[0]
        for row in e[1:]:
            m = (m[:, :, None] + self.move[None]).max(axis=1) + row
        return m

    def decode(self, features: list[tuple[int, ...]], entry: int | None, leave: int | None) -> list[int]:
        """Likeliest states, after state `entry` (None: at the start), ending in `leave` (None: anywhere)."""
        e = self.scores(features)
        v = (self.first if entry is None else self.move[entry]) + e[0]
        back = []
        for row in e[1:]:
            step = v[:, None] + self.move
            best = step.argmax(axis=0)
            back.append(best)
            v = step[best, np.arange(len(STATES))] + row
        at = int(v.argmax()) if leave is None else leave
        out = [at]
        for best in reversed(back):
            at = int(best[at])
            out.append(at)
        return out[::-1]


def stage(blocks: DataFrame, key: str, order: str, text: str, role: str | None) -> DataFrame:
    """Blocks in order: __key, __order, __text, __role, and __part, __at by range partition."""
    small_batches(blocks.sparkSession)
    truth = F.col(f"`{role}`").cast("string") if role else F.lit(None).cast("string")
    rows = blocks.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{order}`").alias("__order"), F.col(f"`{text}`").cast("string").alias("__text"), truth.alias("__role"), row_id("__row"))
    by = ["__key", "__order", "__row"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.record_batch([*b.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*b.schema.names, "__part", "__at"])
            at += n

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, f"{kinds}, __part int, __at long"), "blocks")


def _in_order(staged: DataFrame) -> DataFrame:
    return staged.repartition("__part").sortWithinPartitions("__part", "__at")


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, list[dict]]]:
    """(part, whether it is the first of its part, rows) of one transcript's rows in one part."""
    now, rows, first = None, [], True
    for batch in batches:
        for r in batch.to_pylist():
            own = (r["__part"], r["__key"])
            if own != now:
                if rows:
                    yield now[0], first, rows
                first = now is None or now[0] != own[0]
                now, rows = own, []
            rows.append(r)
    if rows:
        yield now[0], first, rows


def fit(staged: DataFrame) -> Model:
    """Count on all staged blocks with a known role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, first, rows in _fragments(batches):
            before = None
            for i, r in enumerate(rows):
                if r["__role"] not in ROLES:
                    before = None
                    continue
                state = 2 * ROLES.index(r["__role"])
                for j, (features, _) in enumerate(block_lines(r["__text"])):
                    now = state + (j > 0)
                    if before is not None:
                        counts["move", before, now] += 1
                    elif i == 0 and not first:
                        counts["first", now, 0] += 1  # the first piece of a part may go on from another part
                    for k, x in enumerate(features):
                        counts[str(k), now, x] += 1
                    before = now
        rows_ = [(*k, n) for k, n in counts.items()]
        columns = list(zip(*rows_, strict=True)) or [()] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.int32(), pa.int64()], strict=True)], ["kind", "a", "b", "n"])

    rows = _in_order(staged).mapInArrow(run, "kind string, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model.of_counts(Counter({(r["kind"], r["a"], r["b"]): r["n"] for r in rows}))


def _borders(staged: DataFrame, model: Model) -> dict[tuple[int, bool], tuple[int | None, int | None]]:
    """Entry and exit states of pieces of transcripts that span parts, by (part, first of its part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(part: int, first: bool, rows: list[dict], last: bool) -> tuple:
            features = [f for r in rows for f, _ in block_lines(r["__text"])]
            ms = [model.matrix(features, s).tolist() for s in (True, False)]
            return part, first, last, json.dumps(rows[0]["__key"], default=str), json.dumps(ms)

        out, held = [], None
        for part, first, rows in _fragments(batches):
            if held and held[0] != part:
                if not held[1] or len(out) == 0 or out[-1][0] != held[0]:
                    out.append(of(*held, True))
                else:
                    out[-1] = (*out[-1][:2], True, *out[-1][3:])
            if first:
                out.append(of(part, True, rows, False))
            held = (part, first, rows)
        if held:
            if held[1]:
                out[-1] = (*out[-1][:2], True, *out[-1][3:])
            else:
                out.append(of(*held, True))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "first", "last", "key", "m"])

    pieces = sorted(_in_order(staged).mapInArrow(run, "part int, first boolean, last boolean, key string, m string").collect(), key=lambda r: (r["part"], not r["first"]))
    out: dict[tuple[int, bool], tuple[int | None, int | None]] = {}
    i = 0
    while i < len(pieces):
        j = i
        # A transcript goes on if its piece ends a part and the next part begins with the same key.
        while pieces[j]["last"] and j + 1 < len(pieces) and pieces[j + 1]["first"] and pieces[j + 1]["key"] == pieces[j]["key"]:
            j += 1
        if j > i:
            v, ends = None, []
            for k in range(i, j + 1):
                starting, moving = (np.array(m) for m in json.loads(pieces[k]["m"]))
                if v is None:
                    v, back = starting[0], None
                else:
                    step = v[:, None] + moving
                    back = step.argmax(axis=0)
                    v = step.max(axis=0)
                ends.append(back)
            at = int(v.argmax())
            for k in range(j, i - 1, -1):
                entry = None if ends[k - i] is None else int(ends[k - i][at])
                out[pieces[k]["part"], pieces[k]["first"]] = (entry, at)
                at = entry if entry is not None else at
        i = j + 1
    return out


def parse(staged: DataFrame, model: Model) -> DataFrame:
    """One row for each block: __key, __order, __role (known), parsed_role, n_lines, n_begins, content, rendered."""
    known = staged.sparkSession.sparkContext.broadcast(_borders(staged, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = known.value
        out = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 8
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for part, first, rows in _fragments(batches):
            lines = [block_lines(r["__text"]) for r in rows]
            entry, leave = borders.get((part, first), (None, None))
            states = model.decode([f for own in lines for f, _ in own], entry, leave)
            at = 0
            for r, own in zip(rows, lines, strict=True):
                mine = [STATES[s] for s in states[at : at + len(own)]]
                at += len(own)
                texts = [t for _, t in own]
                if len(texts) > 1 and own[0][0][0] and not texts[0].strip():
                    texts = texts[1:]  # the marker had a line of its own
                content = "\n".join(texts)
                turns: list[list] = []
                for (role, begins), (_, t) in zip(mine, own, strict=True):
                    if begins or not turns:
                        turns.append([role, []])
                    turns[-1][1].append(t)
                rendered = "".join(f"<|{role}|>\n" + "\n".join(t).strip("\n") + "\n<|end|>\n" for role, t in turns)
                out.append((r["__key"], r["__order"], r["__role"], mine[0][0], len(own), sum(b for _, b in mine), content, rendered))
            if len(out) >= 1024:
                yield batch()
                out.clear()
        yield batch()

    names = ["__key", "__order", "__role", "parsed_role", "n_lines", "n_begins", "content", "rendered"]
    source = staged.select("__key", "__order")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    empty = source.limit(0).toArrow().schema
    kinds = [empty.field(0).type, empty.field(1).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _in_order(staged).mapInArrow(run, f"{schema}, __role string, parsed_role string, n_lines long, n_begins long, content string, rendered string")


def raw_blocks(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as they come in the wild: five marker styles by transcript; every seventh turn has none."""
    style = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5))
    bare = F.pmod(F.crc32(F.concat_ws(":", key, order).cast("binary")), F.lit(7)) == 0
    who, body = F.coalesce(F.col(role), F.lit("user")), F.coalesce(F.col(text), F.lit(""))
    human = F.when(who == "user", "Human").when(who == "assistant", "AI").otherwise("System")
    short = F.when(who == "user", "Q").when(who == "assistant", "A").otherwise("Note")
    marked = (
        F.when(style == 0, F.concat(F.initcap(who), F.lit(": "), body))
        .when(style == 1, F.concat(F.lit("### "), human, F.lit(":\n"), body))
        .when(style == 2, F.concat(F.lit("["), who, F.lit("] "), body))
        .when(style == 3, F.concat(F.lit("<|"), who, F.lit("|>\n"), body))
        .otherwise(F.concat(short, F.lit(": "), body))
    )
    return turns.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(role).alias("role"), F.when(bare, body).otherwise(marked).alias("text"))


def recover_roles(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Write turns as raw transcripts, fit on those of every other key and parse all: one row for each turn."""
    staged = stage(raw_blocks(turns, key, order, role, text), "key", "order", "text", "role")
    part = F.pmod(F.crc32(F.coalesce(F.col("__key").cast("string"), F.lit("")).cast("binary")), F.lit(2))
    model = fit(staged.where(part == 0))
    rows = parse(staged, model)
    return rows.select(
        F.col("__key").alias(key),
        F.col("__order").alias(order),
        F.col("__role").alias(role),
        "parsed_role",
        "n_lines",
        "n_begins",
        F.sha2("content", 256).alias("content_sha256"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
    )
