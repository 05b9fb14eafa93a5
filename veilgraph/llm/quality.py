"""Quality rules with risk-controlled cutoffs.

Four rules give every text a number, and a text is rejected where a number reaches the rule's cutoff
for the text's stratum (its language): the rate of symbols, of repeated lines, of words in repeated
8-word windows, and the strongest log-odds of its words in a lexicon. The lexicon is fitted on a
bounded sample (`fit_rows`) of the labelled rows whose hash falls into the fitting part.

The other labelled rows are the holdout. In a stratum, n of them are good (quality 1, not toxic); a
cutoff rejects k of these. The hypothesis "this cutoff falsely rejects more than alpha / rules" is
tested with the exact binomial tail P(Bin(n, alpha / rules) <= k). Cutoffs of a rule are tested from
the most lenient down, stopping at the first that is not certified (fixed-sequence testing), at level
delta / (strata * rules) (Bonferroni). So, with probability 1 - delta, in no stratum do the cutoffs
together falsely reject more than alpha. Of the certified cutoffs the one is used that rejects most
bad holdout rows less `penalty` times the good ones. Where none is certified the rule doesn't reject.

Defined results: a null text has no words (and so fails the base rule); a null stratum is a stratum;
labels without a document, and nulls in labels, are ignored; of repeated labels the worst counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.llm._common import materialize, renamed, restored, small_batches, words

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 8
ALPHA, DELTA, PENALTY = 0.05, 0.05, 20.0
FIT_ROWS, LEXICON, LEAST_SUPPORT, LEAST_ODDS = 20_000, 4096, 5, 3.0
#: Cutoffs of each rule, lowest first.
GRID = {
    "symbol_rate": [0.002 * 1.12**i for i in range(54)],
    "dup_line_rate": [0.01 * 1.1**i for i in range(49)],
    "repeat_rate": [0.01 * 1.1**i for i in range(49)],
    "lexicon_odds": [LEAST_ODDS + 0.25 * i for i in range(40)],
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars"]


def repeat_words(w: list[bytes]) -> int:
    """Words in windows of eight words that the text has twice or more; exact, by doubling ranks."""
    n = len(w)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, n)
    step = 1
    while step < WINDOW:
        pairs = rank[:-step] * n + rank[step:]
        _, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        step *= 2
    again = counts[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(again)] += again
    edge[WINDOW : WINDOW + len(again)] -= again
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The numbers of COUNTS."""
    text = text or ""
    raw = text.encode()
    w = raw.split()
    seen: set[bytes] = set()
    lines = dups = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dups += line in seen
            seen.add(line)
    return (len(w), len(text) - sum(map(text.count, SPACES)), sum(raw.count(c) for c in SYMBOLS), dups, repeat_words(w), lines, len(text))


def measure(docs: DataFrame, carry: list[str], text_col: str, lexicon: dict[bytes, float]) -> DataFrame:
    """Carried columns and, prefixed by __, COUNTS and lexicon_odds."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = known.value
        for batch in batches:
            texts = batch.column(len(carry)).to_pylist()
            counts = [text_counts(t) for t in texts]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] or [pa.array([], pa.int64())] * len(COUNTS)
            best = [max((odds[x] for x in odds.keys() & set(words(t.encode()))), default=0.0) if t and odds else 0.0 for t in texts]
            yield pa.record_batch([*batch.columns[: len(carry)], *columns, pa.array(best, pa.float64())], [*carry, *[f"__{c}" for c in COUNTS], "__lexicon_odds"])

    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"__{c} long" for c in COUNTS]
    return rows.mapInArrow(run, ", ".join([*fields, "__lexicon_odds double"]))


def rule_values() -> dict[str, Column]:
    def rate(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.lit(1), F.col(b))

    return {
        "symbol_rate": rate("__n_symbols", "__n_chars"),
        "dup_line_rate": rate("__n_dup_lines", "__n_lines"),
        "repeat_rate": rate("__n_repeat_words", "__n_words"),
        "lexicon_odds": F.col("__lexicon_odds"),
    }


def base_failed() -> Column:
    return (F.col("__n_words") < 20) | (100 * F.col("__n_repeat_words") > 30 * F.col("__n_words"))


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    """Of each labelled id: bad, and whether it belongs to the fitting part."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    one = known.groupBy(F.col(id_col).alias("__id")).agg(((F.min("quality") < 1) | (F.max("toxic") > 0)).alias("__bad"))
    return one.withColumn("__fit", F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(5)) < 2)


def fit_lexicon(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fit_rows: int = FIT_ROWS) -> dict[bytes, float]:
    """Log-odds of words that bad texts have far more often; at most LEXICON words from at most fit_rows texts."""
    sample = _labels(labels, id_col).where("__fit").orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    texts = docs.join(F.broadcast(sample), docs[id_col] == F.col("__id")).select("__bad", F.col(f"`{text_col}`").cast("string").alias("t"))
    cut = F.split(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = texts.select("__bad", F.array_distinct(cut).alias("w"))
    total = rows.agg(F.count_if("__bad"), F.count_if(~F.col("__bad"))).first()
    bad, good = total[0] or 0, total[1] or 0
    if not bad or not good:
        return {}
    counts = rows.select("__bad", F.explode("w").alias("w")).where("w <> ''").groupBy("w").agg(F.count_if("__bad").alias("b"), F.count_if(~F.col("__bad")).alias("g"))
    odds = F.log((F.col("b") + 0.5) / (bad + 1.0)) - F.log((F.col("g") + 0.5) / (good + 1.0))
    top = counts.where(F.col("b") >= LEAST_SUPPORT).withColumn("o", odds).where(F.col("o") >= LEAST_ODDS).orderBy(F.desc("o"), "w").limit(LEXICON)
    return {r["w"].encode(): r["o"] for r in top.collect()}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed."""
    if k >= n:
        return 1.0
    first = math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(first - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


def certify(good: list[int], bad: list[int], n: int, cutoffs: list[float], alpha: float, level: float, penalty: float = PENALTY) -> float | None:
    """The cutoff to use. good, bad: rows with a value from cutoff i on and below the next; n: good rows in all."""
    best, at, k, caught = 0.0, None, 0, 0
    for i in reversed(range(len(cutoffs))):
        k, caught = k + good[i], caught + bad[i]
        if binomial_tail(k, n, alpha) > level:
            break
        if (gain := caught - penalty * k) > best:
            best, at = gain, cutoffs[i]
    return at


def _cutoffs_reached(value: Column, grid: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: c <= value))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Rule: stratum: cutoff, from the holdout rows of measured()."""
    held = measured.join(_labels(labels, id_col).where("NOT __fit"), F.col(id_col) == F.col("__id"))
    stratum = F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("\0"))
    bins = [F.struct(F.lit(rule).alias("rule"), _cutoffs_reached(value, GRID[rule]).alias("bin")) for rule, value in rule_values().items()]
    rows = held.select(stratum.alias("s"), "__bad", F.explode(F.array(*bins)).alias("x")).groupBy("s", "x.rule", "x.bin").agg(F.count_if(~F.col("__bad")).alias("good"), F.count_if("__bad").alias("bad"))
    tally: dict[str, dict[str, tuple[list[int], list[int]]]] = {}
    for r in rows.collect():
        g, b = tally.setdefault(r["s"], {}).setdefault(r["rule"], ([0] * (len(GRID[r["rule"]]) + 1), [0] * (len(GRID[r["rule"]]) + 1)))
        g[r["bin"]] += r["good"]
        b[r["bin"]] += r["bad"]
    out: dict[str, dict[str, float]] = {rule: {} for rule in GRID}
    for s, rules in tally.items():
        for rule, (g, b) in rules.items():
            cut = certify(g[1:], b[1:], sum(g), GRID[rule], alpha / len(GRID), delta / (len(tally) * len(GRID)))
            if cut is not None:
                out[rule][s] = cut
    return out


def rejected(cutoffs: dict[str, dict[str, float]], stratum_col: str) -> Column:
    stratum = F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("\0"))
    out = F.lit(False)
    for rule, value in rule_values().items():
        if cutoffs[rule]:
            known = F.create_map(*[F.lit(x) for pair in cutoffs[rule].items() for x in pair])
            out = out | F.coalesce(value >= F.try_element_at(known, stratum), F.lit(False))
    return out


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row for each document: id, n_words and the other base numbers, base_failed, kept, lexicon_odds."""
    lexicon = fit_lexicon(docs, labels, id_col, text_col)
    measured = materialize(measure(docs, [id_col, stratum_col], text_col, lexicon), "measured")
    cutoffs = fit_cutoffs(measured, labels, id_col, stratum_col)
    return measured.select(
        id_col,
        *[F.col(f"__{c}").alias(c) for c in COUNTS[:5]],
        base_failed().alias("base_failed"),
        (~base_failed() & ~rejected(cutoffs, stratum_col)).alias("kept"),
        F.round("__lexicon_odds", 6).alias("lexicon_odds"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that assess() keeps, all columns kept, whatever their names."""
    lexicon = fit_lexicon(docs, labels, id_col, text_col)
    # Cutoffs need the labelled holdout only; the corpus is measured once.
    held = _labels(labels, id_col).where("NOT __fit").select(F.col("__id").alias(id_col))
    cutoffs = fit_cutoffs(measure(docs.join(held, id_col, "left_semi"), [id_col, stratum_col], text_col, lexicon), labels, id_col, stratum_col)
    own, names = renamed(docs)
    rows = measure(own, own.columns, names[text_col], lexicon)
    return rows.where(~base_failed() & ~rejected(cutoffs, names[stratum_col])).select(*restored(names))
