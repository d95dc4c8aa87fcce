"""Quality rules by weak supervision.

Each rule looks at a document and votes good (+1), bad (-1) or abstains (0).  Rules are not trusted
equally: expectation-maximisation over the observed vote patterns estimates, for each rule, how often
it votes each way on good and on bad documents, together with the share of good ones.  The posterior
probability of good given all votes replaces a demand that every rule must pass.

Only the histogram of vote patterns goes to the driver: at most 3 ** len(RULES) rows whatever the
corpus, made by a partial aggregation, and the posteriors return as a broadcast table of that bound.

Defined cases: a null text counts as empty; empty texts have no words, fail the base rules and are not
kept; repeated rows are judged alike, one output row each; an empty table gives an empty result; input
columns with a name of the operator's own columns are replaced; any number of words is judged whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.llm.tables import map_text, named, others, staged
from tiergraph.llm.textops import LOWER, SAME, SPACED, Texts, find_words, repeated, slices, span_codes, windows

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be by on not he his are this or at from which an have had "
    "le la les de des du et un une est que qui dans en pour sur pas au aux par avec "
    "der die das und ist von zu den mit im auf dem nicht ein eine als auch für "
    "el los las del y una por con para se lo su al es"
).split()

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_LEADING = (np.arange(256) & 0xC0) != 0x80

FEATURES = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("n_lines", T.LongType()),
    ("n_ended_lines", T.LongType()),
    ("n_function_words", T.LongType()),
    ("n_symbol_words", T.LongType()),
]

#: Rule name, and its vote in SQL over the feature columns (1 good, -1 bad, 0 abstains).  Most rules
#: know a fault when they see one and say nothing otherwise; three also recognise good prose.
RULES = [
    ("rule_length", "CASE WHEN n_words < 50 THEN -1 WHEN n_words >= 60 THEN 1 ELSE 0 END"),
    ("rule_symbols", "CASE WHEN 5 * n_symbols > n_words THEN -1 ELSE 0 END"),
    ("rule_symbol_words", "CASE WHEN 10 * n_symbol_words > n_words THEN -1 ELSE 0 END"),
    ("rule_symbol_chars", "CASE WHEN 30 * n_symbols > word_chars THEN -1 WHEN 200 * n_symbols <= word_chars THEN 1 ELSE 0 END"),
    ("rule_lines", "CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN -1 ELSE 0 END"),
    ("rule_repeats", "CASE WHEN 10 * n_repeat_words > 3 * n_words THEN -1 ELSE 0 END"),
    ("rule_word_length", "CASE WHEN word_chars < 3 * n_words OR word_chars > 12 * n_words THEN -1 ELSE 0 END"),
    ("rule_function_words", "CASE WHEN 25 * n_function_words < n_words THEN -1 WHEN 10 * n_function_words >= n_words THEN 1 ELSE 0 END"),
    ("rule_endings", "CASE WHEN n_lines = 0 OR 5 * n_ended_lines < n_lines THEN -1 WHEN 5 * n_ended_lines >= 3 * n_lines THEN 1 ELSE 0 END"),
]


def _function_codes() -> np.ndarray:
    data = pa.array(FUNCTION_WORDS)
    return np.sort(np.concatenate([find_words(t, SPACED).code for t in slices(data, LOWER)]))


def _measure(t: Texts, function_codes: np.ndarray) -> list[np.ndarray]:
    n = t.n
    words = find_words(t, SPACED)
    n_words = words.per_text(n)
    inside = SPACED[t.data]
    total = np.zeros(len(t.data) + 1, dtype=np.int64)
    np.cumsum(inside & _LEADING[t.data], out=total[1:])
    word_chars = np.diff(total[t.offsets])

    breaks = np.flatnonzero(t.data == 10)
    begins = np.union1d(breaks + 1, t.offsets[:-1])
    begins = begins[begins < len(t.data)]
    owner = np.searchsorted(t.offsets, begins, side="right") - 1
    after = np.append(breaks, len(t.data))
    stop = np.minimum(after[np.searchsorted(breaks, begins)], t.offsets[owner + 1])
    used = np.zeros(len(t.data) + 1, dtype=np.int64)
    np.cumsum(inside, out=used[1:])
    real = used[stop] > used[begins]
    begins, stop, owner = begins[real], stop[real], owner[real]
    _, later = repeated(owner, span_codes(t.data, begins, stop))
    n_dup = np.bincount(owner[later], minlength=n)
    n_lines = np.bincount(owner, minlength=n)
    closing = np.isin(t.data[stop - 1], list(b".!?:;\"')]")) if len(stop) else np.zeros(0, dtype=bool)
    n_ended = np.bincount(owner[closing], minlength=n)

    at, code = windows(words, 3)
    twice, _ = repeated(words.text[at], code)
    covered = np.zeros(len(words.code), dtype=bool)
    for k in range(3):
        covered[at[twice] + k] = True
    n_repeat = np.bincount(words.text[covered], minlength=n)
    signs = np.zeros(len(t.data) + 1, dtype=np.int64)
    np.cumsum(SYMBOLS[t.data], out=signs[1:])
    n_symbol = np.bincount(words.text[signs[words.end] > signs[words.start]], minlength=n)

    codes = span_codes(LOWER[t.data], words.start, words.end)
    place = np.minimum(np.searchsorted(function_codes, codes), len(function_codes) - 1)
    n_function = np.bincount(words.text[function_codes[place] == codes], minlength=n)
    return [n_words, word_chars, t.counted(SYMBOLS), n_dup, n_repeat, n_lines, n_ended, n_function, n_symbol]


def features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The counts that rules look at, beside the kept columns."""

    def fn(column: pa.Array) -> list[np.ndarray]:
        codes = _function_codes()
        parts = [_measure(t, codes) for t in slices(column, SAME)]
        return [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [[] for _ in FEATURES]

    return map_text(docs, text, fn, FEATURES, keep)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """EM over vote patterns: share of good, P(vote | class) as [class, rule, vote + 1], posterior of each pattern."""
    if not patterns:
        return 0.5, np.zeros((2, 0, 3)), {}
    votes = np.array([p for p, _ in patterns], dtype=np.int64)
    weight = np.array([c for _, c in patterns], dtype=np.float64)
    n_rules = votes.shape[1]
    good = 1 / (1 + np.exp(-1.5 * votes.sum(1)))  # start: a soft majority
    share, given = 0.5, np.zeros((2, n_rules, 3))
    for _ in range(rounds):
        before = good
        for k, mass in enumerate((weight * (1 - good), weight * good)):
            for v in range(3):
                given[k, :, v] = 1 + mass @ (votes == v - 1)
            given[k] /= given[k].sum(1, keepdims=True)
        share = float((weight @ good + 1) / (weight.sum() + 2))
        score = np.full(len(votes), math.log(share) - math.log(1 - share))
        for j in range(n_rules):
            # An abstention says little about quality, so it carries no weight in the posterior.
            told = votes[:, j] != 0
            score += np.where(told, np.log(given[1, j, votes[:, j] + 1]) - np.log(given[0, j, votes[:, j] + 1]), 0)
        good = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(good - before).max() < 1e-9:
            break
    return share, given, {tuple(int(x) for x in v): float(g) for v, g in zip(votes, good, strict=True)}


def judge(measured: DataFrame, threshold: float = 0.5, counted: DataFrame | None = None) -> DataFrame:
    """Votes, posterior and verdict for a (staged) table of features; `counted` has the same features alone."""
    spark = measured.sparkSession
    names = [n for n, _ in RULES]
    rules = [F.expr(sql).cast("int").alias(n) for n, sql in RULES]
    voted = measured.select("*", *rules)
    counts = (measured if counted is None else counted).select(*rules).groupBy(*names).count().collect()  # 3 ** len(RULES) rows at most
    _, _, posterior = estimate(sorted((tuple(r[n] for n in names), r["count"]) for r in counts))
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in names] + [T.StructField("p_quality", T.DoubleType())])
    known = spark.createDataFrame([(*v, p) for v, p in posterior.items()], schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.join(F.broadcast(known), names, "left").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("p_quality"), F.lit(0.0)) >= threshold))


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Documents with features, votes, p_quality, base_failed and kept; see the module's text for odd cases.

    Features are stored between the two passes; where texts are carried they are measured twice instead, so that
    no copy of the texts is left in the shared folder.
    """
    made = [n for n, _ in FEATURES] + [n for n, _ in RULES] + ["p_quality", "base_failed", "kept"]
    carried = [c for c in others(docs, made) if keep is None or c in keep]
    measured, counted = features(docs, text, carried), None
    if text in carried:
        counted = features(docs, text, [])
    else:
        measured = staged(measured, "quality")
    return judge(measured, threshold, counted).select(*[named(c) for c in carried], *made)
