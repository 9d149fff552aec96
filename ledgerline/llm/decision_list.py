"""Learned quality rules: a decision list grown and pruned by sequential covering.

Statistics of every whole text are computed in one vectorised pass. A bounded,
hash-ordered sample of labelled documents teaches an ordered list of rules,
each a conjunction of thresholds on those statistics: conditions are added by
information gain on two thirds of the sample until no good document is covered,
then dropped again from the end while precision on the other third gains. What
a rule covers is taken out before the next one is learned. The finished list is
applied as one ordered Spark CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import add_columns, pick, unclash
from ledgerline.llm.textvec import SPACE, Prefix, mix, per_text, spans, utf8, windows

#: At most so many labelled documents are learned from.
SAMPLE_ROWS = 20_000
REPEAT_WINDOW = 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits")
SCHEMA = T.StructType([T.StructField(n, T.LongType(), False) for n in STATISTICS])

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_LEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def statistics(texts: pa.Array) -> dict[str, pa.Array]:
    """The STATISTICS of each text (null: as empty).

    Words are runs of anything but ASCII white space; ``n_repeat_words`` counts
    the words inside 8-word windows that occur twice or more in the text,
    ``n_dup_lines`` the \\n-split lines with a word that equal an earlier line.
    """
    data, offsets = utf8(texts)
    count = len(offsets) - 1
    wordy = ~SPACE[data]
    out = {
        "word_chars": per_text(wordy & _LEAD[data], offsets),
        "n_symbols": per_text(_SYMBOL[data], offsets),
        "n_upper": per_text(_UPPER[data], offsets),
        "n_digits": per_text(_DIGIT[data], offsets),
    }
    prefix = Prefix(data)
    starts, ends, text = spans(wordy, offsets)
    out["n_words"] = np.bincount(text, minlength=count)

    # windows of eight words, keyed by text: those in a run of equal keys repeat
    at, key = windows(mix(prefix.of(starts, ends) + (ends - starts).astype(np.uint64)), text, REPEAT_WINDOW)
    key = mix(key + text[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=count)

    starts, ends, text = spans(data != 10, offsets)
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(wordy, out=words_before[1:])
    full = words_before[ends] > words_before[starts]
    starts, ends, text = starts[full], ends[full], text[full]
    out["n_lines"] = np.bincount(text, minlength=count)
    line = mix(mix(prefix.of(starts, ends) + (ends - starts).astype(np.uint64)) + text.astype(np.uint64))
    order = np.argsort(line, kind="stable")
    repeated = order[1:][line[order][1:] == line[order][:-1]]
    out["n_dup_lines"] = np.bincount(text[repeated], minlength=count)
    return {n: pa.array(out[n].astype(np.int64)) for n in STATISTICS}


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the STATISTICS of its ``text``."""
    return add_columns(docs, "text", SCHEMA, statistics)


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


#: Features of the rules: statistic over statistic (the denominator counts as 1 at least).
FEATURES = {
    "words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def _feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    value = F.col(top).cast("double")
    return value / F.greatest(F.col(bottom), F.lit(1)).cast("double") if bottom else value


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = _feature(self.feature)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _best_condition(x, bad, hit) -> Condition | None:
    """The threshold with the highest FOIL gain among documents still covered."""
    p0, n0 = int((bad & hit).sum()), int((~bad & hit).sum())
    base = math.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for name in FEATURES:
        value, label = x[name][hit], bad[hit]
        order = np.argsort(value, kind="stable")
        value, label = value[order], label[order]
        cuts = np.flatnonzero(value[1:] != value[:-1])
        if not len(cuts):
            continue
        low_p = np.cumsum(label)[cuts]
        low_n = cuts + 1 - low_p
        middle = (value[cuts] + value[cuts + 1]) / 2
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = float(gain[i]), Condition(name, above, float(middle[i]))
    return found


def _grow(x, bad) -> Rule:
    hit, rule = np.ones(len(bad), bool), ()
    while len(rule) < len(FEATURES) and (~bad & hit).any():
        condition = _best_condition(x, bad, hit)
        if condition is None:
            break
        rule += (condition,)
        hit &= condition.holds(x)
    return rule


def _worth(rule: Rule, x, bad) -> float:
    hit = _covers(rule, x, len(bad))
    p, n = int((bad & hit).sum()), int((~bad & hit).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, x, bad) -> Rule:
    while len(rule) > 1 and _worth(rule[:-1], x, bad) >= _worth(rule, x, bad):
        rule = rule[:-1]
    return rule


def learn(
    x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, precision: float = 0.9, seed: int = 5
) -> list[Rule]:
    """An ordered list of rules that reject documents like the ``bad`` ones.

    Stops when a rule, after pruning, is right less often than ``precision`` on
    the held-out third, or covers none of its bad documents.
    """
    bad = np.asarray(bad, bool)
    held = np.random.default_rng(seed).permutation(len(bad)) % 3 == 0
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    for _ in range(max_rules):
        train, test = left & ~held, left & held
        if not (bad & train).any() or not (bad & test).any():
            break
        part = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        rule = _grow(*part(train))
        if not rule:
            break
        rule = _prune(rule, *part(test))
        xt, bt = part(test)
        hit = _covers(rule, xt, len(bt))
        right = int((bt & hit).sum())
        if not right or right < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def keeps(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: true keeps."""
    verdict = None
    for rule in rules:
        fits = rule[0].column()
        for c in rule[1:]:
            fits = fits & c.column()
        verdict = F.when(fits, False) if verdict is None else verdict.when(fits, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 5):
    """Features and badness of at most ``rows`` labelled documents that pass the base rule.

    The sample is the labelled documents with the smallest seeded hashes of
    their ids, so it is the same on every run. A document labelled twice counts
    as bad if any label says so; null ids and labels are left out. Of rows with
    one id the text with the smallest hash is taken.
    """
    labels = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    chosen = (
        labels.groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(rows)
    )
    # The sample has a fixed row bound, so it may be broadcast.
    few = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one row per labelled id, however often it stands in the table
    few = few.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = with_statistics(few).where(~base_failed())
    rows_ = found.select("doc_id", "quality", *[_feature(f).alias(f"f_{f}") for f in FEATURES]).toPandas()
    rows_ = rows_.sort_values(["doc_id", "f_words"], kind="stable")
    x = {f: rows_[f"f_{f}"].to_numpy(float) for f in FEATURES}
    return x, rows_["quality"].to_numpy() == 0


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the STATISTICS of every text, ``base_failed`` and ``kept``.

    ``kept`` is false where ``base_failed``, else what the learned list says.

    Defined cases: a null or empty text has all statistics 0 and fails the base
    rule; without labels the list is empty and the base rule alone decides;
    repeated rows get equal verdicts; an empty table gives an empty result;
    columns named like a new one are replaced.
    """
    rules = learn(*labelled_sample(docs, labels, sample_rows))
    docs = unclash(docs, ("doc_id", "text"), ("base_failed", "kept"))
    judged = with_statistics(docs).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & keeps(rules))
