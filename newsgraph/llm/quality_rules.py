"""Quality rules learned from labelled statistics.

Statistics of every text are computed with array operations over batches. A
decision list is learned from a bounded sample of labelled rows by sequential
covering: a rule grows condition by condition by information gain on one part
of the sample, is pruned on the other part, and the rows it covers are taken
out before the next. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.words import find_words, lookup, raw_text, shingles, slices
from newsgraph.session import stored

# The symbols counted, and the limits of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# Labelled rows that a list is learned from, at most; chosen by a hash of the id.
SAMPLE = 20_000
THRESHOLDS = 48
LEAST_PRECISION = 0.9
MOST_CONDITIONS = 4
MOST_RULES = 12

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_upper", "n_marks", "n_digits", "n_distinct")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?"
_NOT_IN_WORDS = b"\x20\x09\x0a\x0b\x0c\x0d" + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a character


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of a mask over each text's bytes."""
    counts = np.zeros(len(at) - 1, np.int64)
    filled = np.flatnonzero(np.diff(at))
    if len(filled):
        counts[filled] = np.add.reduceat(mask[at[0] : at[-1]], at[filled] - at[0], dtype=np.int64)
    return counts


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[first[1:]] - total[first[:-1]]


def _equal_to_another(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys within groups: whether one stands elsewhere in its group, and whether it stood before."""
    order = np.lexsort((keys, group))
    k, g = keys[order], group[order]
    same = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    again, any_other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    any_other[order[1:]] |= same
    any_other[order[:-1]] |= same
    return any_other, again


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text by name; all 0 for a null or empty one."""
    data, at = raw_text(column)
    words = find_words(data, at, lower=False)
    bytes_of = lambda members: _per_text(lookup(members)[data], at)
    numbers = np.repeat(np.arange(len(at) - 1), words.counts())
    hashed, text_of, place = shingles(words, 3)
    twice, _ = _equal_to_another(hashed, text_of)
    repeated = np.zeros(len(words.hashes) + 2, bool)
    for k in range(3):
        repeated[place[twice] + k] = True
    lines = find_words(data, at, lower=False, breaks=b"\n")
    worded = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
    line_of = np.repeat(np.arange(len(at) - 1), lines.counts())
    _, again = _equal_to_another(lines.hashes[worded], line_of[worded])
    _, known = _equal_to_another(words.hashes, numbers)
    return {
        "n_words": words.counts(),
        "word_chars": _per_text(~lookup(_NOT_IN_WORDS)[data], at),
        "n_symbols": bytes_of(SYMBOLS),
        "n_dup_lines": np.bincount(line_of[worded][again], minlength=len(at) - 1),
        "n_repeat_words": _per_row(repeated[: len(words.hashes)], words.first),
        "n_lines": np.bincount(line_of[worded], minlength=len(at) - 1),
        "n_upper": bytes_of(_UPPER),
        "n_marks": bytes_of(_MARKS),
        "n_digits": bytes_of(_DIGITS),
        "n_distinct": words.counts() - _per_row(known, words.first),
    }


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the row as it was) and the counts of ``text``; no column names can clash."""
    names = [*COUNTS, *MORE_COUNTS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            both = pa.RecordBatch.from_arrays([row, row.field(place)], names=["row", "text"])
            for part in slices(both):
                made = text_statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), *(pa.array(made[n].astype(np.int64)) for n in names)], names=["row", *names]
                )

    place = df.columns.index(text)
    rows = df.select(F.struct("*").alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(count, f"row {kind}, " + ", ".join(f"{n} long" for n in names))


# What rules look at: ratios of the counts, 0 where the divisor is 0.
_RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeated_per_word": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "distinct_per_word": ("n_distinct", "n_words"),
}


def ratio(name: str) -> Column:
    over, under = _RATIOS[name]
    if under is None:
        return F.col(over).cast("double")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.name]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = ratio(self.name)
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    for c in rule:
        mask &= c.holds(values)
    return mask


def _best_condition(values, bad, inside) -> tuple[float, Condition | None]:
    """The condition with the largest gain over the rows that the rule covers so far."""
    p0, n0 = int((bad & inside).sum()), int(inside.sum())
    best, found = 0.0, None
    if not p0 or p0 == n0:
        return best, found
    base = np.log2(p0 / n0)
    for name, line in values.items():
        held, held_bad = line[inside], bad[inside]
        order = np.argsort(held, kind="stable")
        ordered, right = held[order], np.cumsum(held_bad[order])
        # Thresholds: about THRESHOLDS places between different neighbours, halfway.
        change = np.flatnonzero(ordered[1:] > ordered[:-1])
        if not len(change):
            continue
        change = change[np.unique(np.linspace(0, len(change) - 1, THRESHOLDS).astype(int))]
        for above in (False, True):
            p = p0 - right[change] if above else right[change]
            n = n0 - (change + 1) if above else change + 1
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / n) - base), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                middle = float((ordered[change[k]] + ordered[change[k] + 1]) / 2)
                best, found = float(gain[k]), Condition(name, above, middle)
    return best, found


def learn_rules(values: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Rules for the bad rows, in order, from aligned columns of statistics.

    Every third row serves for pruning. A rule whose precision on those rows is
    under LEAST_PRECISION ends the list. Without bad or without good rows there
    are no rules.
    """
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while len(rules) < MOST_RULES and (bad & left & ~prune).any():
        rule: Rule = ()
        inside = left & ~prune
        while len(rule) < MOST_CONDITIONS:
            _, condition = _best_condition(values, bad, inside)
            if condition is None:
                break
            rule = (*rule, condition)
            inside = inside & condition.holds(values)
        test, best, kept = left & prune, None, ()
        for k in range(1, len(rule) + 1):
            mask = _covered(rule[:k], values, n) & test
            p, q = int((bad & mask).sum()), int((~bad & mask).sum())
            worth = (p - q) / (p + q) if p + q else -1.0
            if best is None or worth > best:
                best, kept = worth, rule[:k]
        mask = _covered(kept, values, n) & test if kept else np.zeros(n, bool)
        hits = int(mask.sum())
        if not hits or (bad & mask).sum() < LEAST_PRECISION * hits:
            break
        rules.append(kept)
        left &= ~_covered(kept, values, n)
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that fits; 0 where none does."""
    found = None
    for k, rule in enumerate(rules, 1):
        fits = F.lit(True)
        for c in rule:
            fits = fits & c.column()
        found = F.when(fits, F.lit(k)) if found is None else found.when(fits, F.lit(k))
    return F.lit(0) if found is None else found.otherwise(F.lit(0))


def fit_rules(counted: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the counts of documents (``doc_id`` and counts) and ``labels`` (``doc_id, quality``).

    At most ``sample`` labelled rows, those with the smallest hash of the id,
    come to the driver, as numbers; rows whose hash is far beyond that share are
    left out before tasks send any. Rows with a null id or quality are left out,
    and so are those that the base rules reject, whatever the learned ones say.
    """
    known = labels.select(F.col("doc_id").alias("id"), "quality").filter("id IS NOT NULL AND quality IS NOT NULL")
    joined = counted.join(known, F.col("doc_id") == F.col("id"))
    share = 1.1 * sample / max(1, known.count()) + 0.001
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    near = joined.filter((place <= int(min(1.0, share) * (1 << 30))) & ~base_failed())
    picked = near.select(*[ratio(n).alias(n) for n in _RATIOS], (F.col("quality") == 0).alias("bad"), "id", place.alias("place"))
    rows = picked.orderBy("place", "id", *_RATIOS).limit(sample).toPandas()
    return learn_rules({n: rows[n].to_numpy(float) for n in _RATIOS}, rows["bad"].to_numpy(bool))


def base_failed() -> Column:
    few = F.col("n_words") < LEAST_WORDS
    return few | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)


def judge_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every document's counts and verdict: ``doc_id``, counts, ``base_failed, rule, kept``.

    ``rule`` is the number of the rejecting rule, or 0. A null or empty text has
    no words and fails the base rules. Repeated rows give repeated rows; other
    columns are not read; without labels only the base rules judge; an empty
    table gives an empty one.
    """
    counted = stored(
        with_statistics(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), *COUNTS, *MORE_COUNTS), "counts"
    )
    rules = fit_rules(counted, labels, sample)
    judged = counted.select("*", base_failed().alias("base_failed"), rule_number(rules).alias("rule"))
    return judged.select("*", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that the base rules and the learned rules keep."""
    counted = with_statistics(docs)
    narrow = stored(counted.select(F.col("row.doc_id").alias("doc_id"), *COUNTS, *MORE_COUNTS), "counts")
    rules = fit_rules(narrow, labels, sample)
    return counted.filter(~base_failed() & (rule_number(rules) == 0)).select("row.*")
