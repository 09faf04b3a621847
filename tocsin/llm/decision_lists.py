"""Quality rules learnt as a decision list, and the text statistics they test.

Sequential covering: a rule is grown on one part of the labelled rows, one
threshold condition at a time by information gain, pruned on another part,
and kept if it is precise there; the rows it covers leave, and the next rule
is grown.  The rules become one ordered SQL conditional expression over the
statistics, so judging a document is a projection without Python or shuffle.

Each step of learning is one aggregate over the labelled statistics; what
comes to the driver are counts per feature and threshold, a fixed number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import id_remainder, pin

#: White space of words, and the characters counted as symbols.
WHITE_CHARS = " \t\n\x0b\f\r"
WHITE, NOT_WHITE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: What fails a text whatever the rules say.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Bits that the place of a run takes beside its code.
PLACE_BITS = 31
#: Labelled rows that the rules are learnt from, at most.
SAMPLE_ROWS = 40_000
#: Thresholds tried for a feature.
CUTS = 31
MOST_RULES, MOST_CONDITIONS = 8, 3
#: What a pruned rule must reach on the rows kept for pruning.
PRECISION, LEAST_COVERED = 0.9, 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "words_per_line",
]


def words_of(text: Column) -> Column:
    """Words of a text that begins and ends with one, or is empty."""
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, WHITE))


def with_statistics(rows: DataFrame, text_col: str) -> DataFrame:
    """Put the numbers of ``BASE`` and ``FEATURES`` in place of the text; a null text has no word.

    ``n_repeat_words`` counts words in runs of three that the text holds twice
    or more.  Runs have 64-bit codes; 33 bits of a code and its place are
    sorted as one number, neighbours that agree are compared by whole codes.
    Every step works on one array per text, linear but for the sort.
    """
    kept = [c for c in rows.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    said = rows.select(*kept, text.alias("_text"), F.btrim(text, F.lit(WHITE_CHARS)).alias("_bare"))
    cut = said.select(*kept, "_text", words_of(F.col("_bare")).alias("_words"))
    runs = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda word, i: F.xxhash64(word, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    coded = cut.select(*kept, "_text", "_words", runs.alias("_codes"))
    placed = coded.withColumn(
        "_sorted",
        F.sort_array(F.transform("_codes", lambda code, i: F.shiftleft(code, PLACE_BITS).bitwiseOR(i.cast("long")))),
    )

    # No neighbour gives null, which counts as not alike.
    def alike(code: Column, other: Column) -> Column:
        return F.shiftright(code.bitwiseXOR(other), PLACE_BITS) == 0

    near = placed.withColumn(
        "_near",
        F.filter(
            "_sorted",
            lambda code, i: alike(code, F.get("_sorted", i - 1)) | alike(code, F.get("_sorted", i + 1)),
        ),
    )
    whole = near.withColumn(
        "_whole",
        F.array_sort(F.transform("_near", lambda code: F.struct(
            F.get("_codes", code.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")).alias("code"),
            code.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("at"),
        ))),
    )
    repeated = F.filter(
        "_whole",
        lambda row, i: (row["code"] == F.get("_whole", i - 1)["code"]) | (row["code"] == F.get("_whole", i + 1)["code"]),
    )
    covered = F.flatten(F.transform(repeated, lambda row: F.array(row["at"], row["at"] + 1, row["at"] + 2)))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(NOT_WHITE))
    # Marked as not repeatable, so that no later filter copies these steps, lambdas and all, into itself.
    once = F.monotonically_increasing_id() >= 0
    counted = whole.select(
        *kept,
        F.when(once, F.size("_words")).cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda total, word: total + F.char_length(word)).alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        F.regexp_count("_text", F.lit("[A-Z]")).alias("_upper"),
        F.regexp_count("_text", F.lit("[0-9]")).alias("_digits"),
    )
    counted = counted.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))

    def share(part: str | Column, of: str | Column) -> Column:
        return F.coalesce(F.try_divide(part, of).cast("double"), F.lit(0.0))

    features = {
        "words": F.col("n_words").cast("double"),
        "mean_word": share(F.col("word_chars"), F.col("n_words")),
        "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_share": share(F.col("n_dup_lines"), F.size("_lines")),
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "upper_share": share(F.col("_upper"), F.col("word_chars")),
        "digit_share": share(F.col("_digits"), F.col("word_chars")),
        "words_per_line": share(F.col("n_words"), F.size("_lines")),
    }
    return counted.select(*kept, *BASE, *[features[f].alias(f) for f in FEATURES])


Condition = tuple[str, bool, float]  # feature, above, threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction of threshold conditions and what it met on the rows kept for pruning."""

    conditions: tuple[Condition, ...]
    bad: int = 0
    good: int = 0

    def sql(self) -> str:
        return " AND ".join(f"{f} {'>' if above else '<='} {cut!r}D" for f, above, cut in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds names the fault of a row."""

    rules: tuple[Rule, ...]

    def sql(self) -> str:
        """Number of the first rule that holds, from 1, else 0: an ordered conditional expression."""
        if not self.rules:
            return "0"
        cases = " ".join(f"WHEN {rule.sql()} THEN {i}" for i, rule in enumerate(self.rules, 1))
        return f"CASE {cases} ELSE 0 END"

    def column(self) -> Column:
        return F.expr(self.sql()).cast("int")


def information(bad: int, good: int) -> float:
    return math.log2(bad / (bad + good)) if bad else -math.inf


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    found = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).first()
    # Quantiles of the bad rows as well: they may be few.
    bad = rows.filter("_bad").agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({*(found[f] or ()), *(bad[f] or ())}) for f in FEATURES}
    # Cuts half-way leave room between a rule and the rows it must not cover.
    return {f: sorted({*at, *((a + b) / 2 for a, b in zip(at, at[1:]))}) for f, at in cuts.items()}


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], bad: int, good: int) -> tuple[Condition, int, int] | None:
    """The condition that gains most information on ``rows``, with the bad and good rows it covers."""
    def below(feature: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[feature])), lambda cut: cut < F.col(feature)))

    bins = F.array(*[F.struct(F.lit(i).alias("feature"), below(f).alias("bin")) for i, f in enumerate(FEATURES)])
    counts = (
        rows.select("_bad", F.explode(bins).alias("at"))
        .groupBy("at.feature", "at.bin")
        .agg(F.count_if("_bad").alias("bad"), F.count_if(~F.col("_bad")).alias("good"))
        .collect()  # at most 4 * CUTS rows a feature
    )
    best, best_gain = None, 0.0
    for i, feature in enumerate(FEATURES):
        held = {r["bin"]: (r["bad"], r["good"]) for r in counts if r["feature"] == i}
        below_bad = below_good = 0
        for at, cut in enumerate(cuts[feature]):
            more = held.get(at, (0, 0))
            below_bad, below_good = below_bad + more[0], below_good + more[1]
            for above, b, g in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                gain = b * (information(b, g) - information(bad, good)) if b and b + g < bad + good else 0.0
                # Of equal gains the stricter condition wins: a high lower bound, a low upper one.
                if gain > best_gain or (above and best and gain == best_gain and best[0][:2] == (feature, True)):
                    best, best_gain = ((feature, above, cut), b, g), gain
    return best


def _grow(rows: DataFrame, cuts: dict[str, list[float]], bad: int, good: int) -> list[Condition]:
    conditions: list[Condition] = []
    for _ in range(MOST_CONDITIONS):
        found = _best_condition(rows, cuts, bad, good) if good else None
        if found is None:
            break
        condition, bad, good = found
        conditions = [c for c in conditions if c[:2] != condition[:2]] + [condition]
        rows = rows.filter(Rule((condition,)).sql())
    return conditions


def _prune(rows: DataFrame, conditions: list[Condition]) -> Rule:
    """The beginning of the conjunction that is worth most on rows it was not grown on."""
    starts = [Rule(tuple(conditions[: i + 1])) for i in range(len(conditions))]
    counts = rows.agg(*[
        F.count_if(F.expr(f"({'_bad' if bad else 'NOT _bad'}) AND {rule.sql()}")).alias(f"{'b' if bad else 'g'}{i}")
        for i, rule in enumerate(starts) for bad in (True, False)
    ]).first()
    rules = [Rule(rule.conditions, counts[f"b{i}"], counts[f"g{i}"]) for i, rule in enumerate(starts)]
    return max(rules, key=lambda r: ((r.bad - r.good) / max(1, r.bad + r.good), r.bad, -len(r.conditions)))


def learn_rules(
    rows: DataFrame, precision: float = PRECISION, least: int = LEAST_COVERED, most_rules: int = MOST_RULES
) -> DecisionList:
    """Sequential covering of the rows marked ``_bad``.

    ``rows`` hold ``FEATURES``, ``_bad`` and ``_prune``, which says whether a
    row prunes or grows; they must be pinned or repeatable.  Without bad or
    without good rows there is no rule.
    """
    cuts, rules = _thresholds(rows), []
    while len(rules) < most_rules:
        grow = rows.filter("NOT _prune")
        count = grow.agg(F.count_if("_bad").alias("bad"), F.count_if(~F.col("_bad")).alias("good")).first()
        if not count["bad"] or not count["good"]:
            break
        conditions = _grow(grow, cuts, count["bad"], count["good"])
        if not conditions:
            break
        rule = _prune(rows.filter("_prune"), conditions)
        if rule.bad < least or rule.bad < precision * (rule.bad + rule.good):
            break
        rules.append(rule)
        rows = rows.filter(f"NOT ({rule.sql()})")
    return DecisionList(tuple(rules))


def labelled_statistics(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int
) -> DataFrame:
    """Statistics of at most ``sample_rows`` labelled texts outside the held-out fifth.

    An id with several labels counts as good if one says so; labels other
    than 0 and 1, and null ids, are left out.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).filter(id_remainder(id_col, 5) != 0)
    once = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) == 0).alias("_bad"))
    order = F.xxhash64(F.lit(13), F.col("_id"))
    # At most sample_rows rows of two numbers.
    chosen = once.withColumn("_order", order).orderBy("_order", "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_said")).join(F.broadcast(chosen), "_id")
    prune = F.pmod(F.shiftright("_order", 7), F.lit(3)) == 0
    return pin(with_statistics(rows.select("_bad", prune.alias("_prune"), "_said"), "_said"))


def judge(
    docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Apply learnt rules: see ``quality``."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (id_remainder(id_col, 5) == 0).alias("held_out"), F.col(text_col).alias("_said")
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        with_statistics(rows, "_said")
        .select("doc_id", "held_out", *BASE, failed.alias("base_failed"), rules.column().alias("rule"))
        .select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule", "held_out")
    )


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Judge every text by its statistics and the rules learnt from ``labels``.

    Returns ``doc_id``, the numbers of ``BASE``, ``base_failed``, ``kept``,
    ``rule`` (number of the first learnt rule that holds, 0 if none does) and
    ``held_out`` (crc32 of the id as text leaves 0 by 5: never learnt from).
    Null, empty and blank texts have no word and fail the base rules.  Texts
    of any length are counted whole.  Repeated rows are judged alike, an empty
    table gives an empty result, without labels of both kinds only the base
    rules count; extra columns are not read.
    """
    return judge(docs, learn_rules(labelled_statistics(docs, labels, id_col, text_col, label_col, sample_rows)), id_col, text_col)
