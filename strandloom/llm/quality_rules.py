"""Quality rules: a learned decision list over text statistics, in Spark expressions only.

Statistics come from higher-order array functions on each row, so no row leaves its partition. Sequential covering
learns rules for labelled low-quality documents: each rule is grown one threshold condition at a time on one part of a
bounded sample of labelled rows (FIT_ROWS), pruned on the other part, and kept only if it is precise there. The list is
emitted as ordered `CASE WHEN` branches.

Defined cases: a null text counts as empty; an empty text has no words, so it fails the base rule; repeated rows each
get their own verdict; without usable labels the list is empty and only the base rule rejects. Columns of the input
keep their values, whatever their names; work columns are named with RESERVED.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows used to learn the list, at most: those whose id hashes lowest.
FIT_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule must be as precise as this on the pruning part, and cover as many of its bad rows.
MIN_PRECISION = 0.93
MIN_COVER = 4
CUTS = 32

RESERVED = "__quality_"
WINDOW = 8
MIN_WORDS = 20
#: Percent of a text's words in repeated windows, beyond which the base rule rejects it.
MAX_REPEAT = 30

_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "marks_per_word")


class Condition(NamedTuple):
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self, stats: Column) -> Column:
        value = stats[self.feature]
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame, text: str = "text", into: str = f"{RESERVED}stats") -> DataFrame:
    """docs with one struct column more: the base counts (long) and the features (double) of each text."""
    own = {k: f"{RESERVED}{k}" for k in ("text", "words", "lines", "hashes", "windows", "sorted", "starts", "n", "repeat")}
    c = {k: F.col(v) for k, v in own.items()}
    has_word = lambda line: F.length(F.translate(line, _SPACES, "")) > 0
    df = docs.withColumn(own["text"], F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns(
        {
            own["words"]: F.filter(F.split(c["text"], _SPACE), lambda w: w != ""),
            own["lines"]: F.filter(F.split(c["text"], "\n"), has_word),
        }
    )
    df = df.withColumns({own["n"]: F.size(c["words"]), own["hashes"]: F.transform(c["words"], lambda w: F.xxhash64(w))})
    none = F.array().cast("array<bigint>")
    starts = F.sequence(F.lit(1), F.greatest(c["n"] - (WINDOW - 1), F.lit(1)))
    df = df.withColumn(
        own["windows"],
        F.when(c["n"] >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(c["hashes"], i, WINDOW)))).otherwise(none),
    )
    repeats = F.size(F.array_distinct(c["windows"])) < F.size(c["windows"])
    pairs = F.array_sort(F.transform(c["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn(own["sorted"], F.when(repeats, pairs))
    same = lambda x, i: F.coalesce(F.get(c["sorted"], i)["h"] == x["h"], F.lit(False))
    found = F.filter(c["sorted"], lambda x, i: same(x, i - 1) | same(x, i + 1))
    df = df.withColumn(own["starts"], F.array_sort(F.transform(found, lambda x: x["p"])))
    #: A window covers as many new words as lie between its start and the next one's.
    steps = F.transform(c["starts"], lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(c["starts"], i + 1) - p, F.lit(WINDOW))))
    df = df.withColumn(own["repeat"], F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)))

    length = F.length(c["text"])
    chars = F.length(F.translate(c["text"], _SPACES, ""))
    symbols = length - F.length(F.translate(c["text"], _SYMBOLS, ""))
    upper = length - F.length(F.regexp_replace(c["text"], r"\p{Lu}", ""))
    marks = length - F.length(F.translate(c["text"], "!?.,;:", ""))
    lines, dup = F.size(c["lines"]), F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    fields = [
        c["n"].cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        c["repeat"].cast("long").alias("n_repeat_words"),
        per(chars, c["n"]).alias("chars_per_word"),
        per(symbols, c["n"]).alias("symbols_per_word"),
        per(dup, lines).alias("dup_line_share"),
        per(c["repeat"], c["n"]).alias("repeat_share"),
        per(upper, chars).alias("upper_share"),
        per(marks, c["n"]).alias("marks_per_word"),
    ]
    return df.withColumn(into, F.struct(*fields)).drop(*own.values())


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT * stats["n_words"])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[dict]:
    """Features and label of at most `rows` labelled documents, those whose id hashes lowest."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id")
        .limit(rows)
    )
    chosen = chosen.select(F.col("doc_id").alias(f"{RESERVED}id"), F.col("quality").alias(f"{RESERVED}label"))
    stats = f"{RESERVED}stats"
    picked = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col(f"{RESERVED}id"))  # at most `rows` rows
    picked = statistics(picked.select("text", f"{RESERVED}id", f"{RESERVED}label"))
    part = F.pmod(F.xxhash64(F.lit("part"), f"{RESERVED}id"), F.lit(3)) == 0
    wanted = [F.col(stats)[f].cast("double").alias(f) for f in FEATURES]
    got = picked.select(F.col(f"{RESERVED}id").alias("id"), (F.col(f"{RESERVED}label") == 0).alias("bad"), part.alias("prune"), *wanted)
    return sorted((r.asDict() for r in got.collect()), key=lambda r: (r["id"], *(r[f] for f in FEATURES)))


def _cuts(rows: list[dict], feature: str) -> list[float]:
    """Midpoints of gaps between neighbouring distinct values: some spread evenly over them, and the widest."""
    values = sorted({r[feature] for r in rows})
    gaps = list(zip(values, values[1:]))
    if len(gaps) > CUTS:
        half = CUTS // 2
        even = [gaps[i * (len(gaps) - 1) // (half - 1)] for i in range(half)]
        gaps = sorted({*even, *sorted(gaps, key=lambda g: (g[0] - g[1], g[0]))[:half]})
    return [(a + b) / 2 for a, b in gaps]


def _score(rows: list[dict], rule: Rule) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _grown(rows: list[dict], cuts: dict[str, list[float]]) -> Rule:
    """Adds the condition with the best gain (bad rows kept times precision won) until no good row is covered."""
    import math

    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS and rows:
        bad = sum(r["bad"] for r in rows)
        if bad in (0, len(rows)):
            break
        now, best = math.log2(bad / len(rows)), (0.0, None)
        for feature, values in cuts.items():
            ordered = sorted((r[feature], r["bad"]) for r in rows)
            at = p = 0
            for cut in values:
                while at < len(ordered) and ordered[at][0] <= cut:
                    p += ordered[at][1]
                    at += 1
                for above, hit, n in ((False, p, at), (True, bad - p, len(ordered) - at)):
                    if hit and n < len(rows):
                        gain = hit * (math.log2(hit / n) - now)
                        # a tie goes to the higher cut of a lower bound, which rejects less
                        same = above and best[1] and best[1].feature == feature and best[1].above and gain > best[0] - 1e-12
                        if gain > best[0] + 1e-12 or same:
                            best = (gain, Condition(feature, above, cut))
        if best[1] is None:
            break
        rule += (best[1],)
        rows = [r for r in rows if best[1].holds(r)]
    return rule


def _pruned(rows: list[dict], rule: Rule) -> Rule:
    """Drops last conditions as long as the rule's worth on the pruning part does not fall."""
    worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_score(rows, r))
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learned(rows: list[dict]) -> list[Rule]:
    """Ordered rules for bad rows by sequential covering."""
    cuts = {f: _cuts(rows, f) for f in FEATURES}
    grow, prune, rules = [r for r in rows if not r["prune"]], [r for r in rows if r["prune"]], []
    while len(rules) < MAX_RULES and any(r["bad"] for r in grow):
        rule = _pruned(prune, _grown(grow, cuts))
        p, n = _score(prune, rule) if rule else (0, 0)
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (grow, prune))
    return rules


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        test = rule[0].column(stats)
        for more in rule[1:]:
            test &= more.column(stats)
        out = out.when(test, F.lit(k))
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the struct column `__quality_stats` and `__quality_rule` (int: 0 base rule, k learned rule, null kept)."""
    rules = learned(labelled_sample(docs, labels))
    stats = F.col(f"{RESERVED}stats")
    rule = F.when(base_failed(stats), F.lit(0)).otherwise(verdict(stats, rules))
    return statistics(docs).withColumn(f"{RESERVED}rule", rule)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that no rule rejects, with the columns they came with."""
    # the partition's number keeps the filter above the statistics; pushed below them, it would repeat their expressions
    part = F.col(f"{RESERVED}part")
    rows = judged(docs, labels).withColumn(f"{RESERVED}part", F.spark_partition_id())
    return rows.where(F.col(f"{RESERVED}rule").isNull() & (part >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: base statistics, base_failed, kept, and the rule that rejected it."""
    stats, rule = F.col(f"{RESERVED}stats"), F.col(f"{RESERVED}rule")
    return judged(docs, labels).select(
        "doc_id", *[stats[f].alias(f) for f in BASE], base_failed(stats).alias("base_failed"), rule.isNull().alias("kept"), rule.alias("rule")
    )
