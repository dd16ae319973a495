"""Quality rules with risk-controlled thresholds.

Base figures of a text decide hard failures. Beyond them, each rule scores a document
(symbols per word, capitals per letter, repeated words, repeated lines) and rejects
scores above a cut. The cuts come from labelled documents: per stratum and rule the cuts
of a fixed grid are tried from lenient to strict, and a cut is valid while the exact
binomial (Clopper-Pearson) bound says that fewer than ``alpha / rules`` of good documents
fail it, at a level of ``delta`` shared by Bonferroni's correction over all strata and
rules. Trying stops at the first cut that is not valid, so the order of trial needs no
further correction. With the chance 1 - delta no stratum loses more than ``alpha`` of its
good documents to the rules. A stratum with too few labels has no cut and keeps everything.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from recordflow.llm.common import saved, text_bytes

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30

GRID = 200
ALPHA = 0.01
DELTA = 0.05
# Most strata whose cuts are sent to every task; more are joined by a shuffle.
FEW_STRATA = 10_000

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_bangs long"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

BLANKS = b" \t\n\v\f\r"
CAPITALS = bytes(range(65, 91))


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    seen: dict[bytes, int] = {}
    twice = bytearray(n)
    some = False
    for i, (a, b) in enumerate(zip(starts, ends[WINDOW - 1:])):
        first = seen.setdefault(joined[a:b], i)
        if first != i:
            twice[first] = twice[i] = 1
            some = True
    if not some:
        return 0
    covered, until = 0, 0
    for i in range(n):
        if twice[i]:
            covered += i + WINDOW - max(i, until)
            until = i + WINDOW
    return covered


def text_figures(text: bytes) -> tuple[int, ...]:
    """The figures of one text, in the order of FIGURES."""
    words = text.split()
    decoded = text.decode("utf-8", "replace")
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    without = lambda chars: len(text) - len(text.translate(None, chars))
    return (len(words), len(decoded) - without(BLANKS), without(SYMBOLS.encode()), dup, _repeat_words(words), lines, without(CAPITALS), text.count(b"!"))


def figures(text: Column) -> Column:
    """Struct of FIGURES for a column of UTF-8 bytes."""
    names = [f.split()[0] for f in FIGURES.split(", ")]

    @F.arrow_udf("struct<" + FIGURES.replace(" long", ": bigint") + ">")
    def run(texts: pa.Array) -> pa.Array:
        rows = [text_figures(t) for t in texts.to_pylist()]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run.asNondeterministic()(text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def scores() -> dict[str, Column]:
    """Rule scores; the share that a cut of the grid stands for is score / GRID."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "capitals": F.col("n_upper") / chars,
        "bangs": F.col("n_bangs") / words,
        "repeats": F.col("n_repeat_words") / words,
        "lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    }


def bins() -> Column:
    """Map of rule to bin: a score in bin b is above the cuts below b."""
    return F.create_map(*[x for name, s in scores().items() for x in (F.lit(name), F.least(F.ceil(s * GRID), F.lit(GRID + 1)).cast("int"))])


# --- exact binomial bounds ---

def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return value


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def binomial_cdf(k: int, n: int, p: float) -> float:
    """Chance of k or fewer of n at rate p."""
    return 1.0 if k >= n else beta_cdf(1 - p, n - k, k + 1)


def strictest(good_above: list[int], n: int, alpha: float, level: float) -> int | None:
    """Strictest valid cut. ``good_above[c]``: good documents with a score above cut c.

    Cuts are tried from the most lenient down; c is valid if the exact upper bound on the
    share of good documents above it is at most alpha.
    """
    best = None
    for c in range(len(good_above) - 1, -1, -1):
        if binomial_cdf(good_above[c], n, alpha) > level:
            break
        best = c
    return best


def fit_cuts(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> tuple[DataFrame, int]:
    """Cuts per stratum, as (stratum, cuts map<rule, cut>), from rows (stratum, bins, good) of
    labelled documents that pass the base rules; and the number of strata."""
    counts = saved(labelled.where("good").select("stratum", F.explode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin").agg(F.count("*").alias("n")), "quality-counts")
    strata = counts.select("stratum").distinct().count()
    rules = len(scores())
    level = delta / max(1, strata * rules)

    def choose(key, group):
        import pandas as pd
        at = dict(zip(group["bin"], group["n"]))
        n, above, total = sum(at.values()), [0] * (GRID + 1), 0
        for c in range(GRID, -1, -1):
            total += at.get(c + 1, 0)
            above[c] = total
        best = strictest(above, n, alpha / rules, level)
        return pd.DataFrame([] if best is None else [(key[0], key[1], best)], columns=["stratum", "rule", "cut"])

    cuts = counts.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cut int")
    return cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts")), strata


def passes_rules() -> Column:
    """True unless a rule's bin is above the stratum's cut for it."""
    return F.coalesce(~F.exists(F.map_keys("cuts"), lambda r: F.element_at("bins", r) > F.element_at("cuts", r)), F.lit(True))


def _with_cuts(df: DataFrame, cuts: DataFrame, strata: int) -> DataFrame:
    named = cuts.withColumnRenamed("stratum", "_s")
    side = F.broadcast(named) if strata <= FEW_STRATA else named
    return df.join(side, F.col("_s").eqNullSafe(F.col("stratum")), "left").drop("_s")


def _good(labels: DataFrame) -> DataFrame:
    """One row per labelled document: good if all its labels say so."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") == 1).alias("good"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang",
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and verdict of every document: (id_col, BASE figures, base_failed, kept).

    A null text has no words and fails the base rules, as does an empty one. Repeated rows
    are judged alike. A null stratum is a stratum of its own. Labels of unknown documents
    and null labels are ignored; a document with contradicting labels counts as bad. Empty
    labels give no cuts, an empty table no rows. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum).cast("string").alias("stratum"), figures(text_bytes(text_col)).alias("f"))
    rows = saved(rows.select("id", "stratum", "f.*"), "quality").withColumn("bins", bins()).withColumn("base_failed", base_failed())
    cuts, strata = fit_cuts(rows.where("NOT base_failed").join(_good(labels), "id").select("stratum", "bins", "good"), alpha, delta)
    judged = _with_cuts(rows, cuts, strata)
    return judged.select(F.col("id").alias(id_col), *BASE, "base_failed", (~F.col("base_failed") & passes_rules()).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang",
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``quality_verdicts`` keeps, with all their columns, whatever their names.

    Texts stay where they are: the figures are made once for the labelled documents and
    once for all, instead of moving texts through a shuffle.
    """
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row")).select("row", F.col(f"row.{id_col}").alias("id"), F.col(f"row.{stratum}").cast("string").alias("stratum"),
                                                            figures(text_bytes(f"row.{text_col}")).alias("f"))
    rows = rows.select("row", "id", "stratum", "f.*").withColumn("bins", bins()).withColumn("base_failed", base_failed())
    labelled = rows.drop("row").where("NOT base_failed").join(_good(labels), "id").select("stratum", "bins", "good")
    cuts, strata = fit_cuts(labelled, alpha, delta)
    judged = _with_cuts(rows, cuts, strata)
    return judged.where(~F.col("base_failed") & passes_rules()).select("row.*")
