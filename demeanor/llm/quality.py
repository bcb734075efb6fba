"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are maximal runs of characters other than space and U+0009 to U+000D. A null or empty text has
no words, fails the base rule and is not kept. Repeated windows are compared by 64-bit hashes.
Extra columns of the input, whatever their names, are neither read nor returned by ``measure``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Frequent function words of English, German, French and Spanish, in lower case.
STOP_WORDS = (
    "the of and to in a is that for on with as was are be this by at from or an it not "
    "der die das und zu den mit von ist im ein eine auf für nicht des sich dem als auch "
    "le la les de des du et un une en à que qui dans pour par sur est au ce "
    "el los las y que se una por con para su lo del como más"
).split()


@dataclass(frozen=True)
class Rule:
    """``name``: rejects where ``value`` (SQL over the measures) is beyond ``limit``; ``least`` words are needed to judge."""

    name: str
    value: str
    sense: str
    limit: float
    least: int = 0

    def sql(self) -> str:
        test = f"({self.value}) {self.sense} {self.limit}D"
        return f"(n_words >= {self.least} AND {test})" if self.least else f"({test})"


RULES = (
    Rule("short_words", "word_chars / n_words", "<", 2.0, 10),
    Rule("long_words", "word_chars / n_words", ">", 15.0, 10),
    Rule("symbols", "n_symbols / n_words", ">", 0.25, 10),
    Rule("stop_words", "n_stop_words / n_words", "<", 0.01, 40),
    Rule("duplicate_lines", "n_dup_lines / n_lines", ">", 0.6, 10),
    Rule("shouted_words", "n_shouts / n_words", ">", 0.5, 10),
)
RESERVED = frozenset(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_shouts", "_row", "base_failed", "rejected_by", "kept"))
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _measures(text: Column) -> list[dict[str, Column]]:
    """Columns in layers; each layer is one projection over the one before, so nothing is computed twice."""
    c = F.col
    first = {"_t": F.coalesce(text, F.lit(""))}
    second = {
        "_w": F.when(F.length(F.trim(c("_t"), F.lit(SPACES))) > 0, F.split(F.trim(c("_t"), F.lit(SPACES)), r"[ \t\n\x0B\f\r]+")).otherwise(F.array().cast("array<string>")),
        "_lines": F.filter(F.split(c("_t"), "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0),
        "n_symbols": (F.length(c("_t")) - F.length(F.translate(c("_t"), SYMBOLS, ""))).cast("long"),
    }
    third = {
        "_h": F.transform(c("_w"), lambda x: F.xxhash64(x)),
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda x: x.isin(*STOP_WORDS))).cast("long"),
        "n_shouts": F.size(F.filter("_w", lambda x: x.endswith("!!"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_symbols": c("n_symbols"),
    }
    kept = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_shouts", "n_lines", "n_dup_lines"]
    same = {k: c(k) for k in kept}
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]))
    fourth = same | {"_win": F.when(F.size("_h") >= WINDOW, windows)}
    # Only texts with some window twice pay for sorting.
    order = F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    fifth = same | {"_sorted": F.when(F.size(F.array_distinct("_win")) < F.size("_win"), order)}
    twice = F.filter("_sorted", lambda e, i: (F.get("_sorted", i - 1)["h"] == e["h"]) | F.coalesce(F.get("_sorted", i + 1)["h"] == e["h"], F.lit(False)))
    sixth = same | {"_at": F.sort_array(F.transform(twice, lambda e: e["p"]))}
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    seventh = same | {"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), "_row": F.monotonically_increasing_id()}
    return [first, second, third, fourth, fifth, sixth, seventh]


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), row: bool = False) -> DataFrame:
    """The ``keep`` columns, but for those of the names RESERVED, beside all measures of each text; one row for each row of ``docs``.

    With ``row``, also a row number, ``_row``; a filter that uses it stays above the measures.
    """
    keep = tuple(c for c in keep if c.lower() not in RESERVED)
    inner = {f"_keep{k}": F.col(f"`{x}`") for k, x in enumerate(keep)}
    df = docs.select(F.col(f"`{text}`").alias("_text"), *[v.alias(k) for k, v in inner.items()])
    for layer in _measures(F.col("_text")):
        df = df.select(*inner, *[v.alias(k) for k, v in layer.items()])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_shouts"]
    return df.select(*[F.col(f"_keep{k}").alias(x) for k, x in enumerate(keep)], *names, *(["_row"] if row else []))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``base_failed``, ``rejected_by`` (names of the rules that reject) and ``kept``, as one projection."""
    failed = F.coalesce(F.expr(BASE_FAILED), F.lit(True))
    named = [F.when(F.coalesce(F.expr(r.sql()), F.lit(False)), F.lit(r.name)) for r in rules]
    hits = F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")
    return measured.select("*", failed.alias("base_failed"), hits.alias("rejected_by"), (~failed & (F.size(hits) == 0)).alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with its measures and verdict."""
    return judge(measure(docs, text, keep), rules)


def kept_rows(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The row number in the condition keeps Catalyst from pushing it down through the measures, which
    would write their nested expressions out in the filter over and over.
    """
    judged = judge(measure(docs.withColumnsRenamed({c: f"_in{k}" for k, c in enumerate(docs.columns)}), f"_in{docs.columns.index(text)}", tuple(f"_in{k}" for k in range(len(docs.columns))), row=True), rules)
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select(*[F.col(f"_in{k}").alias(c) for k, c in enumerate(docs.columns)])
