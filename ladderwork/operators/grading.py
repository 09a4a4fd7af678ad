"""Grading of predictions against reference answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import extract_answer_tag, extract_last_number, other_key, plain_key, reference_answer
from ..functions.text import canonicalize_text, normalize_numeric


def grade(df: DataFrame, prediction: str = "prediction", reference: str = "answer", strict: bool = True) -> DataFrame:
    """df with is_correct, extracted_prediction, extracted_reference, comparison_mode and reason.

    Both answers are numbers (themselves, or else their last number): values are compared; else normalized texts are.
    Nothing is shuffled. Null texts are graded as the text None; columns of these names are replaced; repeated rows and
    any caller's key stay.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    mark = "__graded"
    out = df.withColumns({f"{mark}_tag": extract_answer_tag(text(prediction)), f"{mark}_r": reference_answer(text(reference))})
    tag, other = F.col(f"{mark}_tag"), F.col(f"{mark}_r")
    out = out.withColumn(f"{mark}_p", tag if strict else F.coalesce(tag, extract_last_number(F.when(tag.isNull(), text(prediction)))))
    own = F.col(f"{mark}_p")
    mode = F.when(tag.isNotNull(), "tag").otherwise("missing_answer_tag" if strict else F.when(own.isNull(), "missing_prediction_answer").otherwise("fallback_last_number"))
    # The last number is looked for only where the answer itself is no plain one. Each step is a projection of its own, so that
    # no expression is repeated inside another; what is no plain number goes to the vectorized helper in one pass.
    last = lambda c, key: extract_last_number(F.when(F.col(key).isNull(), c))
    out = out.withColumns({f"{mark}_an": normalize_numeric(own), f"{mark}_bn": normalize_numeric(other)})
    out = out.withColumns({f"{mark}_{k}": plain_key(F.col(f"{mark}_{k}n")) for k in "ab"})
    out = out.withColumns({f"{mark}_cn": normalize_numeric(last(own, f"{mark}_a")), f"{mark}_dn": normalize_numeric(last(other, f"{mark}_b"))})
    out = out.withColumns({f"{mark}_{k}": plain_key(F.col(f"{mark}_{k}n")) for k in "cd"})
    out = out.withColumns({f"{mark}_{k}s": other_key(F.when(F.col(f"{mark}_{k}").isNull(), F.col(f"{mark}_{k}n"))) for k in "abcd"})
    a, b = (F.coalesce(*[f"{mark}_{k}" for k in (x, f"{x}s", y, f"{y}s")]) for x, y in ("ac", "bd"))
    none, numeric = own.isNull(), a.isNotNull() & b.isNotNull()
    return out.withColumns(
        {
            "is_correct": F.when(none, F.lit(False)).when(numeric, (a == b) & (a != "nan")).otherwise(canonicalize_text(own) == canonicalize_text(other)),
            "extracted_prediction": own,
            "extracted_reference": other,
            "comparison_mode": F.when(none, mode).when(numeric, F.concat(mode, F.lit("_numeric"))).otherwise(F.concat(mode, F.lit("_text"))),
            "reason": F.when(none, "no_answer").when(numeric, "compared_as_numbers").otherwise("compared_as_texts"),
        }
    ).drop(*[f"{mark}_{k}" for k in ("tag", "r", "p")], *[f"{mark}_{k}{n}" for k in "abcd" for n in ("", "n", "s")])


def _rate(correct: Column, total: Column) -> Column:
    return F.when(total > 0, correct / total).otherwise(0.0)


def accuracy(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """correct, total and accuracy (0.0 for no rows), overall or by columns."""
    sums = graded.groupBy(*(by or [])).agg(F.coalesce(F.sum(F.col("is_correct").cast("bigint")), F.lit(0)).alias("correct"), F.count("*").alias("total"))
    return sums.withColumn("accuracy", _rate(F.col("correct"), F.col("total")))


def grade_breakdown(graded: DataFrame, totals: bool = False) -> DataFrame:
    """Rows by comparison_mode and is_correct; with totals also over all (null) by rollup."""
    keys = ["comparison_mode", "is_correct"]
    return (graded.rollup(*keys) if totals else graded.groupBy(*keys)).agg(F.count("*").alias("n"))
