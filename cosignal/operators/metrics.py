"""Evaluation of a regression in log space: error, R^2, thresholded classification.

Everything is one aggregation pass over the scored rows and returns small DataFrames;
nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class names of the thresholded report.
CLASS_NAMES = ("LOW RISK", "SIGNIFICANT RISK")


def _r2(sse_mean: Column, var: Column) -> Column:
    # 1 - SSE/SST with SST = n * var_pop; a constant target scores 1 if fit exactly, else 0.
    return (F.when(var > 0, F.lit(1.0) - sse_mean / var)
            .when(sse_mean == 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def _summary(df: DataFrame, label: str, prediction: str, threshold: float,
             log_space: bool = True) -> DataFrame:
    """One aggregation pass: squared errors, target variances and the confusion counts."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    yo, po = (F.expm1(y), F.expm1(p)) if log_space else (y, p)
    t, h = yo > F.lit(float(threshold)), po > F.lit(float(threshold))
    return df.agg(F.avg((y - p) * (y - p)).alias("log_mse"), F.var_pop(y).alias("_vl"),
                  F.avg((yo - po) * (yo - po)).alias("orig_mse"), F.var_pop(yo).alias("_vo"),
                  F.count(F.lit(1)).alias("n"),
                  F.count_if(t & h).alias("tp"), F.count_if(~t & h).alias("fp"),
                  F.count_if(t & ~h).alias("fn"), F.count_if(~t & ~h).alias("tn"))


def _reg_cols():
    return [F.col("n"), F.col("log_mse"), _r2(F.col("log_mse"), F.col("_vl")).alias("log_r2"),
            F.col("orig_mse"), _r2(F.col("orig_mse"), F.col("_vo")).alias("orig_r2")]


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: n, log_mse, log_r2 (log space) and orig_mse, orig_r2 after expm1."""
    return _summary(df, label, prediction, 0.0).select(*_reg_cols())


def confusion(df: DataFrame, label: str, prediction: str, threshold: float,
              log_space: bool = True) -> DataFrame:
    """One row: tp, fp, fn, tn for ``value > threshold`` on the original scale."""
    return _summary(df, label, prediction, threshold, log_space).select("tp", "fp", "fn", "tn")


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _cls_cols():
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return [_ratio(tp + tn, tp + fp + fn + tn).alias("acc"), _ratio(tp, tp + fp).alias("prec"),
            _ratio(tp, tp + fn).alias("rec"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def binary_metrics(df: DataFrame, label: str, prediction: str, threshold: float = 5.0,
                   log_space: bool = True) -> DataFrame:
    """One row: acc, prec, rec, f1 (zero division gives 0)."""
    return _summary(df, label, prediction, threshold, log_space).select(*_cls_cols())


def class_report(df: DataFrame, label: str, prediction: str, threshold: float = 5.0,
                 log_space: bool = True, names=CLASS_NAMES) -> DataFrame:
    """Per-class precision, recall, f1 and support, plus macro and weighted averages.

    Rows: one per class, 'accuracy' (f1 = accuracy, support = n), 'macro avg',
    'weighted avg'. Built from the one-row confusion counts, no second pass.
    """
    c = confusion(df, label, prediction, threshold, log_space)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def cls(t_p, f_p, f_n):
        p_ = _ratio(t_p, t_p + f_p)
        r_ = _ratio(t_p, t_p + f_n)
        f_ = _ratio(2 * t_p, 2 * t_p + f_p + f_n)
        return p_, r_, f_, (t_p + f_n)

    p0, r0, f0, s0 = cls(tn, fn, fp)   # negative class: "positives" are true negatives
    p1, r1, f1, s1 = cls(tp, fp, fn)
    acc = _ratio(tp + tn, n)
    w0, w1 = _ratio(s0, n), _ratio(s1, n)

    def row(name, p_, r_, f_, s_):
        return F.struct(F.lit(name).alias("class"), p_.alias("precision"), r_.alias("recall"),
                        f_.alias("f1"), s_.cast("bigint").alias("support"))

    rows = F.array(
        row(names[0], p0, r0, f0, s0),
        row(names[1], p1, r1, f1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", p0 * w0 + p1 * w1, r0 * w0 + r1 * w1, f0 * w0 + f1 * w1, n),
    )
    return c.select(F.inline(rows))


def evaluation_report(df: DataFrame, label: str, prediction: str, threshold: float = 5.0,
                      model: str = "model") -> DataFrame:
    """One metrics row: model, log_r2, orig_r2, acc, prec, rec, f1, log_mse, orig_mse, n."""
    s = _summary(df, label, prediction, threshold)
    reg, cls = _reg_cols(), _cls_cols()
    return (s.select(F.lit(model).alias("model"), *reg, *cls)
            .select("model", "log_r2", "orig_r2", "acc", "prec", "rec", "f1",
                    "log_mse", "orig_mse", "n"))
