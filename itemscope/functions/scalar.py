"""Scalar column expressions; all of them stay inside whole-stage codegen."""

from pyspark.sql import Column, functions as F


def _col(c):
    return c if isinstance(c, Column) else F.col(c)


def clip(c, low, high):
    """NULL stays NULL, unlike a bare least(greatest(..)) pair, which skips NULL."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def safe_logit(p, eps=1e-4):
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x):
    return 1 / (1 + F.exp(-_col(x)))


def rasch_probability(theta, difficulty):
    return sigmoid(_col(theta) - _col(difficulty))


def standardized_residual(y, p):
    p = _col(p)
    return (_col(y) - p) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-4)))


def logistic_loss(y, eta):
    """Negative log-likelihood of `y` at log-odds `eta`, without overflow."""
    eta = _col(eta)
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - _col(y) * eta


def log_loss(y, p, eps=1e-6):
    q = clip(p, eps, 1 - eps)
    return -F.when(_col(y) == 1, F.log(q)).otherwise(F.log(1 - q))


def surprisal(y, p):
    return log_loss(y, p)


def ambiguity(p):
    return 1 - F.abs(2 * _col(p) - 1)


def to_number(c):
    """Text or number to DOUBLE; text that is no number, and NaN, become NULL."""
    d = _col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def label_to_decision(c, long_label, short_label):
    c = _col(c)
    return F.when(c == long_label, 1).when(c == short_label, 0).cast("int")


def first_match(c, rules):
    """Value of the first rule whose text occurs in the lower-cased cell, else NULL."""
    # a NULL cell reads as text without any rule's words
    text = F.lower(F.coalesce(_col(c).cast("string"), F.lit("")))
    out = None
    for needle, value in rules:
        hit = F.contains(text, F.lit(needle))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.cast("double")


# Labels of the ten equal-width bins of [0, 1].
TENTH_LABELS = ["(-0.001, 0.1]", "(0.1, 0.2]", "(0.2, 0.3]", "(0.3, 0.4]", "(0.4, 0.5]",
                "(0.5, 0.6]", "(0.6, 0.7]", "(0.7, 0.8]", "(0.8, 0.9]", "(0.9, 1.0]"]


def tenth_bin(c):
    """1-based number of the right-closed bin of width 0.1; bin i ends at the double i * 0.1."""
    c = _col(c)
    above = sum(((c > F.lit(i * 0.1)).cast("int") for i in range(1, 10)), F.lit(1))
    return F.when((c >= 0) & (c <= 1), above)


def tenth_label(bin_number):
    return F.get(F.array(*[F.lit(t) for t in TENTH_LABELS]), _col(bin_number) - 1)


def rounded(df, digits=6):
    """Round every DOUBLE column; adding zero turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double"
        else F.col(f"`{n}`") for n, t in df.dtypes])
