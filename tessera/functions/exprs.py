"""Column expressions with the semantics of annual panels: null-safe sums, bands, codes, dates."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "__MISSING__"
# Accepted date spellings, and texts that mean no date.
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "yyyyMMdd", "dd/MM/yyyy")
NO_DATE = ("", "0", "00000000", "nan", "None")


def sum0(c) -> Column:
    """Sum that is 0 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def any_true(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def count_values(c: Column) -> Column:
    """Distinct values with null as a value."""
    return F.countDistinct(c) + F.max(c.isNull().cast("int"))


def nearest_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """By group, the values nearest to rank q * (n - 1) of the sorted values that aren't null, for each named q.
    Values are counted first, so windows run over distinct values."""
    by = [F.col(k) for k in keys] or [F.lit(0)]
    w = Window.partitionBy(*by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = counted.withColumns({"_upto": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    at = lambda q: F.round(F.lit(q) * (F.col("_all") - 1))
    return ranked.groupBy(*keys).agg(*(F.max(F.when((F.col("_upto") > at(q)) & (F.col("_upto") - F.col("_n") <= at(q)), F.col(value))).alias(name) for name, q in probabilities.items()))


def age_band(age: Column) -> Column:
    """'<20', then five-year bands to '85-89', then '90+'; null without an age."""
    low = (F.floor(age / 5) * 5).cast("int")
    return F.when(age < 20, F.lit("<20")).when(age >= 90, F.lit("90+")).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string")))


def major_group(code: Column) -> Column:
    """First of at least three digits of an occupation code; null without a code."""
    text = code.cast("string")
    return F.substring(F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0")), 1, 1)


def code_in(code: Column, codes: list[int]) -> Column:
    """Membership of a code that may be text like '20.0'; null is no member."""
    return F.coalesce(code.cast("string").try_cast("double").try_cast("bigint").isin(codes), F.lit(False))


def normal_date(text: Column) -> Column:
    """Date of a text in one of the known formats; sentinels and all else are null."""
    clean = F.regexp_replace(F.trim(text), "\\.0$", "")
    clean = F.when(~clean.isin(*NO_DATE), clean)
    return F.coalesce(*(F.try_to_date(F.when(clean.rlike(p), clean), f) for f, p in zip(DATE_FORMATS, ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$", "^[0-9]{8}$", "^[0-9]{2}/[0-9]{2}/[0-9]{4}$"))))


def smd(mt: Column, vt: Column, mc: Column, vc: Column) -> Column:
    """Standardised mean difference; without variance 0 for equal means, else null."""
    spread = F.sqrt((vt + vc) / 2)
    return F.when(spread > 0, (mt - mc) / spread).when(mt == mc, F.lit(0.0))


def income_status(entgelt: Column, rtzb: Column) -> Column:
    return F.when(entgelt.isNotNull() & rtzb.isNotNull(), "both").when(entgelt.isNotNull(), "earnings_only").when(rtzb.isNotNull(), "pension_only").otherwise("neither")
