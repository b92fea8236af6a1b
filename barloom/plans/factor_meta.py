"""Metadata of all factors: those registered here, the fields of a vendor's frame and a catalogue of formulas.

A name belongs to the first of the three that has it. Each entry carries how far the factor store covers it, and one upsert
by name brings all into the stored metadata.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import factor_category, vendor_name
from barloom.operators.merge import upsert
from barloom.plans.factors import Factor

DESCRIPTION = "factor_name string, display_name string, source string, category string, formula string, impl_kind string, python_path string"
STORED = f"{DESCRIPTION}, start_date string, end_date string, month_count bigint"
# Whence a factor comes, the price convention that parameters state, and the mark before a remark in a formula.
OWN, VENDOR, CATALOGUE = "自研", "vendor", "catalogue"
ADJUSTED = ("adj_convention", "hfq")
MARK = "｜"
KEYS_OF_A_FRAME = ("ts_code", "trade_date")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def from_registered(spark: SparkSession, registered: Sequence[Factor], package: str = "barloom") -> DataFrame:
    """Entries of the factors in code, as many as there are classes. The formula states the parameters; the path is given for
    factors of `package`."""
    rows = []
    for factor in registered:
        meta, module = factor.meta(), type(factor).__module__
        params = dict(meta.params)
        params.setdefault(*ADJUSTED)
        path = module.replace(".", "/") + ".py" if module.split(".")[0] == package else None
        rows.append((meta.name, meta.display_name or meta.name, OWN, meta.category, str(params), "python", path))
    return spark.createDataFrame(rows, DESCRIPTION)


def from_vendor(wide: DataFrame, descriptions: Mapping[str, str], source: str = VENDOR) -> DataFrame:
    """Entries of the fields of a vendor's wide frame, under their local names. A description `short-long` gives the name to
    show and, behind the vendor's own name, the formula."""
    rows = []
    for field in wide.columns:
        if field in KEYS_OF_A_FRAME:
            continue
        local, described = vendor_name(field), descriptions.get(field, "").strip()
        short, _, rest = described.partition("-")
        formula = field + MARK + (rest or described or field)
        rows.append((field, local, short.strip() or local, formula))
    named = wide.sparkSession.createDataFrame(rows, "field string, factor_name string, display_name string, formula string")
    return named.select(
        "factor_name",
        "display_name",
        F.lit(source).alias("source"),
        factor_category(F.col("field")).alias("category"),
        "formula",
        F.lit(source).alias("impl_kind"),
        F.lit(None).cast("string").alias("python_path"),
    )


def from_catalogue(formulas: DataFrame, stored: DataFrame, source: str = CATALOGUE, label: str = "Alpha", category: str = CATALOGUE) -> DataFrame:
    """Entries of a catalogue (factor_name, number, formula, skip_reason). A formula in the stored metadata was edited there
    and stays; else it is the catalogue's, with the reason why it is skipped, if there is one."""
    body, reason = _text(F.col("formula")), _text(F.col("skip_reason"))
    seed = F.when(reason == "", body).when(body == "", reason).otherwise(F.concat(body, F.lit(f"{MARK}["), reason, F.lit("]")))
    edited = stored.where(_text(F.col("formula")) != "").groupBy("factor_name").agg(F.max("formula").alias("_edited"))
    return formulas.join(edited, "factor_name", "left").select(
        "factor_name",
        F.concat(F.lit(label), F.col("number").cast("string")).alias("display_name"),
        F.lit(source).alias("source"),
        F.lit(category).alias("category"),
        F.coalesce("_edited", seed).alias("formula"),
        F.lit("formula").alias("impl_kind"),
        F.lit(None).cast("string").alias("python_path"),
    )


def first_named(*entries: DataFrame) -> DataFrame:
    """All entries, each name once: of the first frame that has it."""
    ranked = None
    for rank, frame in enumerate(entries):
        part = frame.select("factor_name", F.struct(F.lit(rank).alias("rank"), *[c for c in frame.columns if c != "factor_name"]).alias("_e"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.where(F.col("factor_name").isNotNull()).groupBy("factor_name").agg(F.min("_e").alias("_e"))
    return best.select("factor_name", "_e.*").drop("rank")


def refreshed(stored: DataFrame, entries: DataFrame, coverage: DataFrame) -> DataFrame:
    """The stored metadata after a refresh. `coverage` (factor_name, start_date, end_date, month_count) is the factor store's;
    an entry without values there has no dates and 0 months. Names that are only stored stay as they are."""
    months = F.coalesce("month_count", F.lit(0)).cast("long")
    fresh = entries.join(coverage, "factor_name", "left").withColumn("month_count", months)
    return upsert(stored, fresh, ["factor_name"])


def by_source(meta: DataFrame) -> DataFrame:
    """Factors of each source and how many of them have values."""
    return meta.groupBy("source").agg(F.count(F.lit(1)).alias("n_factors"), F.count("start_date").alias("n_with_data"))
