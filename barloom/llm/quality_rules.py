"""A rule ledger: every rule is evaluated once per document into one bit, next to the measurements it was taken from.
Policies are masks over those bits, so applying another version, or asking what a rule contributes, reads the ledger and
no text.

Everything is DataFrame functions over one row, no shuffle: the work of a document depends on its own length only, as
n log n at most.

Defined cases: a null or empty text has no words and all measurements 0, and fails `few_words`; repeated rows are judged row
by row; further columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WORD, word_array

# Window length in words, and the symbols.
WINDOW = 5
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")

# In the order of their bits; a rule is never moved, new ones are added at the end.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "n_dup_lines >= 2 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
    "capitals": "100 * n_capitals > 50 * word_chars",
}
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "capitals"),
    "v1_lenient": ("few_words", "repeated_words", "symbols"),
}


def mask(policy: str) -> int:
    bit = {r: 1 << i for i, r in enumerate(RULES)}
    return sum(bit[r] for r in POLICIES[policy])


def _removed(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of the whole text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    one = base.select(
        "doc_id",
        word_array(F.col("_text")).alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        _removed(F.col("_text"), SYMBOLS).alias("n_symbols"),
        _removed(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
    )
    two = one.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_ids"),
    )
    # The windows as 64-bit hashes of their words.
    at = lambda i, k: F.get(F.col("_ids"), i + k)
    window = lambda x, i: F.xxhash64(x, *[at(i, k) for k in range(1, WINDOW)])
    head = F.slice("_ids", F.lit(1), F.greatest(F.size("_ids") - WINDOW + 1, F.lit(0)))
    three = two.withColumn("_windows", F.transform(head, window)).drop("_ids")
    # Only texts with an equal pair of windows are sorted to find where those stand.
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    four = three.withColumn("_sorted", F.when(repeated, placed).otherwise(none)).drop("_windows")
    same = lambda x, j: F.coalesce(F.get("_sorted", j).getField("h") == x.getField("h"), F.lit(False))
    twice = F.filter("_sorted", lambda x, i: same(x, i + 1) | same(x, i - 1))
    five = four.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x.getField("i")))).drop("_sorted")
    covers = F.transform("_starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(x - F.get("_starts", i - 1), F.lit(WINDOW))))
    covered = F.aggregate(covers, F.lit(0).cast("long"), lambda s, x: s + x)
    return five.select("doc_id", *[covered.alias(m) if m == "n_repeat_words" else m for m in MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed`: the bits of all rules, evaluated once."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    failed = reduce(lambda a, b: a.bitwiseOR(b), bits)
    # Always true, but not for the optimizer, which would else push a filter on the bits below the measurements, where
    # each of them is written out, and evaluated, once for every time that it is used.
    once = F.spark_partition_id() >= 0
    return measured(docs).withColumn("failed", F.when(once, failed))


def passes(policy: str) -> Column:
    """Whether a row of the ledger meets a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule of it: documents that the policy keeps, that it would keep without the rule, and that fail the
    rule at all. Rows are first summed by their bits, of which there are 2 ** rules at most."""
    sums = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    bit = {r: 1 << i for i, r in enumerate(RULES)}
    cases = [(p, r, mask(p), bit[r]) for p in policies for r in POLICIES[p]]
    case = F.explode(
        F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("m"), F.lit(b).alias("b")) for p, r, m, b in cases])
    )
    each = sums.select("failed", "n", case.alias("c")).select("failed", "n", "c.*")
    kept = lambda m: F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(m.cast("long")) == 0, F.col("n"))), F.lit(0))
    m, b = F.col("m"), F.col("b")
    fails = F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(b.cast("long")) != 0, F.col("n"))), F.lit(0))
    return each.groupBy("policy", "rule").agg(
        kept(m).alias("n_kept"), kept(m.bitwiseXOR(b)).alias("n_kept_without"), fails.alias("n_failing")
    )


def judged(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed (policy `base`) and kept: neither the base nor `policy` fails."""
    return ledger(docs).withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy)})


def keep_passing(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """`docs` without the rows that a policy fails, all columns kept. Judged in place: no join, so repeated and null ids
    do no harm."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = ledger(docs.select(whole.alias("doc_id"), "text"))
    return rows.where(passes("base") & passes(policy)).select("doc_id.*")


def oracle(policy: str = "v1") -> str:
    """DuckDB SQL for `judged`."""
    word = r"[^\x20\x09-\x0D]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    failed = " | ".join(f"(case when {rule} then {1 << i} else 0 end)" for i, rule in enumerate(RULES.values()))
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '{word}') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) as lines from d),
each as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
win as (select doc_id, i, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o
          || ' ' || lead(word, 4) over o as g from each window o as (partition by doc_id order by i)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from win where g is not null) where c > 1),
cov as (select doc_id, least({WINDOW}, coalesce(i - lag(i) over (partition by doc_id order by i), {WINDOW})) as c from rep),
r as (select doc_id, cast(sum(c) as bigint) as n from cov group by doc_id),
m as (select w.doc_id, cast(len(words) as bigint) as n_words,
        cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
        cast(length(text) - length(translate(text, '{SYMBOLS}', '')) as bigint) as n_symbols,
        cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        coalesce(r.n, 0) as n_repeat_words, cast(length(text) - length(translate(text, '{upper}', '')) as bigint) as n_capitals
      from w left join r using (doc_id)),
f as (select *, cast({failed} as bigint) as failed from m)
select *, (failed & {mask("base")}) != 0 as base_failed, (failed & {mask("base") | mask(policy)}) = 0 as kept from f"""
