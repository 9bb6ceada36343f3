"""Interaction of quality filters, by a Walsh-Hadamard audit.

A document fails a subset of the five filters, its mask. Every part and label class keeps
32 sums, one for each set of filters, of the parity signs of its documents' masks: +1 where
a document fails an even number of the set's filters, -1 where it fails an odd number. The
transform is its own inverse up to the factor 32, so the sums give back exactly how many
documents have each mask, and with that every order of the filters is evaluated without
another look at the texts. A document that fails c filters is removed by each of them in
120 / c of the 120 orders, which gives the Shapley sums in closed form.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, stage

#: Filters by letter; bit i of a mask is set where a document fails filter i.
FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Words at least, distinct words at least and capitals at most in per cent, signs of filter D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def failures(text: Column) -> Column:
    """Bits 0 to 3: which of A to D a whole text fails; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def mask(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
        fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.char_length(text), text.rlike(SIGNS))
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))

    return bound(F.array_remove(F.split(text, WORD_GAP), ""), mask)


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, mask, n): documents of a kind, with how many there are.

    The labels are every, and good or toxic for documents that are so.

    A text is repeated (filter E) where a smaller doc_id has the same one. Texts travel as
    SHA-256 sums. Documents are counted by sum and doc_id, which no group of copies makes
    hot; the least doc_id of a sum is aggregated before its shuffle and joined by both.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sum"), failures(F.col("text")).alias("mask"))
    kinds = stage(own.groupBy("sum", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "kinds")
    first = kinds.groupBy("sum").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = kinds.join(first, ["sum", "doc_id"], "left").join(marks, "doc_id", "left")
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(repeated, 1 << 4).otherwise(0)
    labels = F.array_compact(F.array(F.lit("every"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")))
    return rows.select("part", F.explode(labels).alias("label"), mask.alias("mask"), "n")


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, label, sums): the 32 signed parity sums of a part and label, added up before the shuffle."""
    sums = rows.groupBy("part", "label").agg(*(F.expr(f"sum(n * (1 - 2 * (bit_count(mask & {s}) % 2))) as s{s}") for s in range(SETS)))
    return sums.select("part", "label", F.array(*(f"s{s}" for s in range(SETS))).alias("sums"))


def mask_counts(sums: str) -> Column:
    """Documents of every mask, from the parity sums: the transform again, over 32, which divides exactly."""
    total = f"aggregate(sequence(0, {SETS - 1}), 0L, (t, s) -> t + {sums}[s] * (1 - 2 * (bit_count(m & s) % 2)))"
    return F.expr(f"transform(sequence(0, {SETS - 1}), m -> {total} div {SETS})")


def _total(cells: str, which: str, value: str = "1") -> str:
    """SQL for the sum over masks m that meet a condition, times a value."""
    return f"aggregate(filter(sequence(0, {SETS - 1}), m -> {which}), 0L, (t, m) -> t + {cells}[m] * ({value}))"


def _orders() -> Column:
    """All orders of the filters and their steps, as an array of structs that is the same for any table."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(f"struct('{''.join(FILTERS[i] for i in order)}' as filter_order, {step} as step, {f} as filter, {before} as before, {before | 1 << f} as after)")
            before |= 1 << f
    return F.expr(f"array({', '.join(steps)})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does in every order: a row per part, order and step.

    Takes doc_id, text and source of documents, and doc_id, quality and toxic of labels;
    other columns are ignored. Filters are applied from left to right, and each is evaluated
    on whole texts. Returns part, filter_order, step and, as documents of the part, kept (after
    this step), removed (here), redundant (fail this filter but are gone already),
    unique_fails (fail only this filter), good_lost and toxic_lost (removed here with
    quality or toxic 1), shapley (removed by this filter, summed over all orders).

    A null text is empty, a null source the part ''; an empty text fails A alone. Rows that
    repeat a doc_id and its text are counted each and pass E together where no smaller id has
    the text; a null doc_id has no label, passes E and is no smaller id. A doc_id labelled
    more than once is good or toxic if one label says so. An empty table gives no rows; counts
    of zero are given. Nothing is ordered by, so there are no ties.
    """
    sums = parity_sums(document_masks(docs, labels))
    cells = sums.select("part", F.struct("label", mask_counts("sums").alias("cells")).alias("cells"))
    # One row per part, of three labels; written, so that what 600 rows repeat is computed once.
    parts = cells.groupBy("part").agg(F.map_from_entries(F.collect_list("cells")).alias("cells"))
    of = lambda label: f"coalesce(cells['{label}'], array_repeat(0L, {SETS}))"
    survivors = lambda label: F.expr(f"transform(sequence(0, {SETS - 1}), s -> {_total(label, 'm & s = 0')})").alias(label)
    by_filter = lambda value: F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), f -> {value})")
    fails, orders = "shiftright(m, f) & 1 = 1", factorial(len(FILTERS))
    parts = parts.select("part", *(F.expr(of(label)).alias(label) for label in ("every", "good", "toxic")))
    parts = parts.select(
        "part",
        *(survivors(label) for label in ("every", "good", "toxic")),
        by_filter(_total("every", fails)).alias("fails"),
        by_filter("every[shiftleft(1, f)]").alias("alone"),
        by_filter(_total("every", fails, f"{orders} div bit_count(m)")).alias("shares"),
    )
    rows = stage(parts, "parts").select("*", F.inline(_orders()))
    lost = lambda name: F.col(name)[F.col("before")] - F.col(name)[F.col("after")]
    own = lambda name: F.col(name)[F.col("filter")]
    columns = {
        "kept": F.col("every")[F.col("after")], "removed": lost("every"), "redundant": own("fails") - lost("every"), "unique_fails": own("alone"),
        "good_lost": lost("good"), "toxic_lost": lost("toxic"), "shapley": own("shares"),
    }
    return rows.select("part", "filter_order", "step", *(c.cast("long").alias(name) for name, c in columns.items()))


def audit_sql() -> str:
    """The same rows in DuckDB SQL, by counting documents for every order and step."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    steps = [(order, step) for order in ("".join(p) for p in permutations(FILTERS)) for step in range(1, len(FILTERS) + 1)]
    values = ", ".join(f"('{order}', {step})" for order, step in steps)
    flags = f"""
        len(w) < {LEAST_WORDS} as fa, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) as fb,
        100 * (length(t) - length(translate(t, '{upper}', ''))) > {MOST_CAPITALS} * length(t) as fc, regexp_matches(t, '{SIGNS}') as fd"""
    return rf"""
    with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
    w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from t),
    least as (select t, min(doc_id) as least from t group by t),
    marks as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
    d as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {flags}, coalesce(w.doc_id > least, false) as fe
      from w join least using (t) left join marks on marks.doc_id = w.doc_id),
    m as (select part, good, toxic, concat(if(fa, 'A', ''), if(fb, 'B', ''), if(fc, 'C', ''), if(fd, 'D', ''), if(fe, 'E', '')) as failed, count(*) as n from d group by all),
    s(filter_order, step) as (values {values}),
    o as (select filter_order, step, filter_order[step] as f, filter_order[:step - 1] as before from s),
    x as (select part, filter_order, step, n, good, toxic, failed, contains(failed, f) as fails, len(failed) as c,
        regexp_matches(failed, '[' || before || '_]') as gone from m, o)
    select part, filter_order, step,
      coalesce(sum(n) filter (where not gone and not fails), 0)::bigint as kept,
      coalesce(sum(n) filter (where not gone and fails), 0)::bigint as removed,
      coalesce(sum(n) filter (where gone and fails), 0)::bigint as redundant,
      coalesce(sum(n) filter (where fails and c = 1), 0)::bigint as unique_fails,
      coalesce(sum(n) filter (where not gone and fails and good), 0)::bigint as good_lost,
      coalesce(sum(n) filter (where not gone and fails and toxic), 0)::bigint as toxic_lost,
      coalesce(sum(n * 120 // greatest(c, 1)) filter (where fails), 0)::bigint as shapley
    from x group by part, filter_order, step
    """
