"""Quality rules as a short-circuit cascade (operator 1), in DataFrame functions only.

Each rule is a condition that rejects a document. On a bounded sample (SAMPLE_ROWS rows) every rule is run alone; its
cost is the time it adds to a run that reads the same rows without it, its selectivity the share it rejects. The rules
then stand in one CASE in order of rejections per cost, so that a document pays for rules only up to the first that
rejects it. The order never changes a verdict: a document is kept when no rule rejects it.

Words are runs of characters other than space and \\t \\n \\v \\f \\r. Everything about a document is computed inside its
own row, with no shuffle; repeated 3-word windows are found by sorting the windows' 64-bit hashes with their places.

Defined results: a null or empty text has zero counts and fails the base rules; equal rows get equal results; an empty
table gives no rows; other columns of the input don't matter to the measures.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Stage

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
GAP = "[\\x20\\x09-\\x0D]+"


def size(c: Column | str) -> Column:
    return F.size(c).cast("long")


def count_of(text: Column, kept: str) -> Column:
    """Characters of a text that the class `kept` has."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")




def rules() -> dict[str, Column]:
    """name -> condition that rejects, over the columns of measures() and the text (column `_text`)."""
    text, words = F.col("_text"), F.col("n_words")
    chars = F.col("word_chars")
    return {
        "word_length": (chars < 2 * words) | (chars > 15 * words),
        "symbols": 10 * F.col("n_symbols") > words,
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "capitals": 100 * count_of(text, "\\p{Lu}") > 40 * chars,
        "digits": 100 * count_of(text, "0-9") > 25 * chars,
        "letters": 100 * count_of(text, "\\p{L}\\p{M}") < 70 * chars,
        "exclamations": 10 * count_of(text, "!") > 3 * words,
    }


def measures(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """df's columns as struct `_row`, the text as `_text`, and the counts. Arrays stay inside the row's projections."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), text.alias("_text")) if df.columns else df
    rows = rows.select("*", F.array_remove(F.split("_text", GAP), "").alias("_words"), F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"))
    rows = rows.select(
        "_row", "_text", size("_words").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count_of(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
        size("_lines").alias("n_lines"), (size("_lines") - size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(F.size("_words") > 2, F.transform(F.slice(F.col("_words"), 1, F.size("_words") - 2), lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<long>")).alias("_windows"),
    )
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(repeated, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, k: F.get("_sorted", k)["h"] == e["h"]
    places = F.filter("_sorted", lambda e, k: ((k > 0) & same(e, k - 1)) | ((k + 1 < F.size("_sorted")) & same(e, k + 1)))
    rows = rows.withColumn("_places", F.sort_array(F.transform(places, lambda e: e["i"])))
    # consecutive windows overlap: a window adds the words by which it is ahead of the one before, 3 at most
    covered = F.aggregate("_places", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")))["n"]
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_places") > 0, covered), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.drop("_windows", "_sorted", "_places").withColumn("base_failed", failed)


def cascade_order(measured: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, best rejections per cost first."""
    stage = Stage(measured.drop("_row").limit(sample_rows))
    sample, estimates = stage.df, {}

    def run(rejects: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(rejects.cast("double")), F.max(F.length("_text"))).first()[0]
        return time.perf_counter() - began, share or 0.0

    run(F.lit(False))
    idle = min(run(F.lit(False))[0] for _ in range(2))
    for name, rejects in rules().items():
        seconds, share = run(rejects)
        estimates[name] = share / max(seconds - idle, 1e-3)
    stage.drop()
    return sorted(estimates, key=lambda name: (-estimates[name], name))


def verdict(order: list[str]) -> Column:
    """Column `kept`: the rules in the given order, each evaluated only where none before rejects."""
    known, case = rules(), F.when(F.col("base_failed"), False)
    for name in order:
        case = case.when(known[name], False)
    return case.otherwise(True)


def judge(df: DataFrame, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: `_row` (the input's columns), the measures, base_failed and kept."""
    measured = measures(df, text_col=text_col)
    return measured.withColumn("kept", verdict(cascade_order(measured, sample_rows=sample_rows)))


def keep(df: DataFrame, **options) -> DataFrame:
    """The input rows that are kept, with the input's columns.

    The verdicts are written first: a filter on them would be pushed below the measures' projections, and every measure
    be computed again for each place that names it.
    """
    return Stage(judge(df, **options).select("_row", "kept")).df.where("kept").select("_row.*")


def op1_quality_cascade(spark, sf_dir: str) -> DataFrame:
    rows = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def measures_sql(table: str) -> str:
    """DuckDB SQL for the measures and the verdict over a table with doc_id and text (unique doc_ids)."""
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from {table}),
win as (select doc_id, unnest(range(0, greatest(len(w) - 2, 0))) as i, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) as x from d),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as c from win) where c > 1),
cov as (select doc_id, count(*) as n from (select distinct doc_id, i + unnest([0, 1, 2]) as p from rep) group by doc_id),
m as (select doc_id, t, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(l)::bigint as n_lines,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
    from d left join cov using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > n_words or 100 * n_dup_lines > 30 * n_lines
    or 100 * length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) > 40 * word_chars or 100 * length(regexp_replace(t, '[^0-9]+', '', 'g')) > 25 * word_chars
    or 100 * length(regexp_replace(t, '[^\p{{L}}\p{{M}}]+', '', 'g')) < 70 * word_chars or 10 * length(regexp_replace(t, '[^!]+', '', 'g')) > 3 * n_words) as kept
from b"""


OP1_SQL = measures_sql("documents")
