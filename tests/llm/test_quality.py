"""Operator 1 alone: measures and verdicts against plain Python, the order's rule, and its defined results."""

import re

from tessella.llm import quality

ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one two"), (5, "a b c " * 40), (5, "a b c " * 40), (6, " ".join(f"word{i}" for i in range(80))),
    (7, "Line of words\n" * 30 + " ".join(f"other{i}x" for i in range(90))), (8, "# $ % & | < > * " * 20), (9, "é" * 70_000 + " " + "tail " * 3), (10, " ".join("UPPERCASE" for _ in range(60))),
    (11, " ".join(f"ab{chr(97 + i % 26)}{chr(97 + i // 26)}cd" for i in range(120)) + "!" * 50), (None, " ".join(f"free{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))), (12, "x y z " * 60),
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    places = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places), n < 50 or 100 * len(places) > 50 * n


def table(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, n_words string, _text int").drop("_text")


def test_measures_against_plain_python(spark):
    got = quality.judge(table(spark)).select("_row.doc_id", "_row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(ODD)
    for r in got:
        assert tuple(r)[2:8] == plain(r.text), r.doc_id
        assert not (r.base_failed and r.kept)


def test_keep_returns_the_rows_as_they_were(spark):
    df = table(spark)
    kept = [(r.doc_id, r.text) for r in quality.judge(df).select("_row.doc_id", "_row.text", "kept").collect() if r.kept]
    out = quality.keep(df)
    assert out.columns == df.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(kept, key=str)
    assert {i for i, _ in kept} == {None}  # the words of 6 and 9 to 11 are digits, letters without end, capitals or marks for too large a part


def test_empty_table(spark):
    assert quality.judge(table(spark, [])).count() == 0 and quality.keep(table(spark, [])).count() == 0


def test_order_changes_no_verdict(spark):
    measured = quality.measures(table(spark))
    names = list(quality.rules())
    assert sorted(quality.cascade_order(measured)) == sorted(names)
    both = measured.select(quality.verdict(names).alias("a"), quality.verdict(names[::-1]).alias("b"))
    assert both.where("a <> b").count() == 0
