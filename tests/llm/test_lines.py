from plain import dedup, documents
from pyspark.sql import functions as F

from kilnwork.llm import lines


def kept(df):
    return {r.doc_id: r.text for r in df.collect()}


def sample():
    common = "This line is in all of them"
    out = [(i, f"own line number {i}\n {common.upper()} \t\nshort\n\n{common}\n" + f"group {i // 5} has this line\n" * (i % 3)) for i in range(60)]
    return out + [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(f"line {i % 700} of a long text" for i in range(3000))), (104, "\n".join(f"line {i} of a long text" for i in range(1000)))]


def test_matches_plain(spark):
    rows = sample()
    got = lines.dedup_lines(documents(spark, rows))
    assert kept(got) == dedup(rows)
    n = {r.doc_id: (r.n_lines, r.n_dropped) for r in got.collect()}
    assert n[100] == n[101] == (1, 0)
    assert n[104] == (1000, 700) and n[103] == (3000, 0)


def test_salts_change_nothing(spark):
    rows = sample()
    assert kept(lines.dedup_lines(documents(spark, rows), salts=1)) == kept(lines.dedup_lines(documents(spark, rows), salts=7))


def test_bitmaps_name_the_dropped_lines(spark):
    docs = documents(spark, [(1, "\n".join(["a line to keep"] * 70)), (2, "\n".join(["x" * 12] * 65 + ["a line to keep"] * 5))])
    row = lines.keep_bitmaps(docs).collect()
    assert [(r.doc_id, [tuple(w) for w in r.dropped]) for r in row] == [(2, [(1, 0b111110)])]


def test_ids_repeated_null_and_clashing_names(spark):
    rows = [(1, "the very same line"), (1, "the very same line"), (None, "the very same line"), (2, "the very same line\nanother one here")]
    docs = documents(spark, rows).withColumns({"n_lines": F.lit("x"), "dropped": F.lit(1), "text_hash": F.lit(2)})
    got = lines.dedup_lines(docs)
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [
        ("1", "the very same line"), ("1", "the very same line"), ("2", "another one here"), ("None", "the very same line"),
    ]
    assert {"dropped", "text_hash"} < set(got.columns) and got.columns.count("n_lines") == 1


def test_empty_table_and_no_python(spark):
    docs = documents(spark, sample())
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    plan = lines.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
