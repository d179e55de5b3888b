"""Frequent lines at the limits in use."""

import duckdb
from oracle import compare

from factweave.llm import quality_rules, queries

FOOTER = "all of these rights are kept by the owners of this old site"


def own(i):
    return " ".join(f"w{i}x{k}" for k in range(14))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_sql_removes_lines_and_rejects_documents(spark, tmp_path):
    rows = [(i, f"{own(i)}\n{FOOTER}" if i % 2 else own(i), "a") for i in range(300)]
    rows += [(i, f"only six words {i} here now\n{FOOTER.upper()}", "a") for i in range(300, 320)]
    rows += [(i, f"{own(i)}\n{FOOTER}", None) for i in range(320, 410)] + [(i, f"{own(i)}\n{FOOTER}", "tiny") for i in range(410, 420)] + [(420, None, "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES["op5_line_frequency"](spark, str(tmp_path))
    got = df.collect()
    assert compare(df.columns, got, con, queries.ORACLES["op5_line_frequency"])[0] is None
    assert sum(r.n_removed_words > 0 for r in got) == 149 + 20 + 89 and sum(not r.kept for r in got) == 20 + 1


def test_filter_removes_lines_of_small_hosts(spark):
    rows = [(i, f"{own(i)}\n{FOOTER}", "small") for i in range(40)] + [(i, f"{own(i)}\n{FOOTER}", "tiny") for i in range(40, 50)]
    texts = {r.doc_id: r.text for r in quality_rules.quality_filter(frame(spark, rows)).collect()}
    assert [i for i, t in texts.items() if FOOTER in t and i < 40] == [0] and sum(FOOTER in texts[i] for i in range(40, 50)) == 10


def test_filter_takes_its_share_of_distinct_texts(spark):
    rows = [(i, f"{own(i)}\n{FOOTER}", "a") for i in range(150)] + [(i, own(-1), "a") for i in range(150, 10_000)]
    kept = quality_rules.quality_filter(frame(spark, rows))
    assert kept.filter(kept.text.contains(FOOTER)).count() == 1 and kept.count() == 10_000


def test_filter_rejects_what_removal_leaves_below_the_base_minimum(spark):
    rows = [(i, f"{own(i)}\n{FOOTER}", "a") for i in range(40)]
    rows += [(40, "this one has nine words of its own {}\n".format("x") + "short line of all\n" + FOOTER, "a")]
    rows += [(i, f"{own(i)}\nand a line of nine words in all pages", "a") for i in range(41, 60)]
    rows += [(60, "these are the nine words left of this one\nand a line of nine words in all pages", "a")]
    assert {r.doc_id for r in quality_rules.quality_filter(frame(spark, rows)).collect()} == set(range(61)) - {60}
