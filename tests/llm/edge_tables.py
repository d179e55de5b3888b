"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, kept string, row int, words string, score string, label string, leaf int, n_words string, hash string"
EXTRA = (7, "x", "no", 3, "w", "s", "l", 9, "many", "h")


def edge_rows():
    long = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n \r\x0b\x0c ", "en", "a"), (4, long, "en", None), (4, long, "en", None),
        (None, "the text of a row without any id is still a text of words", "en", "b"), (5, "one", None, "b"), (6, "one", "fr", "b"), (7, "A b C d", "de", "c"),
        (8, f"first {passage} after it", "en", "a"), (9, f"second\n{passage}", "en", None), (10, passage, "en", "b"), (11, "12345 !!! ---", "en", "b"),
        (12, "é" * 5000, "fr", "c"), (13, "a <|endoftext|> b <|startoftext|> <|im_end|>", "en", "c"), (14, "\x1c\x1d x y", "en", "c"),
        (15, "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "en", "c"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), *EXTRA) for i, t, lang, source in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))
