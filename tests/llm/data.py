"""Small inputs with every awkward case, and the small tables."""

import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "n_words long, kept string, score string, key string, node string, sig string, shard int, uid string, h string, d2 int"
)

LONG = " ".join(f"long{i % 977} tail{i}" for i in range(30_000))
PROSE = " ".join(f"alpha{i} beta{i * 7 % 53} gamma{i * 11 % 71}" for i in range(60))
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),  # equal text
    (2, PROSE, "en", "a"),  # repeated row
    (3, PROSE.replace("alpha30 ", "changed "), "en", None),  # near copy
    (4, None, "en", "a"),
    (5, "", None, None),
    (6, " \t\n\x0b\x0c\r ", "de", "b"),
    (7, LONG, "en", "a"),
    (None, "no id here at all", "fr", "b"),
    (None, None, None, None),
    (8, "Short TEXT, two lines\nShort TEXT, two lines\n\n", "de", "b"),
    (9, "Ünïcode wörds naïve café 東京   😀 Ünïcode wörds naïve", "fr", "c"),
    (10, "<|endoftext|> special <|startoftext|> strings", "en", "c"),
    (-11, "x" * 5_000, "en", "c"),
    (12, "one", "en", "c"),
]


def edge_docs(spark):
    rows = [(i, t, l, s, len(t or ""), 99, "k", "s", "y", "n", "g", -1, "u", "h", 5) for i, t, l, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_words(text):
    return words((text or "").translate(UPPER))
