"""Texts and tables with every awkward case, and plain versions of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Columns named like those the operators make themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row int, slot int, n int, bin string"
LONG = "and the quick brown fox was seen near a river " * 3000


def rows():
    texts = [
        (1, "The cat sat on the mat and the dog ran.", "en", "a"),
        (2, "The cat sat on the mat and the dog ran.", "en", "a"),
        (2, "The cat sat on the mat and the dog ran.", "en", "a"),
        (3, "", "en", "b"),
        (4, None, None, None),
        (None, "no id here at all", "en", None),
        (5, " \t\n ", "de", "b"),
        (6, "one", "de", "b"),
        (7, "wörter über alle maßen     日本語のテキスト 🎉🎉 ok", "de", "c"),
        (8, LONG, "en", "c"),
        (9, "x" * 50_000, "fr", "c"),
        (10, "The cat sat on the mat and the dog ran", "en", "é"),
        (11, "It's <|endoftext|> 12345   'll   tail  ", "en", "c"),
        (11, "another text of the same id", "en", "c"),
    ]
    return [(i, t, lang, s, None, 7, "k", 1, 2, 3, "b") for i, t, lang, s in texts]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def documents(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
