"""Small inputs shared by the tests of the corpus operators."""

import random

SF = "/root/testdata/sf0.001"
#: Every operator must give a defined result for these.
ODD_TEXTS = [None, "", " \n\t ", "a", "é", "a b c", "word " * 20_000, "x" * 50_000, "<|endoftext|>", "ab\x01cd  ef\n\n g "]


def random_text(rng: random.Random, n_words: int, vocabulary: int = 400) -> str:
    words = []
    for i in range(n_words):
        w = f"{'bcdfghjklm'[rng.randrange(10)]}{'aeiou'[rng.randrange(5)]}{rng.randrange(vocabulary)}"
        words.append(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w)
    return " ".join(words)


def odd_documents(spark, columns="doc_id long, text string, extra string"):
    """Null key, null and empty texts, long texts, repeated rows."""
    rows = [(i, t, "x") for i, t in enumerate(ODD_TEXTS)] + [(3, "a", "x"), (3, "a", "x")]
    return spark.createDataFrame(rows, columns)


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")
