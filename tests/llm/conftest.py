import pytest

#: The documents of every edge case: nulls in any column, empty, white, very long, ties, repeated rows, and
#: columns whose names clash with those of results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, ids string, _id string, component string"


def document(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, -1, None, 0.5, "x", "y", None)


LONG = " ".join(f"wörd{i % 977}x{i}" for i in range(30000))


@pytest.fixture(scope="session")
def edge_docs():
    words = "the quick brown fox jumps over the lazy dog and runs far away from all of them today".split()
    near = lambda k: " ".join(words[:k] + [f"w{k}"] + words[k + 1 :])
    return [
        document(1, None), document(2, ""), document(3, " \t\n\r\x0b\x0c "), document(4, "One"), document(5, "one"), document(6, "A  b\tc"), document(7, "Ab c"), document(8, "abc"),
        document(9, " ".join(words)), document(10, " ".join(words)), document(10, " ".join(words)), document(11, near(3)), document(12, near(9)), document(13, near(16)),
        document(14, LONG), document(15, LONG + " end"), document(16, "x" * 40000), document(17, "日本語テキスト" * 3000), document(18, "a<|endoftext|>b <|endoftext|>"),
        document(19, "don't  we'll it's 12345 ###   \x1c end\n\n"), document(20, "é" * 50 + " \U0001f600 z", None, None), document(21, "repeat repeat repeat repeat", "fr", "b"),
        document(22, "12 34 !!", "de", "b"), document(23, "tie me", "en", "c"), document(24, "ti eme", "en", "c"), document(25, None, None, None),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_docs):
    return spark.createDataFrame(edge_docs, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
