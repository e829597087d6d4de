import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def word():
    """A made-up vocabulary and a maker of texts from it."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abdeklmnoprstué") for _ in range(rng.randint(1, 8))) for _ in range(400)]

    def text(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def corpus(word):
    """Copies, near copies, shared passages and lines, nulls, empty and odd texts, ties; ids out of order."""
    passage = word(1000, 70)
    rows = []
    for i in range(12):
        rows.append(word(i, 120))
    rows += [rows[0], rows[0], rows[1].upper(), rows[2] + " tail", "head " + rows[2], rows[3].replace(" ", "  \t")]
    for i in range(6):
        rows.append(word(20 + i, 15) + " " + passage + " " + word(40 + i, 15))
    rows += [passage, passage + " " + passage, "\n".join([word(60, 4), "A Line that Many have", word(61, 4)]), "a line that many have  \nsame\nsame\n\n" + word(62, 3), "\t a LINE that many have"]
    rows += [None, "", " ", "\n\n", "one", "one two three", "é", "日本語 テキスト", "a\x00b", "ab " * 300]
    base = word(70, 100).split()
    for i in range(40):  # a group of near copies
        r = random.Random(i)
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(30)
        rows.append(" ".join(w))
    order = list(range(len(rows)))
    random.Random(9).shuffle(order)
    return [(3 * order[i] + 1, t, "en", ["a", "b", None, "ä"][i % 4], None) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC_SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def odd_columns(spark, corpus):
    """The same rows with further columns, whose names operators might use themselves."""
    more = [(*r, 1, 2, 3) for r in corpus]
    return spark.createDataFrame(more, DOC_SCHEMA + ", id long, v long, class long")
