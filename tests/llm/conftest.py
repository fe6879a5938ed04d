import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, set long"
WORDS = {
    "en": "the of and to in is that for it was on are as with his they at be this from".split(),
    "fr": "le la les des une dans pour que qui avec sur est pas vous nous sont mais plus tout".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, null, blank and short texts, odd characters and one long text."""
    rng = random.Random(7)
    base = [sentence(rng, lang, 40) for lang in ("en", "fr") for _ in range(8)]
    out = list(base) + [base[0], base[0].upper()]
    for k in (1, 1, 2):
        words = base[k].split()
        words[-1] = rng.choice(["changed", "other"])
        out.append(" ".join(words))
    out += [None, "", "  \t\n ", "one two", "one two", "Licensed CC BY. All rights reserved, GNU General Public License", "naïve 日本語 🙂  x’s don't  12345", "a" * 300, sentence(rng, "en", 4000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names clash with the operators' own, repeated rows and a null id."""
    rows = [(k, t, "en" if k % 2 else "fr", None if k % 5 == 0 else f"s{k % 3}", None, 0.5, k) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, docs):
    return docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "cast(doc_id % 3 = 0 as int) AS toxic").union(spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int"))
