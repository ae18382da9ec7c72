"""Small documents with every awkward case, and columns whose names the operators use inside."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, `row` string, words string, at long, h string, fp string, `key` string, n string, part string, bucket string, template string"


def make_docs():
    rng = random.Random(3)
    syllables = ["the", "ing", "ou", "ré", "ß", "an", "tion", "er", "st", "ÿ", "日本"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    base = sentence(60)
    texts = [
        None, "", " ", "\n\t ", "one", "one two", "a b c", base, base, base.replace(" ", "  ", 3), base.upper(), base + " x", base.replace("ing", "in", 1),
        sentence(9000), "x" * 5000, "ababab " * 800, "\x1c\x85  odd blanks\x00nul", "<|endoftext|> and <|startoftext|> </s> <unk>", "don't stop, it's 1234 o'clock. \U00013000\U0001f600 é é",
        "Released under the MIT License. Apache License; GNU General Public License, CC BY 4.0 mit license", "mail a.b@c.example.com +1 (555) 123-4567 at 10.0.0.300 or 10.0.0.30, card 4111 1111 1111 1111 and 4111 1111 1111 1112",
    ]
    texts += [sentence(rng.randint(1, 80)) for _ in range(40)]
    ids = list(range(len(texts)))
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{min(i % 5, 2)}", None) + ("x",) * 3 + (1,) + ("x",) * 7 for i, t in zip(ids, texts)]
    rows += [rows[7], rows[7], rows[3], (None, base, None, "s1", 1) + (None,) * 11]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in make_docs()]


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
