"""Small tables with the awkward rows: nulls, empty and very long texts, repeated rows, clashing column names."""

import pytest

WORDS = "the of and to in is that it was for on are with as his they at be this from".split()


def prose(n: int, seed: int = 0) -> str:
    """n words in sentences, the same for the same seed."""
    out = []
    for i in range(n):
        k = (i * 7919 + seed * 104729 + i * i * 31) % 100003
        w = WORDS[k % 20] + "aeiou"[k % 5] * (k % 3) + WORDS[k // 20 % 20]
        out.append(w.capitalize() if i % 12 == 0 else w + "." if i % 12 == 11 else w)
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    a = prose(120, 1)
    texts = [
        a, a, a.replace("the", "thee", 1), prose(150, 2), prose(90, 3) + "\nHome | About | Contact | News |\n" + prose(60, 4), "", None, "word", "x" * 50_000, "1 " * 20_000,
        prose(6000, 5), "spam spam " * 60, "a@b.co +1 (234) 555-6789 1.2.3.4 4337166598464399", "été 😀 中文 <|endoftext|> ça", "\n\n \t\n", "a b c", "A B C", prose(40, 6) + " <|endoftext|>",
    ]
    out = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s1", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[3], (None, prose(50, 7), "en", "s0", 1), (None, None, None, None, None)]


DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    clash = {c: F.lit("clash") for c in ("id", "fp", "digest", "size", "tokens", "spans", "h", "__text", "n_words")}
    return spark.createDataFrame(rows, DDL).repartition(3).withColumns(clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
