import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, mix_copy int, n_lines string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    texts = [None, "", " \t\n ", "one", "Just three words", LONG, LONG, "a\n\nb\na\n", "Ünïcode wörds çà\n" * 3]
    texts += base + [base[0], base[0].upper(), base[1] + " tail", base[2].replace(" ", "  ", 3)]
    near = base[3].split()
    texts += [" ".join(near[:-1] + ["changed"]), " ".join(near[1:]), "shared passage of words here\n" + base[4], base[5] + "\nshared passage of words here"]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 2}", len(t or ""), "x", "y", i, "z") for i, t in enumerate(texts)]
    rows.append(rows[9])  # a repeated row
    rows.append((100, base[6], None, None, 0, None, None, None, None))
    rows.append((None, "no id here but some text of its own", "en", "s0", 0, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
