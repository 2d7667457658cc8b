import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, key int, host string, n_words string, shard int, copies int, gone int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed, n):
    """``n`` words from a seed, in lines of eight."""
    import random

    r = random.Random(seed)
    words = [r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 8]) for i in range(0, n, 8))


def edge_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    long = text(1, 6000)
    texts = [None, "", " \t\n", "a b", "a  b ", "a b", long, long + " x", text(2, 60), text(2, 60).replace(" ", "\t", 1), text(3, 60), text(2, 56) + " tail", "é\x0b😀 +1 (826) 555-4081 x@y.org"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, "a b", "en", "s0", 3), (3, "a b", "en", "s0", 3), (None, "a b", None, None, None), (None, None, None, None, None), (99, long, None, None, None)]
    return [(*r, True, "clash", 7, "clash", "clash", 1, 1, 1) for r in rows]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
