import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, root string"


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randrange(3, 9))) for _ in range(900)]


@pytest.fixture(scope="session")
def texts(words):
    """Plain texts, exact and near copies, odd ones."""
    r = random.Random(6)
    line = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    plain = ["\n".join(line(r.randrange(8, 30)) for _ in range(r.randrange(1, 6))) for _ in range(24)]
    near = []
    for t in plain[:8]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    odd = [None, "", " \n\t", "!!! ... ***", "one two", "one two", "One, two", "x " * 300, "ü é 中文 🙂 'quoted' it's 12.5", "same line here again\n" * 30, " ".join(r.choice(words) for _ in range(9000))]
    return plain + plain[:5] + near + odd


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "clash") for i, t in enumerate(texts)], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def strange(spark, texts):
    """Null and repeated ids, repeated rows."""
    rows = [(None if i % 9 == 0 else i // 2, t, None, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
