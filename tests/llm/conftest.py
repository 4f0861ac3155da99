import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def corpus():
    """Small texts with the awkward cases: (doc_id, text)."""
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60 ", "other ").replace("w61 ", "words ")
    texts = [
        base,
        base,
        near,
        near.replace("w10 ", "x "),
        base.upper(),
        "",
        None,
        "one",
        "one",
        "two words",
        "  \t\n ",
        "start " + " ".join(f"w{i}" for i in range(30, 90)) + " end",
        " ".join(f"w{i}" for i in range(49)),
        ("long text of some words, " * 8000).strip(),
        ("long text of some words, " * 8000).strip() + " tail",
        "é ü ß “quoted” text – mail a.b+c@mail.example.com, ip 10.0.0.255 and 1.2.3.4.5",
        "call +1 (319) 555-5132 or 4111 1111 1111 1111; 300.1.2.3 <|endoftext|> it's I'LL",
        "naïve İstanbul ΣΑΣ 中文字 é  x\x1cy\x85z 1234567890123456",
    ]
    return [(i * 5, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(i, t, "en", f"s{i % 7}", len(t or ""), "clash", 1) for i, t in corpus]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, n_words string, id int",
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
