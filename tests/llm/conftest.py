from __future__ import annotations

import random

import pytest



@pytest.fixture(scope="session")
def hostile():
    """(doc_id, text) rows: nulls, blanks, ties, repeats, near copies, very long texts."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in ("", "n", "rt", "ü")]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    shared = prose(60)
    base = prose(400)
    near = base.split(" ")
    rows = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "one two"),
            (6, "one two three"), (None, prose(50)), (None, None), (7, base), (8, base),
            (9, base), (10, shared), (11, f"{prose(30)} {shared} {prose(20)}"),
            (12, f"{prose(7)}\n{shared}"), (13, prose(34)), (14, prose(35)),
            (15, "la la la " * 200), (16, ("Zeile eins hier.\n" * 30) + prose(40)),
            (17, prose(20_000)), (18, "x" * 50_000), (19, f"{shared} {prose(5)} {shared}"),
            (20, "Ünïcode é ñ 日本語 текст 🎉 İstanbul ſtraße   x"),
            (21, "UPPER Case WORDS Ärger " * 12), (22, "#*$%&|<> a|b <c> " * 9),
            (7, base), (23, prose(120)), (23, prose(90)), (24, "1 2 3 4 5 6 7 8 9 10 11 12")]
    for i in range(30):
        text = list(near)
        for _ in range(1 + i % 4):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(text)))
    for i in range(60):
        a = rng.randrange(0, 40)
        rows.append((200 + i, f"{prose(rng.randrange(0, 60))} "
                              f"{' '.join(shared.split(' ')[a:a + rng.randrange(0, 60)])} "
                              f"{prose(rng.randrange(0, 60))}"))
    return rows


@pytest.fixture(scope="session")
def hostile_docs(spark, hostile):
    from namewatch.llm.common import ship

    ship(spark)
    rows = [(d, t, ("en", "de", None)[i % 3], ("b", "a", None, "c")[i % 4], i, "x", i)
            for i, (d, t) in enumerate(hostile)]
    # extra columns that clash with names an operator might use
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              "score string, rid long").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, (tuple(x) for x in want)))
