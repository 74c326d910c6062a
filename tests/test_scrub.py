"""Secrets out of chunks by cells, against replacement in the joined text."""

import random

import pytest

from cuesmith.operators import scrub as S


def joined(text, secrets, cell, mark="[R]"):
    """Cells of a text: secrets struck out one after the other, each from left to right."""
    gone, kind = [False] * len(text), [None] * len(text)
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        i = 0
        while i + len(s) <= len(text):
            if text[i : i + len(s)] == s and not any(gone[i : i + len(s)]):
                gone[i : i + len(s)] = [True] * len(s)
                kind[i] = mark
                i += len(s)
            else:
                i += 1
    shown = [k or ("" if g else c) for c, g, k in zip(text, gone, kind)]
    return ["".join(shown[a : a + cell]) for a in range(0, len(text), cell)]


CASES = [
    (["abc", "ca", "bd"], "abcd", 7),
    (["abc", "aa", "bab"], "ab c", 5),
    (["aa"], "a", 4),
    (["", "x\\Ey", "\U0001f600b"], "xy\\E\U0001f600b", 6),
    (["ab", "\\E\\E"], "ab\\E﷐﷑﷒", 5),
    (["ab", "bc"], "abc﷐﷑﷒", 4),
]


@pytest.mark.parametrize("secrets, alphabet, cell", CASES)
def test_cells(spark, secrets, alphabet, cell):
    rng = random.Random(cell)
    files, rows = {}, []
    for f in (None, "a", "b", "c", "d"):
        chunks = [rng.choice([None, "", *("".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 40]))) for _ in range(4))]) for _ in range(0 if f == "d" else 12)]
        files[f] = "".join(c or "" for c in chunks)
        rows += [(f, i * 3, c) for i, c in enumerate(chunks)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, n int, text string")
    got = {}
    for r in S.scrubbed_cells(df, "file", "n", "text", secrets, "[R]", cell, 5).collect():
        got.setdefault(r.file, {})[r.cell] = r.text
    size = max([cell, *map(len, secrets)])
    want = {f: dict(enumerate(joined(t, secrets, size))) for f, t in files.items() if t}
    assert got == want


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], "file string, n int, text string")
    for secrets in ([], ["key"], ["aa"]):
        assert S.scrubbed_cells(df, "file", "n", "text", secrets).collect() == []
    with pytest.raises(ValueError, match="FDD0"):
        S.scrubbed_cells(df, "file", "n", "text", ["a﷐"])
