import random
import re
import string

import pytest

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def thue_morse(n):
    """Two different words of n letters that polynomial hashes modulo powers of 2 confuse."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def rows():
    """Small documents: copies, near copies, shared passages, empty, null and long ones, a repeated row, null ids."""
    rng = random.Random(7)
    vocab = [a + b for a in "bcdfg" for b in ("a", "e", "é", "or", "The")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages = ["\n".join(line(9) for _ in range(4)) for _ in range(4)]
    out = []
    for i in range(60):
        parts = [line(rng.randrange(1, 30)) for _ in range(rng.randrange(3))] + [rng.choice(passages)] * rng.randrange(2)
        rng.shuffle(parts)
        out.append((i * 3 % 61, "\n".join(parts)))
    base = line(80).split(" ")
    for k in range(12):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(80)] = "new" + str(k)
        out.append((200 + k, " ".join(near)))
    out += [(None, None), (300, None), (301, ""), (None, passages[0]), (302, "a " * 120), (303, "x" * 400), (304, "a\n" * 90), (-5, passages[1]), (305, " \t\n"), (306, line(900))]
    return out + [out[5], out[5]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, row int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def by(rows):
    return sorted(rows, key=str)
