import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, start=0):
    return [(start + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts, start=0: spark.createDataFrame(rows(texts, start), DOCS)


@pytest.fixture(scope="session")
def sample():
    """Texts with copies, near copies, shared passages, repeated lines, nulls, empties and one long text."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    lines = lambda n: "\n".join(" ".join(words(r.randint(3, 14))) for _ in range(n))
    passage, block = " ".join(words(70)), lines(4)
    out = [lines(r.randint(1, 12)) for _ in range(25)]
    out += [out[0], out[0], out[3], None, "", "   \n\t\n", "one", "one two", None]
    near = out[5].split(" ")
    near[len(near) // 2] = "changed"
    out += [" ".join(near), out[6] + " tail", "Head " + out[6]]
    out += [" ".join(words(20)) + " " + passage + " " + " ".join(words(r.randint(0, 30))) for _ in range(6)]
    out += [lines(2) + "\n" + block + "\n" + lines(3) for _ in range(5)]
    out += [" ".join(words(3000)), "été ÇA «naïve» ß İı 漢字 🙂\u00a0x\u2003y", "same same same " * 60]
    out += [passage, passage + " " + passage, block + "\n" + block]
    r.shuffle(out)
    return out
