"""Small documents tables, and random texts that share passages."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(i, t, *(more or ("en", "s")), len(t or "")) for i, t, *more in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed, n=60):
    """Texts with exact and near copies, shared passages, nulls, empty and short ones."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.randint(13, 40)) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            near = words(rng.choice(texts))
            for _ in range(rng.randint(1, 3)):
                if near:
                    near[rng.randrange(len(near))] = "changed"
            texts.append("\n".join([" ".join(near[:7]), " ".join(near[7:])]))
        elif kind < 0.6:
            texts.append(" ".join([prose(rng, rng.randint(0, 60)), rng.choice(passages), prose(rng, rng.randint(0, 60))]))
        elif kind < 0.65:
            texts.append(rng.choice([None, "", "  \n\t ", "one", "two words", "a b c d e"]))
        else:
            texts.append(prose(rng, rng.randint(1, 150)))
    return [(i, t) for i, t in enumerate(texts)]
