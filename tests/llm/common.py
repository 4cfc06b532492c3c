"""Small tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, sources=None, schema=DOCS):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)], schema).repartition(3)


def prose(n, seed=0, words=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(words // 2, words))) for _ in range(n)]


#: Texts that operators must get over: none, empty, blank, alike but for white space, long, odd characters.
ODD = [None, "", " ", "\n", "a", "a  b", "a \t\nb", "a b", "A b", "ﬁ ① 漢字 😀 ▁x \x00 \r\n end", "x" * 5000, "xq\x02" * 70000, "w " * 3000, "the same line\nthe same line\n\n", "<s> </s> <unk> <0x41>"]
