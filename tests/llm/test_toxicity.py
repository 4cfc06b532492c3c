import random
import zlib

import zstandard

from rillwork.llm import toxicity

from .common import ODD, docs, prose

INSULTS = ["blockheadly", "nincompoopish", "worthlessness", "scoundrelous"]


def corpus(n, seed):
    rng, out = random.Random(seed), []
    for k, text in enumerate(prose(n, seed)):
        words = text.split()
        if k % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append(" ".join(words))
    return out, [int(k % 4 == 0) for k in range(n)]


def test_held_out_rows_are_told_apart(spark):
    texts, toxic = corpus(600, 5)
    df = docs(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model, prior = toxicity.fit(df, labels)
    assert 0.2 < prior < 0.3
    rows = toxicity.score(df, model, prior).withColumn("held", toxicity.held_out()).collect()
    held = [r for r in rows if r["held"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum((r["score"] >= 0.5) == bool(toxic[r["doc_id"]]) for r in held)
    assert right / len(held) > 0.93


def test_odd_rows_have_scores(spark):
    texts, toxic = corpus(100, 6)
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1), (3, None)], "doc_id long, toxic int")
    df = docs(spark, texts + ODD, [*range(100), None, 5, 5, *range(200, 200 + len(ODD) - 3)])
    model, prior = toxicity.fit(df, labels)
    rows = toxicity.score(df, model, prior, keep=("text", "lang")).collect()
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r["score"] <= 1 for r in rows)


def test_without_labels_the_base_rate(spark):
    df = docs(spark, ["a", "b"])
    model, prior = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model is None and [r["score"] for r in toxicity.score(df, model, prior).collect()] == [0.0, 0.0]
    model, prior = toxicity.fit(df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs(spark, []), model, prior).count() == 0


def test_statistics_are_those_of_windows_compressed_one_by_one():
    texts, toxic = corpus(200, 7)
    model = toxicity.train([t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y], 0.25)
    for text in [*texts[:20], "", None, "one", " ".join(["word"] * 13)]:
        words = (text or "").lower().split()
        starts = [0] + [i for i in range(4, len(words), 4) if i + 8 < len(words)]  # a window for what the last one didn't reach
        cut_up = [" ".join(words[i : i + 12]).encode() for i in starts]
        want = []
        for (plain, part), (_, _, shortest) in zip(model.gains, toxicity.PAIRS, strict=True):
            params = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_DFAST, min_match=shortest, window_log=17, hash_log=17, chain_log=16, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            size = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c), compression_params=params).compress for c in (plain, plain + part)]
            gain = [len(size[0](w)) - len(size[1](w)) for w in cut_up]
            want.append((max(gain), sum(gain) / len(gain), sum(g >= 1 for g in gain) / len(gain)))
        got = toxicity.Gains(model.gains).statistics(text)
        assert [(got[1 + 9 * k], got[3 + 9 * k], got[4 + 9 * k]) for k in (0, 1)] == want


def test_new_words_on_a_stem_that_ordinary_words_share():
    rng = random.Random(9)
    ends = ["ber", "keit", *(a + b + c for a in "stgmk" for b in "aeiu" for c in "nlr")]  # 62: a word begins with both by chance in one of some 6,000

    def text(toxic):
        words = ["".join(rng.choices(ends, k=rng.randint(1, 3))) for _ in range(150)]
        for _ in range(8 * toxic):
            words[rng.randrange(150)] = "berkeit" + "".join(rng.choices(ends, k=rng.randint(1, 2)))
        return " ".join(words)

    model = toxicity.train([text(True) for _ in range(150)], [text(False) for _ in range(450)], 0.25)
    rows = [(text(k % 4 == 0), k % 4 == 0) for k in range(400)]
    gains = toxicity.Gains(model.gains)
    right = sum((p >= 0.5) == y for p, (_, y) in zip(model.scores([gains.statistics(t) for t, _ in rows]), rows, strict=True))
    assert right / len(rows) > 0.9


def test_texts_that_are_too_long_for_the_fit_have_scores(spark):
    texts, toxic = corpus(200, 8)
    df = docs(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model, prior = toxicity.fit(df, labels, longest=5)
    assert model is None and toxicity.score(df, model, prior).where(f"score = {prior}").count() == 200
