import random

import numpy as np
import pytest

from rillwork.llm import sentencepiece_fst as fst
from rillwork.llm import token_counts
from rillwork.llm.pieces import model_bytes, processor

from .common import ODD, docs, prose

LIBRARY = processor(model_bytes())


def fuzz(n, seed):
    rng = random.Random(seed)
    parts = ["  ", " ", "a", "th", "é", "\n", "\t", "①", "\x00", "漢", "▁", "0", "😀", "<s>", "ing", ";\r", "    "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_counts_are_the_librarys(spark):
    texts = ODD + prose(20) + fuzz(150, 1)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs(spark, texts), limit=50).collect()}
    for i, t in enumerate(texts):
        n = len(LIBRARY.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 50), t


def test_long_pretokens_with_copies(spark):
    texts = ["x\x01" * 40000, "日本語\t" * 30000, "a " + "\x02" * 66000] * 3 + prose(5)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs(spark, texts)).collect()}
    want = {i: len(LIBRARY.encode(t)) for i, t in enumerate(texts)}
    assert got == want and sum(n > 65535 for n in want.values()) >= 6
    words = token_counts.frequent_pretokens(docs(spark, texts), "text", model_bytes())
    assert words and max(map(len, words)) <= token_counts.LONGEST


def test_a_full_cache_forgets_and_counts_on(monkeypatch):
    monkeypatch.setattr(token_counts, "RECENT", 3)
    of = token_counts.Lengths(model_bytes(), "▁the\n▁of", np.array([1, 1], np.uint16).tobytes())
    for t in prose(5):
        assert of.count(t) == len(LIBRARY.encode(t))


def test_paths_are_the_librarys_encoding():
    machine = fst.Transducer(model_bytes())
    for t in [x or "" for x in ODD] + prose(20) + fuzz(400, 2) + sorted(machine.merges.rank)[:2000:7]:
        ids = np.frombuffer(machine.encode(t), machine.kind)
        assert ids.tolist() == LIBRARY.encode(t), t
        assert machine.decode(ids) == LIBRARY.decode(ids.tolist()) == t.replace("▁", " ")


def test_the_shortest_path_alone_has_finite_weight():
    machine = fst.Transducer(model_bytes())
    weight, names = machine.merges.weight, machine.merges.names
    rng = random.Random(9)
    some = [machine.merges.names.index(p) for p in rng.sample(sorted(machine.merges.rank), 60)]
    for a in some:
        for b in some[:20]:
            whole = [x for x in (names[a], names[b])]
            merged = [LIBRARY.id_to_piece(i) for i in np.frombuffer(machine.compute("".join(whole)), machine.kind).tolist()]
            assert (weight(a, b) == 0.0) == (merged == whole), whole


def test_the_normaliser_is_the_models():
    from sentencepiece import sentencepiece_model_pb2 as proto

    from rillwork.llm.pieces import Normaliser

    model = proto.ModelProto.FromString(model_bytes())
    assert Normaliser(model_bytes())(" a  b ") == "▁▁a▁▁b▁" and Normaliser(model_bytes())("") == ""
    model.normalizer_spec.remove_extra_whitespaces = True
    assert Normaliser(model.SerializeToString())(" a  b ") == "▁a▁b"
    model.normalizer_spec.add_dummy_prefix = False
    assert Normaliser(model.SerializeToString())(" a  b ") == "a▁b"
    model.normalizer_spec.precompiled_charsmap = b"x"
    with pytest.raises(ValueError, match="maps"):
        Normaliser(model.SerializeToString())


def test_decoding_any_ids_is_the_librarys():
    machine, rng = fst.Transducer(model_bytes()), random.Random(3)
    for _ in range(400):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(6)]
        assert machine.decode(np.array(ids)) == LIBRARY.decode(ids), ids


def test_a_small_memory_forgets_and_encodes_on(monkeypatch):
    monkeypatch.setattr(fst, "PATHS", 8)
    machine = fst.Transducer(model_bytes())
    for t in prose(5):
        assert np.frombuffer(machine.encode(t), machine.kind).tolist() == LIBRARY.encode(t)


def test_encode_and_decode_tables(spark):
    texts = ODD + prose(5)
    coded = fst.encode(docs(spark, texts, [None, 1, 1, *range(3, len(texts))]), keep_text=True)
    rows = coded.collect()
    assert sorted(map(str, (r["ids"] for r in rows))) == sorted(map(str, (LIBRARY.encode(t or "") for t in texts)))
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    back = sorted(r["text"] for r in fst.decode(coded.select("doc_id", "ids")).collect())
    assert back == sorted((t or "").replace("▁", " ") for t in texts)
    assert fst.encode(docs(spark, [])).count() == 0 == token_counts.token_counts(docs(spark, [])).count()


def changed(**how):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto.FromString(model_bytes())
    if "kind" in how:
        model.trainer_spec.model_type = how["kind"]
    if "own" in how:
        model.pieces[1000].type = proto.ModelProto.SentencePiece.USER_DEFINED
    return model.SerializeToString()


@pytest.mark.parametrize(("how", "says"), [({"kind": 1}, "only BPE"), ({"own": True}, "user-defined")])
def test_other_models_are_refused(how, says):
    with pytest.raises(ValueError, match=says):
        fst.Transducer(changed(**how))
