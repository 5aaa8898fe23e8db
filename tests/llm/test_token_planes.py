import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import token_planes as tp

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab ,.\n\t'é1<|>Z "), max_size=40), max_size=8))
def test_memo_encoder_equals_the_library(texts):
    enc = _encoder()
    want = [[*e.ids, 2] for e in enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ids, ends = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=False)] == want


_kept = []


def _encoder():
    if not _kept:
        _kept.append(tp.MemoEncoder(PATH, 2))
    return _kept[0]


@pytest.mark.parametrize("plane", ["bit", "byte"])
@pytest.mark.parametrize("width", [2, 4])
def test_shard_round_trip(plane, width):
    rng = np.random.default_rng(1)
    lengths = [0, 1, tp.BLOCK_IDS, 5, 3 * tp.BLOCK_IDS + 7]
    ids = rng.integers(0, 50_000, sum(lengths)).astype(f"<u{width}")
    shard = tp.Shard(io.BytesIO(tp.pack_shard([None, -5, 2, 2, 9], lengths, ids.tobytes(), width, plane)))
    got = list(shard.documents())
    assert [(d, a, len(x)) for d, a, x in got] == [(d, a, n) for d, a, n in zip([None, -5, 2, 2, 9], np.cumsum([0, *lengths[:-1]]), lengths, strict=True)]
    assert np.array_equal(np.concatenate([x for *_, x in got]), ids)
    with pytest.raises(ValueError):
        tp.Shard(io.BytesIO(b"x" * 40))


def test_query_rows(spark):
    rows = [(5, "hello world"), (1, None), (1, "b"), (1, "b"), (None, ""), (9, "long " * 30_000), (7, "a  b \n")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, ids string, start int, tie string")
    out, manifest = tp.encode_to_planes(docs, PATH)
    got = sorted(out.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1, 5, 7, 9]
    enc, at = _encoder().tok, 0
    left = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r in got:
        options = {t for i, t in left if i == r.doc_id}
        crcs = {zlib.crc32(np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in options}
        assert r.start == at and r.ids_crc32 in crcs
        at += r.n_tokens
    assert sum(r.n_ids for r in manifest.collect()) == at
    assert tp.encode_to_planes(docs.limit(0), PATH)[0].count() == 0


def test_kept_units_are_not_encoded_again(monkeypatch):
    words = ["w" + "".join(chr(97 + k // 26**j % 26) for j in range(4)) + "," for k in range(120_000)]
    texts = [pa.array([" ".join(["x", *words[k : k + 10_000]])]) for k in range(0, 90_000, 10_000)]
    enc, sent = tp.MemoEncoder(PATH, 2), []
    first, given = [enc.encode(t) for t in texts], enc._ids
    monkeypatch.setattr(enc, "_ids", lambda x: sent.extend(x) or given(x))
    again = [enc.encode(t) for t in texts]
    assert sum(map(len, sent)) <= len(texts)  # the first unit of each text
    assert all(np.array_equal(a, b) and np.array_equal(x, y) for (a, x), (b, y) in zip(first, again, strict=True))


def test_memo_is_bounded_and_forgets_nothing_needed():
    rng = np.random.default_rng(3)
    enc = tp.MemoEncoder(PATH, 2, units=50)
    for _ in range(40):
        words = ["".join(rng.choice(list("abcdé,'1\n<"), rng.integers(1, 7))) for _ in range(60)]
        texts = [" ".join(words[:30]), None, " ".join(words[30:]), "u" * 200 + " " + "v" * 200, "a  b", " ", ""]
        ids, ends = enc.encode(pa.array(texts, pa.string()))
        want = [[*e.ids, 2] for e in enc.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=False)] == want
        assert len(enc.known) <= 50 and all(len(u) <= tp.LONGEST for u in enc.known.to_pylist())
    assert len(enc.known) == len(enc.ids) == len(enc.met) == len(enc.known.unique())
