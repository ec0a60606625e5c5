import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm.elias_fano import EliasFano
from tallyfield.llm.token_counts import count_tokens, proven_tokens
from tallyfield.llm.token_file import Shard, _tokenizer, read_token_file, token_file, vocabulary_path, write_token_file


@given(st.lists(st.integers(0, 5000), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip_and_selection(xs):
    xs = np.cumsum(np.array(xs, np.int64))
    e = EliasFano.from_bytes(EliasFano.of(xs).to_bytes())
    assert e.all().tolist() == xs.tolist()
    at = np.arange(len(xs))[::-3]
    assert e.select(at).tolist() == xs[at].tolist()


def test_elias_fano_is_small():
    xs = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 100_000))
    assert len(EliasFano.of(xs).to_bytes()) * 8 / len(xs) < 2 + np.log2((1 << 40) / 100_000) + 0.5
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


def expected(rows):
    tk = _tokenizer(vocabulary_path())
    start = 0
    for i, text in sorted(((r.doc_id, r.text or "") for r in rows), key=lambda x: (x[0] is not None, x)):
        ids = [*tk.encode(text, add_special_tokens=False).ids, 2]
        yield i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_file(spark, odd, empty):
    got = token_file(odd).collect()
    assert sorted(got, key=lambda r: r.start) == list(expected(odd.collect()))
    assert token_file(empty).collect() == []


def test_a_document_is_read_by_selection(spark, odd, tmp_path):
    at = f"file://{tmp_path}"
    manifest = write_token_file(odd, at, vocabulary_path(), 2)
    tk = _tokenizer(vocabulary_path())
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for m in manifest:
        s = Shard(m["file"])
        for i, d in enumerate(s.doc_ids(0, s.meta["docs"]).to_pylist()):
            assert tk.decode(s.document(i)[:-1].tolist(), skip_special_tokens=False) == texts[d]
    assert read_token_file(spark, manifest).count() == odd.count()
    broken = manifest[0]["file"].removeprefix("file://")
    open(broken, "ab").write(b"x")
    with pytest.raises(ValueError):
        Shard(manifest[0]["file"])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, odd, empty, name):
    path = vocabulary_path(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        tk = _tokenizer(path)
        count = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := count(r.text or ""), n > 512) for r in odd.collect()), key=key)
    assert sorted(map(tuple, count_tokens(odd, path).collect()), key=key) == want
    assert count_tokens(empty, path).collect() == []


def test_proven_tokens_encode_alone():
    path = vocabulary_path()
    some = sorted(proven_tokens(path))[::997]
    model = _tokenizer(path).model
    assert len(proven_tokens(path)) > 45_000 and all(len(model.tokenize(w)) == 1 for w in some)


def test_pieces_equal_whole_texts():
    """Random joins of odd characters, through the piece table and through the library."""
    import pyarrow as pa

    from tallyfield.llm.pieces import PieceTable, encode_batch

    tk = _tokenizer(vocabulary_path())
    rng = np.random.default_rng(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "it's", "12", "é", "ß", "中", " ", " ", "\x1c", "\x85", "!?", "don't", "<|endoftext|>", "'ll", "word", ".\nNext", "😀", "ɐ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)]
    texts += ["x" * 200 + " " + "y" * 70 + "  z", "  " * 50 + "a", "word, " * 40 + "é" * 90]
    table = PieceTable(tk, with_ids=True, keep=60_000)
    counts = PieceTable(tk, with_ids=False, proven=proven_tokens(vocabulary_path()), keep=60_000)
    for k in range(0, len(texts), 700):
        some = texts[k : k + 700]
        lens, ids = encode_batch(pa.array(some, pa.large_string()), table)
        at = np.concatenate(([0], np.cumsum(lens)))
        for i, t in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)
        assert encode_batch(pa.array(some, pa.large_string()), counts)[0].tolist() == lens.tolist()
        assert table.bytes <= 2 * 60_000 or k == 0
