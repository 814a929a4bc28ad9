import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import odd
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import pieces, token_files
from tidemark.llm.common import utf8

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

HARD = ["", " ", "  a  b ", "x" * 700, "日本語" * 50, "c▁d", "\n\n\t ", "é梦🎉́", "the\nthe the", "<s></s>", " 　 a  b"]


def test_pieces_are_lossless_and_read_by_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = HARD + odd.texts(1, 30)
    vocab = pieces.vocabulary(MODEL, 1.0)
    data, offsets = utf8(pa.array(texts))
    ids, ends = pieces.encode_texts(vocab, data, offsets, np.arange(len(texts)), 3)
    back, bounds = pieces.decode_ids(vocab, ids, ends)
    for i, text in enumerate(texts):
        assert back[bounds[i] : bounds[i + 1]].tobytes().decode() == text
        assert model.decode(ids[ends[i] : ends[i + 1]].tolist()) == text


def test_segmentations_are_drawn_with_their_probability():
    vocab = pieces.vocabulary(MODEL, 0.3)
    text, n = " other", 40_000
    data, offsets = utf8(pa.array([text[1:]] * n))
    ids, ends = pieces.encode_texts(vocab, data, offsets, np.arange(n), 11)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:]))
    known = {b: i for i, b in enumerate(vocab.bytes) if i > 258}
    weight = {}
    for marks in itertools.product([0, 1], repeat=len(text) - 1):
        cuts = [0, *[i + 1 for i, m in enumerate(marks) if m], len(text)]
        parts = [text[a:b].encode() for a, b in zip(cuts, cuts[1:])]
        if all(p in known for p in parts):
            weight[tuple(known[p] for p in parts)] = float(np.prod([vocab.weight[known[p]] for p in parts]))
    total = sum(weight.values())
    assert set(got) <= set(weight) and len(got) > 5
    for path, w in weight.items():
        expected = n * w / total
        assert abs(got[path] - expected) <= 5 * expected**0.5 + 3


def test_encode_is_reproducible_and_handles_odd_rows(spark):
    frame = odd.frame(spark, odd.rows(2, 40))
    got = pieces.encode(frame, MODEL).collect()
    again = pieces.encode(frame.repartition(5), MODEL).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, tuple(r["ids"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    want = Counter((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _ in odd.rows(2, 40))
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == want
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in got)
    texts = pieces.decode(pieces.encode(frame, MODEL), MODEL).collect()
    assert Counter((r["doc_id"], r["text"]) for r in texts) == Counter((d, t or "") for d, t, _ in odd.rows(2, 40))
    assert pieces.encode(odd.empty(spark), MODEL).count() == 0


def test_stretches_encode_like_whole_texts():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    marks = [" ", "  ", "\n", "\n\n", "a", "The", "don't", " ", "　", "é", "12", "<|endoftext|>", ".", "\t", "\x1c", " ", "梦", "\u0085", " ", "\r\n"]
    texts = ["".join(rng.choice(marks, rng.integers(0, 20))) for _ in range(3000)] + HARD
    tool = token_files.Encoder(BYTE_BPE)
    data, offsets = utf8(pa.array(texts))
    ids, ends = tool.encode(data, offsets)
    want = Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)
    for i, w in enumerate(want):
        assert ids[ends[i] : ends[i + 1]].tolist() == w.ids


@pytest.mark.parametrize("counts", [[1], [5, 0, 1], [1] * 300, [2**i for i in range(40)], [0, 0]])
def test_code_lengths(counts):
    counts = np.array(counts, dtype=np.int64)
    lengths = token_files.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max(initial=0) <= token_files.LIMIT
    used = lengths[lengths > 0].astype(float)
    assert (2.0**-used).sum() <= 1.0
    if len(used) > 1 and counts.max() < 2**16:  # optimal: within one bit of the entropy
        p = counts[counts > 0] / counts.sum()
        assert (p * used).sum() <= -(p * np.log2(p)).sum() + 1


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 900).astype(np.int32)
    counts = np.bincount(ids, minlength=1000)
    counts[0] += 1
    lengths = token_files.code_lengths(counts)
    bits, marks = token_files.pack_bits(ids, token_files.canonical(lengths), lengths)
    assert np.array_equal(token_files.unpack_bits(bits, marks, n, token_files.decode_table(lengths)), ids)


def test_token_files(spark):
    from tokenizers import Tokenizer

    rows = odd.rows(4, 60)
    got = token_files.token_files(odd.frame(spark, rows), BYTE_BPE).orderBy("start").collect()
    tool, start = Tokenizer.from_file(BYTE_BPE), 0
    order = sorted((d, t or "") for d, t, _ in rows if d is not None)
    assert [r["doc_id"] for r in got] == [d for d, _ in order]
    for r, (_, text) in zip(got, order):
        ids = tool.encode(text, add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], list(r["ids"])) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.token_files(odd.empty(spark), BYTE_BPE).count() == 0


def test_files_are_read_again_from_their_place(spark, tmp_path):
    blocks, lengths = token_files.write_ids(odd.frame(spark, odd.rows(4, 30)), BYTE_BPE)
    blocks.write.parquet(f"{tmp_path}/ids")
    again = token_files.read_ids(token_files.stored(spark, f"{tmp_path}/ids"), lengths)
    assert sorted(map(tuple, token_files.read_ids(blocks, lengths).collect())) == sorted(map(tuple, again.collect()))
