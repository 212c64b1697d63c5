"""Tables of bounded size: words of several batches stay, ids don't depend on the room; CRC-16 by tables."""

import inspect

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from ledgerloom.llm import bpe, flac


def test_words_of_several_batches_stay():
    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    small, large = bpe.Tokenizer(spec, 0.0005), bpe.Tokenizer(spec)
    encoded = []
    own = small.automaton.encode_word
    small.automaton.encode_word = lambda w: encoded.append(w) or own(w)
    for i in range(40):
        texts = [b"again and again", b" ".join(b"w%dx%dq" % (i, j) for j in range(20))]
        got, many = small.encode_batch(texts)
        want, sizes = large.encode_batch(texts)
        assert got.tolist() == want.tolist() and many.tolist() == sizes.tolist()
    assert small.kept == 50 and len(small._met) < 200
    assert encoded.count(b" again") == 1 and encoded.count(b" and") == 1


def test_a_batch_is_read_in_slices():
    b = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["x"] * 600)], ["doc_id", "text"])
    assert [x.num_rows for x in bpe.pieces(iter([b]))] == [256, 256, 88]
    assert "room" in inspect.getsource(corpus_pipeline.encode)


def test_crc16_by_tables_equals_that_in_step():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 60_000).astype(np.uint8)
    start, size = rng.integers(0, 40_000, 300), np.r_[0, 1, 2, flac.NEAR, flac.NEAR + 1, 9000, rng.integers(1, 4200, 294)]
    got = flac.crc16(buf, start, size, most=5000)
    assert got[0] == 0 and got[1:].tolist() == flac._crc16_in_step(buf, start[1:], size[1:]).tolist()
    assert flac.crc16(buf, start[:0], size[:0]).tolist() == []
