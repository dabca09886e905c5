"""What the encoder keeps in a Python worker."""

import pyarrow as pa

from tidewater.llm import sentencepiece_codec as S


def test_one_vocabulary_for_encoding_and_decoding():
    assert S.vocabulary(S.MODEL) is S.vocabulary(S.MODEL, "bpe")


def test_pairs_are_kept_by_the_vocabularys_own_strings():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["several ordinary sentences of words", "and another one, repeated"]})
    got = list(S.encoded_batches(iter([batch]), S.MODEL, "bpe"))
    assert sum(b.num_rows for b in got) == 2
    v = S.vocabulary(S.MODEL)
    pairs = [p for pair in v.joins for p in pair if p in v.own]
    assert pairs and all(p is v.own[p] for p in pairs)
