"""Which pieces stay apart side by side, told without merging them anew."""

import random

import pyarrow as pa

from tidewater.llm import sentencepiece_codec as S


def test_apart_is_what_merging_gives():
    v, r = S.Vocabulary(), random.Random(1)
    pieces = [p for p in v.ids if v.merged(p) == [p]]
    short = [p for p in pieces if len(p) < 4]
    for _ in range(40_000):
        a, b = r.choice(r.choice((pieces, short))), r.choice(r.choice((pieces, short)))
        assert v.apart(a, b) == (v.merged(a + b) == [a, b]), (a, b)
    for word in r.sample(pieces, 4000):  # pairs that belong together, and those beside them
        for i in range(1, len(word)):
            a, b = word[:i], word[i:]
            if a in v.ids and b in v.ids and v.merged(a) == [a] and v.merged(b) == [b]:
                assert v.apart(a, b) == (v.merged(a + b) == [a, b]), (a, b)


def test_pairs_are_kept_by_ids_and_words_stay_known():
    v = S.vocabulary(S.MODEL)
    v.fits.clear()
    texts = ["several ordinary sentences of words"] * 3
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": texts})
    old, S.SPAN, S.KEPT_CHARACTERS = (S.SPAN, S.KEPT_CHARACTERS), 10, 20
    made = []
    try:
        real, v.encode_words = v.encode_words, lambda words: (made.append(list(words)), real(made[-1]))[1]
        got = list(S.encoded_batches(iter([batch]), S.MODEL, "bpe"))
    finally:
        (S.SPAN, S.KEPT_CHARACTERS), _ = old, v.__dict__.pop("encode_words")
    # a word met again after a change of generations is not encoded anew
    assert [len(m) for m in made] == [5, 0, 0] and len({str(b.column("ids").to_pylist()) for b in got}) == 1
    assert v.fits and all(type(k) is int for k in v.fits)
