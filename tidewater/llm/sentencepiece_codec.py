"""SentencePiece encoding and decoding: forward states over a trie of distinct marked words, depth-first."""

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import documents, give_back, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of text worked on at once; different pairs of pieces, and characters of different words, that a Python worker keeps.
SPAN, KEPT_PAIRS, KEPT_CHARACTERS = 1 << 19, 350_000, 2 << 20


class Vocabulary:
    """Pieces of a model file and the forward step over a word.

    kind says how the best segmentation of a prefix follows from those of shorter ones. unigram: the
    largest sum of scores (Viterbi). bpe: merges by score have exactly one last piece for each prefix,
    the one that the rest's last piece doesn't merge across; so the state of a prefix is a length
    there too, and the result is that of merging the whole word.
    """

    def __init__(self, model: str = MODEL, kind: str = "bpe") -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.kind, self.ids, self.scores, self.size = kind, {}, {}, size
        bytes_of = [b""] * size
        self.byte_ids = [sp.unk_id()] * 256
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                bytes_of[i] = piece.replace(MARK, " ").encode()
        self.pieces = pa.array(bytes_of, pa.large_binary())
        self.longest = max(map(len, self.ids), default=1)
        tails: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                tails.setdefault(piece[-3:], set()).add(len(piece))
        #: Lengths that a piece may have by the last three characters, the longest first; 2 and 1 always may be.
        self.tails = {t: (*sorted(n, reverse=True), 2, 1) for t, n in tails.items()}
        if any(a != MARK and b == MARK for p in self.ids for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece goes on across the start of a word")
        # line ends and tabs that are in no piece stand alone, so that they needn't make words longer
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        self.words_of = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        self.lowest = min(self.scores.values(), default=0.0) - 10
        #: Whether pieces stay apart side by side: by their ids (last * (size + 1) + piece, size for no piece before), by text where one has no id.
        self.fits: dict[int, bool] = {}
        self.joins: dict[tuple[str, str], bool] = {}
        self.cuts: dict[str, tuple[str, str] | None] = {}
        #: The vocabulary's own strings: pairs are kept by these, not by slices of words.
        self.own = {p: p for p in self.ids}
        #: Ids of words, kept from one span of a task to the next: those met since a time, and those met in the time before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept = 0

    def marked(self, text: str) -> list[str]:
        return self.words_of(MARK + text.replace(" ", MARK)) if text else []

    def merged(self, word: str, least: int = 1) -> list[str]:
        """Merging by score, the leftmost first among equals, until least parts are left: small inputs only (two pieces)."""
        parts, scores = list(word), self.scores
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last: str, piece: str) -> bool:
        """Whether the merges of both pieces together leave them as they are."""
        known = self.joins.get((last, piece))
        if known is None:
            if len(self.joins) > KEPT_PAIRS:
                self.joins.clear()
            own = self.own
            known = self.joins[(own.get(last, last), own.get(piece, piece))] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return known

    def _fit(self, last: str, piece: str, key: int) -> bool:
        """follows, kept by the ids of both, where they have some."""
        if len(self.fits) > KEPT_PAIRS:
            self.fits.clear()
        fits = self.fits[key] = self.apart(last, piece) if last else self.follows(last, piece)
        return fits

    def cut(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a piece puts together; None where that is not the merge with the lowest score of all that make it."""
        if piece not in self.cuts:
            parts, scores = self.merged(piece, 2), self.scores
            later = len(parts) == 2 and all(len(p) == 1 or scores[p] > scores[piece] for p in parts)
            self.cuts[piece] = tuple(self.own.get(p, p) for p in parts) if later else None
        return self.cuts[piece]

    def apart(self, last: str, piece: str) -> bool:
        """follows for two pieces, from the end: their latest merges are undone one by one, and whenever what then meets would have been merged
        before the merge undone, they don't stay apart. At most as many steps as characters, where merging anew takes their square."""
        scores, a, b, limit, left_first = self.scores, last, piece, float("-inf"), True
        while True:
            s = scores.get(a + b)
            if s is not None and (s > limit or (left_first and s == limit)):
                return False
            late_a, late_b = scores[a] if len(a) > 1 else float("inf"), scores[b] if len(b) > 1 else float("inf")
            if len(a) == len(b) == 1:
                return True
            parts = self.cut(a if late_a < late_b else b)
            if parts is None:
                return self.merged(last + piece) == [last, piece]
            if late_a < late_b:
                a, limit, left_first = parts[1], late_a, False
            else:
                b, limit, left_first = parts[0], late_b, True

    def _lengths(self, word: str, common: int, state: list[int], codes: list[int]) -> None:
        """bpe: the length of the last piece of each prefix longer than common, appended to state, and its id (-1: none) to codes."""
        ids, tails, fits, base, short = self.ids, self.tails, self.fits, self.size + 1, (2, 1)
        for end in range(common + 1, len(word) + 1):
            for n in tails.get(word[end - 3 : end], short) if end > 2 else short:
                start = end - n
                if start < 0:
                    continue
                code = ids.get(word[start:end], -1)
                if code >= 0:
                    last = codes[start]
                    if last >= 0:
                        fit = fits.get(last * base + code)
                        if fit is None:
                            fit = self._fit(word[start - state[start] : start] if start else "", word[start:end], last * base + code)
                    else:
                        fit = self.follows(word[start - state[start] : start], word[start:end])
                elif n > 1:
                    continue
                else:
                    fit = self.follows(word[start - state[start] : start] if start else "", word[start:end])
                if fit:
                    state.append(n)
                    codes.append(code)
                    break

    def _best(self, word: str, common: int, state: list[int], sums: list[float]) -> None:
        """unigram: the same, and the largest sum of scores of each prefix in sums."""
        for end in range(common + 1, len(word) + 1):
            best = (-float("inf"), 1)
            for n in range(1, min(end, self.longest) + 1):
                score = self.scores.get(word[end - n : end], self.lowest if n == 1 else None)
                if score is not None:
                    best = max(best, (sums[end - n] + score, n))
            sums.append(best[0])
            state.append(best[1])

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids as little-endian int32.

        The words in sorted order are the depth-first order of their trie: the states up to the
        common prefix with the word before stay, only those below it are computed.
        """
        ids, before, state, sums, codes, bpe = self.ids, "", [0], [0.0], [self.size], self.kind == "bpe"
        for word in sorted(words):
            common = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                common += 1
            del state[common + 1 :]
            if bpe:
                del codes[common + 1 :]
                self._lengths(word, common, state, codes)
            else:
                del sums[common + 1 :]
                self._best(word, common, state, sums)
            before, found, end = word, array("i"), len(word)
            while end:
                start = end - state[end]
                i = codes[end] if bpe else ids.get(word[start:end], -1)
                if i >= 0:
                    found.append(i)
                else:
                    found.extend([self.byte_ids[b] for b in reversed(word[start:end].encode())])
                end = start
            found.reverse()
            yield word, found.tobytes()


def vocabulary(model: str, kind: str = "bpe") -> Vocabulary:
    """One for each Python worker, whichever way it is asked for."""
    return _vocabulary(model, kind)


@lru_cache(2)
def _vocabulary(model: str, kind: str) -> Vocabulary:
    return Vocabulary(model, kind)


def encoded_batches(batches: Iterator[pa.RecordBatch], model: str, kind: str) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and text with ids and n_pieces, a span of texts at a time."""
    v = vocabulary(model, kind)
    for batch in batches:
        start, size = 0, 0
        for end, n in enumerate(pc.utf8_length(batch.column("text")).to_pylist(), 1):
            size += n
            if size < SPAN and end < batch.num_rows:
                continue
            part = batch.slice(start, end - start)
            split = [v.marked(x) for x in part.column("text").to_pylist()]
            rows = np.cumsum([0, *map(len, split)])
            column = pa.array(chain.from_iterable(split), pa.large_string()).dictionary_encode()
            del split
            words = column.dictionary.to_pylist()
            if v.kept > KEPT_CHARACTERS // 2:  # however long a word is: a text in a script without spaces is one
                v.known, v.older, v.kept = {}, v.known, 0
            known, older = v.known, v.older
            new = [w for w in words if w not in known]
            v.kept += sum(map(len, new))
            known.update((w, older[w]) for w in new if w in older)
            known.update(v.encode_words([w for w in new if w not in older]))
            # taking the ids of each word in turn leaves those of the whole span side by side
            taken = pa.array([known[w] for w in words], pa.large_binary()).take(column.indices)
            data, ends = parts_of(taken)
            offsets = (ends[rows] // 4).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(data, "<i4")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids, pa.array(np.diff(offsets))], names=["doc_id", "text", "ids", "n_pieces"])
            start, size = end, 0
    # the worker lives on, beside other stages: it keeps pairs, but no words
    v.known, v.older, v.kept = {}, {}, 0
    give_back()


def decoded_batches(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """Batches with a list column ids and the further column decoded, a few rows at a time."""
    v = vocabulary(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            lists = part.column("ids")
            rows = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
            data, ends = parts_of(v.pieces.take(lists.flatten()))
            ends = ends[rows].tolist()
            texts = [data[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in pairwise(ends)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])


def parts_of(values: pa.LargeBinaryArray) -> tuple[bytes, np.ndarray]:
    """The bytes of a fresh array side by side, and where each value starts, with the end of the last."""
    _, ends, data = values.buffers()
    return data.to_pybytes() if data else b"", np.frombuffer(ends, "<i8")[: len(values) + 1] if ends else np.zeros(1, np.int64)


def encode(docs: DataFrame, model: str = MODEL, kind: str = "bpe") -> DataFrame:
    """doc_id, text, ids and n_pieces for every row of docs, as the model's own library would encode them.

    Words are told apart where a mark follows another character; no piece crosses that. The distinct
    words of a span of texts are sorted into a trie once, by the task that reads them, so nothing is shuffled, and a
    task keeps words of KEPT_CHARACTERS characters and a span beside. Null texts count as empty and have no pieces; characters
    outside the vocabulary become bytes. A mark that a text itself holds is read as a space. Null ids are carried;
    repeated rows repeat their result; an empty table gives an empty result.
    """
    return documents(docs).mapInArrow(lambda batches: encoded_batches(batches, model, kind), "doc_id long, text string, ids array<int>, n_pieces int")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with the further column decoded, the text of its column ids; null ids lists count as empty, nulls in them as nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lambda batches: decoded_batches(batches, model), schema + ", decoded string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces, the decoded text's SHA-256, and whether it equals the text (marks read as spaces).

    Encodes and decodes in one pass, so that texts go to Python once and don't come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in decoded_batches(encoded_batches(batches, model, "bpe"), model):
            texts, decoded = part.column("text").to_pylist(), part.column("decoded").to_pylist()
            digests = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())
            equal = pa.array([d == t.replace(MARK, " ") for d, t in zip(decoded, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "ids", "n_pieces")), digests, equal], names=["doc_id", "ids", "n_pieces", "decoded_sha256", "round_trip"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>, n_pieces int, decoded_sha256 string, round_trip boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
