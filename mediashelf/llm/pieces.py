"""SentencePiece encoding and decoding by a batched Viterbi search in numpy."""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
GRID = 4_000_000  # cells of one batch of equal-length words, at most
CACHE = 400_000  # words whose pieces a worker remembers,
SLOT_BITS = 19  # and as many pairs of pieces; slots of the table that is asked first
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
UNIGRAM, BPE = 1, 2


def _field_values(data: bytes) -> Iterator[tuple[int, int, object]]:
    """``(field, wire type, value)`` of a protobuf message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        tag = varint()
        if tag & 7 == 0:
            value: object = varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            value = data[at:at + size]
            at += size
        yield tag >> 3, tag & 7, value


def model_type(data: bytes) -> int:
    """UNIGRAM or BPE, from the trainer's settings in a model file."""
    for field, wire, value in _field_values(data):
        if field == 2 and wire == 2:
            for inner, _, kind in _field_values(value):
                if inner == 3:
                    return int(kind)
    return UNIGRAM


class _Pairs(dict):
    """Whether merging leaves two pieces side by side, worked out once for each pair met."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, pair: int) -> bool:
        if len(self) > self.pieces.remembered:
            self.clear()
        text, n = self.pieces.text, len(self.pieces.scores)
        a, b = text[pair // n], text[pair % n]
        value = self[pair] = self.pieces._merged(a + b) == [a, b]
        return value


class Pieces:
    """A model's pieces as sorted hashes, and the search for the best segmentation.

    A unigram model wants the segmentation with the highest sum of scores.  In a byte-pair
    model scores rank merges: there a segmentation is the model's own exactly if each pair of
    neighbours is what merging gives for the two put together, so pairs that merging would not
    leave side by side score minus infinity, and of each prefix one segmentation is left.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        p, self.kind = self.processor, model_type(model)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        normal = [i for i in range(p.vocab_size()) if not (
            p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.text = {i: p.id_to_piece(i) for i in normal}
        self.score = {i: p.get_score(i) for i in normal}
        self.id_of = {t: i for i, t in self.text.items()}
        self.byte_ids = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.unknown = p.unk_id()
        self.fallback = all(p.is_byte(int(i)) for i in self.byte_ids)
        self.unknown_score = min(self.score.values()) - 10.0
        self.longest = max(map(len, self.id_of), default=1)
        # words begin at a space mark; that cuts no piece if none goes on across one
        self.by_word = not any(SPACE in t.lstrip(SPACE) for t in self.id_of)
        usable = [t for t in self.id_of
                  if self.kind == UNIGRAM or self._merged(t) == [t]]
        self.keys, self.ids = {}, {}
        for size in range(1, self.longest + 1):
            same = [t for t in usable if len(t) == size]
            if same:
                points = np.array([[ord(c) for c in t] for t in same], dtype=np.uint64)
                keys = self._hash(points)
                order = np.argsort(keys)
                if len(np.unique(keys)) < len(keys):
                    raise ValueError("two pieces share a hash")
                self.keys[size] = keys[order]
                self.ids[size] = np.array([self.id_of[t] for t in same])[order]
        top = p.vocab_size()
        self.scores = np.zeros(top)
        self.scores[normal] = [self.score[i] for i in normal]
        self.allowed_keys = np.full(1 << SLOT_BITS, -1, dtype=np.int64)
        self.allowed = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.pairs = _Pairs(self)
        self.cache: dict[str, bytes] = {}
        self.remembered = CACHE
        self.spelling = [self._bytes_of(i) for i in range(top)]

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        value = np.zeros(points.shape[:-1], dtype=np.uint64)
        for i in range(points.shape[-1]):
            value = (value ^ points[..., i]) * _MULTIPLIER
            value ^= value >> np.uint64(29)
        return value

    def _merged(self, text: str) -> list[str]:
        """What merging the best-ranked neighbours, the leftmost of equals first, leaves."""
        parts, following = list(text), list(range(1, len(text) + 1))
        preceding, alive = list(range(-1, len(text) - 1)), [True] * len(text)
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = following[i]
            if j < len(parts) and (id_ := self.id_of.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-self.score[id_], i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = following[i] if alive[i] else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != joined:
                continue
            parts[i], alive[j], following[i] = joined, False, following[j]
            if following[j] < len(parts):
                preceding[following[j]] = i
            if preceding[i] >= 0:
                offer(preceding[i])
            offer(i)
        return [p for p, a in zip(parts, alive, strict=True) if a]

    def _side_by_side(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces as it is; ids of -1 merge with nothing."""
        result = np.ones(len(left), dtype=bool)
        merges = np.flatnonzero(left >= 0)
        pair = left[merges] * np.int64(len(self.scores)) + right[merges]
        slot = (pair.astype(np.uint64) * _MULTIPLIER >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        # answers given before, one for each slot; what is not there is looked up or worked out
        answer = self.allowed[slot]
        missing = np.flatnonzero(self.allowed_keys[slot] != pair)
        if len(missing):
            fresh, first, which = np.unique(pair[missing], return_index=True, return_inverse=True)
            found = np.fromiter(map(self.pairs.__getitem__, fresh.tolist()), bool, len(fresh))
            answer[missing] = found[which]
            self.allowed_keys[slot[missing[first]]] = fresh
            self.allowed[slot[missing[first]]] = found
        result[merges] = answer
        return result

    def _advance(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, as the bytes of 32-bit numbers."""
        n, size = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32
                               ).reshape(n, size).astype(np.uint64)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((n, size + 1), -2, dtype=np.int64)  # piece that ends here
        back = np.zeros((n, size + 1), dtype=np.int64)
        probes = {}
        for length in self.keys:
            if length <= size:
                windows = np.lib.stride_tricks.sliding_window_view(points, length, axis=1)
                keys = self._hash(windows)
                spot = np.minimum(np.searchsorted(self.keys[length], keys), len(self.keys[length]) - 1)
                probes[length] = np.where(self.keys[length][spot] == keys, self.ids[length][spot], -2)
        by_rank = self.kind == BPE
        for end in range(1, size + 1):
            value = np.full(n, -np.inf)
            piece, start = np.full(n, -1, dtype=np.int64), np.full(n, end - 1)
            single = np.ones(n, dtype=bool)  # no piece for the one character
            for k in sorted(probes, reverse=True):
                if k > end:
                    continue
                found = probes[k][:, end - k]
                fits = found >= 0
                if k == 1:
                    single = ~fits
                # where ranks decide, one piece fits at most, so a row that has it is done
                rows = np.flatnonzero(fits & (value == -np.inf) if by_rank else fits)
                if not len(rows):
                    continue
                ids, total = found[rows], best[rows, end - k]
                if not by_rank:
                    total = total + self.scores[ids]
                    better = total > value[rows]
                elif end > k:
                    better = self._side_by_side(last[rows, end - k], ids)
                else:
                    better = np.ones(len(rows), dtype=bool)
                rows = rows[better]
                value[rows], piece[rows], start[rows] = total[better], ids[better], end - k
            unknown = best[:, end - 1] + (0.0 if by_rank else self.unknown_score)
            rows = np.flatnonzero(single & (unknown > value))
            value[rows], piece[rows], start[rows] = unknown[rows], -1, end - 1
            best[:, end], last[:, end], back[:, end] = value, piece, start
        # backwards through all words at once; each fills its row from the right
        out, at, row = np.full((n, size), -2, dtype=np.int32), np.full(n, size), np.arange(n)
        step = size
        while len(row):
            step -= 1
            out[row, step] = last[row, at]
            at = back[row, at]
            going = at > 0
            row, at = row[going], at[going]
        begins, odd = (out == -2).sum(axis=1).tolist(), (out == -1).any(axis=1).tolist()
        return [
            self._spelled(words[w], out[w, begin:].tolist()) if rare else out[w, begin:].tobytes()
            for w, (begin, rare) in enumerate(zip(begins, odd, strict=True))]

    def _spelled(self, word: str, pieces: list[int]) -> bytes:
        """Ids of a word from its pieces, -1 being a character that no piece holds."""
        ids: list[int] = []
        at = 0
        for id_ in pieces:
            if id_ >= 0:
                ids.append(id_)
                at += len(self.text[id_])
                continue
            if self.fallback:
                ids += self.byte_ids[list(word[at].encode("utf-8", "surrogatepass"))].tolist()
            else:
                ids.append(self.unknown)
            at += 1
        return np.array(ids, dtype=np.int32).tobytes()

    def segment(self, words: list[str]) -> None:
        """Puts the pieces of distinct words into the cache, words of equal length together."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            # equal ranks occur among runs of space marks only; there merging itself decides
            if self.kind == BPE and SPACE + SPACE in w:
                self.cache[w] = self._spelled(w, [self.id_of.get(p, -1) for p in self._merged(w)])
            else:
                by_length.setdefault(len(w), []).append(w)
        for size, same in by_length.items():
            step = max(1, GRID // (size * (self.longest + 4)))
            for a in range(0, len(same), step):
                few = same[a:a + step]
                self.cache.update(zip(few, self._advance(few), strict=True))

    def words(self, text: str) -> list[str]:
        """A normalised text cut before every run of space marks."""
        normal = self.processor.normalize(text)
        if not self.by_word:
            return [normal] if normal else []
        parts = normal.split(SPACE)
        out, marks = [], 0
        if parts[0]:
            out.append(parts[0])
        for part in parts[1:]:
            marks += 1
            if part:
                out.append(SPACE * marks + part)
                marks = 0
        if marks:
            out.append(SPACE * marks)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the model's own library gives them."""
        cut = [self.words(t) for t in texts]
        if len(self.cache) > self.remembered:
            self.cache.clear()
        self.segment([w for w in {w for ws in cut for w in ws} if w not in self.cache])
        ids = [np.frombuffer(b"".join(map(self.cache.__getitem__, ws)), np.int32) for ws in cut]
        if self.fallback:
            return ids
        # neighbouring unknown characters are one piece
        u = self.unknown
        return [x[(x != u) | (np.append(-1, x[:-1]) != u)] for x in ids]

    def _bytes_of(self, id_: int) -> bytes:
        if id_ in self.text:
            return self.text[id_].replace(SPACE, " ").encode("utf-8", "surrogatepass")
        if self.processor.is_byte(id_):
            return bytes([int(self.processor.id_to_piece(id_)[3:5], 16)])
        return " ⁇ ".encode() if id_ == self.unknown else b""

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: pieces joined, bytes read as UTF-8, the mark before the text gone."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def _loaded(key: str, data: bytes) -> Pieces:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(data)
    return _LOADED[key]


def with_ids(docs: DataFrame, model_file: str = DEFAULT_MODEL, text: str = "text",
             ids: str = "ids", back: str | None = "decoded", remembered: int = CACHE,
             rows: int = 1_024) -> DataFrame:
    """``docs`` with the ids of every whole text and, if ``back`` names it, the text decoded
    from them again.  Columns named like the new ones are replaced.

    Null texts have null ids; empty ones none.  The model file is read once on the driver (its
    size does not grow with the data) and sent to the executors.  A worker remembers the pieces of
    ``remembered`` words, and as many pairs, and works on ``rows`` texts at a time.  Round trips are exact for
    models that normalise nothing, but for texts that begin with a space mark themselves.
    """
    with open(model_file, "rb") as file:
        data = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    key = f"{model_file}:{len(data)}:{os.path.getmtime(model_file)}"
    docs = docs.drop(*[c for c in (ids, back) if c and c != text])
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if back:
        schema.add(back, "string")

    names = schema.names

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(key, shared.value)
        pieces.remembered = remembered
        for part in parts:
            for a in range(0, part.num_rows, rows):
                few = part.slice(a, rows)
                texts = few.column(place).to_pylist()
                found = pieces.encode([t or "" for t in texts])
                null = np.array([t is None for t in texts], dtype=bool)
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                columns = [*few.columns, pa.ListArray.from_arrays(
                    pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(found)),
                    mask=pa.array(null))]
                if back:
                    columns.append(pa.array(
                        [None if t is None else pieces.decode(f)
                         for f, t in zip(found, texts, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(batches, schema)
