"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a public model file, whose path is a parameter; a tokenizer is never trained
here. The file at hand holds merge ranks as scores and no counts, so a piece's log score is what
Zipf's law gives its rank, -log(rank + 1), normalised: log probabilities of a stated distribution
over the file's ranking, not likelihoods fitted to a corpus. The best path is the one of greatest summed log score; a character that
is no piece by itself may also be spelled in byte pieces, at ten below the least log score.
Spaces become the marker U+2581, one more stands before the text. A marker that is in the text
already is spelled in bytes, and a text decodes to exactly what it was.

No piece has a marker after another character, nor a newline, so the best path of a text is made
of the best paths of its units: runs of markers with what follows up to the next one, and newlines.
Each worker remembers the paths of units it has met, up to a bound.

Defined cases: of paths of equal score the one whose last piece begins first is taken, and so on
towards the beginning; a null text has null ids; an empty text has no ids; very long texts are encoded
whole; repeated rows are encoded alike; an empty table gives an empty result. Other columns are
ignored by ``encode_documents``.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Units of which a worker remembers the path, and their greatest length in characters.
REMEMBERED, LONGEST = 400_000, 64
ROWS_OUT = 256
OUT_SCHEMA = "doc_id bigint, ids array<int>, n_tokens bigint, n_byte_tokens bigint, decoded_sha256 string, round_trip boolean"


class DoubleArrayTrie:
    """Byte strings to values: a node at p has its child by byte b at base[p] + b + 1, where check holds p."""

    def __init__(self, entries: dict[bytes, int]):
        tree: dict = {}
        for key, value in entries.items():
            node = tree
            for b in key:
                node = node.setdefault(b + 1, {})
            node[0] = value
        base, check, self.value = [0], [0], [-1]
        used = [True]
        one = many = top = 1
        queue = [(0, tree)]
        for at, node in queue:
            labels = sorted(k for k in node if k)
            if 0 in node:
                self.value[at] = node[0]
            if not labels:
                continue
            # Only children fill the gaps from the left; families search a short way, then begin where nothing is used.
            while one < len(used) and used[one]:
                one += 1
            start = max(1, (one if len(labels) == 1 else many) - labels[0])
            tries = 0
            while any(start + k < len(used) and used[start + k] for k in labels):
                start, tries = start + 1, tries + 1
                if tries == 60:
                    start = many = max(1, top - labels[0])
            grow = start + 257 - len(used)
            if grow > 0:
                base += [0] * grow
                check += [-1] * grow
                self.value += [-1] * grow
                used += [False] * grow
            base[at] = start
            top = max(top, start + labels[-1] + 1)
            for k in labels:
                check[start + k], used[start + k] = at, True
                queue.append((start + k, node[k]))
        self.base, self.check = base, check


class Codec:
    """The pieces of a model with log scores."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """``kinds``: piece, byte or other (control and unknown) for each id."""
        plain = [i for i, k in enumerate(kinds) if k == "piece"]
        if any(re.search(f"[^{MARK}]{MARK}|\n", pieces[i]) for i in plain):
            raise ValueError("a piece holds a newline, or a marker after another character")
        self.scores = scores
        self.trie = DoubleArrayTrie({pieces[i].encode(): i for i in plain})
        self.bytes = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "byte"}
        self.fallback = min(scores[i] for i in plain) - 10.0
        self.spelling = [b""] * len(pieces)
        for i in plain:
            self.spelling[i] = pieces[i].replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.spelling[i] = bytes([b])
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.paths: dict[str, bytes] = {}

    def viterbi(self, unit: str) -> list[int]:
        data = unit.encode()
        n = len(data)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        scores = self.scores
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        size = len(check)
        at = 0
        while at < n:
            first = data[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, single = best[at], False
            # The trie is walked in place: this loop is all of an encoder's time.
            node, end = 0, at
            while end < n:
                child = base[node] + data[end] + 1
                if child >= size or check[child] != node:
                    break
                node, end = child, end + 1
                i = value[node]
                if i >= 0:
                    if end == at + width:
                        single = True
                    total = here + scores[i]
                    if total > best[end]:
                        best[end], back[end], piece[end] = total, at, i
            if not single and here + self.fallback > best[at + width]:
                best[at + width], back[at + width], piece[at + width] = here + self.fallback, at, -1
            at += width
        path: list[int] = []
        at = n
        while at:
            begin = back[at]
            path += [piece[at]] if piece[at] >= 0 else [self.bytes[b] for b in reversed(data[begin:at])]
            at = begin
        return path[::-1]

    def _units(self, marked: str) -> list[bytes]:
        out = []
        paths = self.paths
        for unit in UNIT.findall(marked):
            ids = paths.get(unit)
            if ids is None:
                ids = np.array(self.viterbi(unit), dtype="<i4").tobytes()
                if len(unit) <= LONGEST:
                    if len(paths) >= REMEMBERED:
                        paths.clear()
                    paths[unit] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids as int32."""
        if not text:
            return np.empty(0, dtype="<i4")
        literal = np.array([self.bytes[b] for b in MARK.encode()], dtype="<i4").tobytes()
        out: list[bytes] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(literal)
            out += self._units((MARK if k == 0 else "") + part.replace(" ", MARK))
        return np.frombuffer(b"".join(out), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        spelling = self.spelling
        return b"".join([spelling[i] for i in ids.tolist()])[1:].decode()


def read_model(path: str = MODEL) -> tuple[list[str], list[float], list[str]]:
    """Pieces, log scores and kinds of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece" for i in ids]
    ranked = sorted((i for i in ids if kinds[i] == "piece"), key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1.0 / (r + 1) for r in range(len(ranked))))
    scores = [0.0] * len(kinds)
    for rank, i in enumerate(ranked):
        scores[i] = -math.log(rank + 1) - total
    return [model.id_to_piece(i) for i in ids], scores, kinds


_codecs: dict[str, Codec] = {}


def _codec(key: str, model) -> Codec:
    """The worker's copy of a broadcast codec, which remembers paths from task to task."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = model.value
    return _codecs[key]


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, decoded_sha256, round_trip for every row of ``docs``.

    The driver reads the model and sends the trie of its pieces, a fixed 32,000; executors need no such file.
    """
    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast(Codec(*read_model(model))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, sent)
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(begin, ROWS_OUT)
                ids, digests, same = [], [], []
                for text in batch.column("text").to_pylist():
                    if text is None:
                        ids.append(None), digests.append(None), same.append(None)
                        continue
                    own = codec.encode(text)
                    back = codec.decode(own)
                    ids.append(own), digests.append(hashlib.sha256(back.encode()).hexdigest()), same.append(back == text)
                sizes = [0 if x is None else len(x) for x in ids]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"))
                values = np.concatenate([np.empty(0, "i4"), *[x for x in ids if x is not None]]).astype("i4")
                gone = np.array([x is None for x in ids])
                listed = pa.ListArray.from_arrays(offsets, pa.array(values), mask=pa.array(gone))
                n_bytes = [None if x is None else int(codec.is_byte[x].sum()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), listed, pa.array([None if g else n for g, n in zip(gone, sizes, strict=True)], pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "n_byte_tokens", "decoded_sha256", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, OUT_SCHEMA)
