"""SentencePiece byte-pair encoding by a prefix table, and its decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Segments kept with their ids in each of a Python worker's two generations, the longest that are kept, and token pairs.
_CACHE, _CACHED_CHARS, _PAIRS = 400_000, 48, 600_000


class Codec:
    """Encoder and decoder of a merge-type model with byte fallback and an identity normaliser.

    For every prefix of a segment the table stores the one token that the prefix's encoding ends with. The
    candidates are the automaton's matches that end there; a candidate holds if it and the last token of the
    prefix before it stay apart when they are merged alone. Ids are then read backwards from the end.
    """

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a merge-type model with an identity normaliser is needed")
        kinds = model.SentencePiece
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.bytes = {i: int(p.piece[1:-1], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.end = self.pieces.index("</s>")
        self._plain = {i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.prefix = MARK if spec.add_dummy_prefix else ""
        usable = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.rank = {piece: rank for piece, (rank, _) in usable.items()}
        self.ids = {piece: i for piece, (_, i) in usable.items()}
        self._automaton = ahocorasick.Automaton()
        for piece in usable:
            if len(piece) == 1 or self._merge(piece) == [piece]:
                self._automaton.add_word(piece, piece)
        self._automaton.make_automaton()
        # Where no piece has a character pair, a text falls apart between the two: in front of marks, behind
        # Latin letters and around characters that no piece has, if the vocabulary allows it.
        self._apart = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in usable)
        fine = not any(re.search(f"[{_LATIN}][^{_LATIN}{MARK}]", piece) for piece in usable)
        used = set().union(*usable)
        alone = "".join(c for c in "\n\t\r" if c not in used)
        other = f"[^{_LATIN}{MARK}{alone}]"
        latin = f"{MARK}*{other}*[{_LATIN}]+|{MARK}*{other}+|{MARK}+" + (f"|[{alone}]" if alone else "")
        self._segment = re.compile(latin if fine else f"{MARK}*[^{MARK}]+|{MARK}+")
        self._compatible: dict[tuple[str, str], bool] = {}
        self._known: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._odd: dict[str, str] = {}

    def _merge(self, text: str) -> list[str]:
        """Merge the best adjacent pair, leftmost first, until none is a piece: for single tokens and pairs of them."""
        parts, rank = list(text), self.rank
        while True:
            found = [(rank[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in rank]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _pair(self, left: str, right: str) -> bool:
        known = self._compatible.get((left, right))
        if known is None:
            if len(self._compatible) >= _PAIRS:
                self._compatible.clear()
            known = self._compatible[left, right] = self._merge(left + right) == [left, right]
        return known

    def tokens(self, text: str) -> list[str]:
        """Pieces of a marked text; characters that no piece has stand by themselves."""
        table: list[str] = list(text)
        done, known = -1, self._compatible
        for last, piece in self._automaton.iter(text):  # by their ends, the longest first
            if last == done:
                continue
            before = last - len(piece)
            if before >= 0:
                pair = (table[before], piece)
                fits = known.get(pair)
                if not (self._pair(*pair) if fits is None else fits):
                    continue
            table[last] = piece
            done = last
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(table[at])
            at -= len(table[at])
        return out[::-1]

    def _ids(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.tokens(text):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            else:
                out.extend(self.byte_ids[b] for b in piece.encode())
        return out

    def _segments(self, text: str) -> list[str]:
        marked = self.prefix + text.replace(" ", MARK)
        return self._segment.findall(marked) if self._apart else [marked]

    def encode(self, text: str, end: bool = True) -> list[int]:
        out = [i for s in (self._segments(text) if text else []) for i in self._ids(s)]
        return out + [self.end] if end else out

    def _raw(self, ids: list[int]) -> str:
        """Text of the ids with marks still in it."""
        if self._plain.issuperset(ids):
            return "".join([self.pieces[i] for i in ids])
        out, pending = [], bytearray()
        for i in [*ids, None]:
            if i in self.bytes:
                pending.append(self.bytes[i])
                continue
            if pending:
                out.append(_utf8(bytes(pending)))
                pending.clear()
            if i is not None and i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        raw = self._raw(ids)
        return raw.removeprefix(self.prefix).replace(MARK, " ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, sha256 of the ids, sha256 of the decoded text."""
        segments = self._segments(text) if text else []
        found = list(map(self._known.get, segments))
        if None in found:
            found = [self._look(s) if f is None else f for s, f in zip(segments, found)]
        ids = " ".join([*found, str(self.end)])
        raw = "".join([self._odd.get(s, s) for s in segments] if self._odd else segments)
        decoded = raw.removeprefix(self.prefix).replace(MARK, " ")
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def _look(self, segment: str) -> str:
        """Ids of a segment that isn't in the newer generation; where they decode to something else, that is noted."""
        ids = self._known.get(segment) or self._older.get(segment)
        if ids is None:
            own = self._ids(segment)
            ids, raw = " ".join(map(str, own)), self._raw(own)
            if raw != segment:
                self._odd[segment] = raw
        if len(segment) <= _CACHED_CHARS:
            if len(self._known) >= _CACHE:
                self._older, self._known = self._known, {}
            self._known[segment] = ids
        return ids


def _utf8(data: bytes) -> str:
    """Each byte that starts no whole character becomes one replacement character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """The codec of a model, built once in a Python worker."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """Rows with ``ids``: the whole text's ids with the end id. Null counts as empty: the end id only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = pa.array([own.encode(t or "") for t in part["text"].to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """Rows with ``text``: the library's decoding of the column ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            text = pa.array([own.decode(i or []) for i in batch["ids"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], text], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, decoded and digested in one pass.

    A segment seen before in the worker is looked up (ids, count, decoded text), so the work follows the
    distinct segments. Null and empty texts have the end id only and decode to ""; repeated rows keep their
    rows; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                n, ids, decoded = zip(*(own.digest(t or "") for t in part["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
