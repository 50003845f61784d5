"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model's pieces, scores and flags are read from its file; the merging is done
here.  A text is escaped (dummy prefix, spaces as U+2581) and cut where no piece
can reach across: before a U+2581 that follows another character, and around line
ends.  All unknown segments of a slice are laid out as one flat symbol array; each
round looks up the rank of every adjacent pair, takes the smallest rank of each
segment by a segmented minimum, merges its leftmost occurrences at once and
compacts the array, until no pair is left.  Occurrences are merged together only
if no pair they create ranks as well as the one merged; otherwise the leftmost
alone is, which keeps the library's order exactly.

Edge cases: a null or empty text has only the end id and decodes to an empty text;
characters without a piece become UTF-8 byte pieces; texts of any length are
encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import map_slices
from .wordcache import WordCache

SPACE = "▁"
_SEGMENT = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_NONE = np.int64(1 << 40)


class PieceModel:
    """Tables of a BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        pieces = model.pieces
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("pieces reach across words")
        if any(p.type == 4 for p in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.size = len(pieces)
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.surface: list[bytes] = []
        self.end_id = next((i for i, p in enumerate(pieces) if p.piece == "</s>"), 2)
        for i, p in enumerate(pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.surface.append(p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"")
        self.chars = {p: i for p, i in normal.items() if len(p) == 1}
        # Every way to put a piece together from two symbols.  A single character that is no
        # piece never merges, so both halves are pieces.
        scores = sorted({pieces[i].score for i in normal.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        keys, made = [], []
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = normal.get(piece[:k]), normal.get(piece[k:])
                a = self._extra(piece[:k]) if a is None and k == 1 else a
                b = self._extra(piece[k:]) if b is None and len(piece) - k == 1 else b
                if a is not None and b is not None:
                    keys.append((a << 24) | b)
                    made.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        by_piece = np.full(self.size, _NONE, dtype=np.int64)
        for i in normal.values():
            by_piece[i] = rank[pieces[i].score]
        self.ranks = by_piece[self.made]

    def _extra(self, char: str) -> int:
        """A symbol id outside the vocabulary for a character that has no piece."""
        return 1 << 21 | ord(char) if ord(char) >= 0 else 0

    def symbol(self, char: str) -> int:
        found = self.chars.get(char)
        return self._extra(char) if found is None else found

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of adjacent symbols; rank is _NONE where they make no piece."""
        key = (left << 24) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def encode_segments(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of each segment, by merge rounds over all of them at once."""
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)
        distinct, back = np.unique(codes, return_inverse=True)
        symbols = np.array([self.symbol(chr(c)) for c in distinct], dtype=np.int64)[back]
        segment = np.repeat(np.arange(len(segments)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, piece = np.full(len(symbols), _NONE, dtype=np.int64), np.zeros(len(symbols), dtype=np.int64)
        self._look(np.arange(len(symbols)), symbols, segment, rank, piece)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = least == _NONE
            if over.any():  # finished segments leave the array
                done.append((segment[over], symbols[over]))
                keep = ~over
                symbols, segment, rank, piece, least = (x[keep] for x in (symbols, segment, rank, piece, least))
                if not len(symbols):
                    break
            at = self._leftmost(np.flatnonzero(rank == least), symbols, segment, piece, rank)
            symbols[at] = piece[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, segment, rank, piece = symbols[keep], segment[keep], rank[keep], piece[keep]
            now = at - np.arange(len(at))  # where the merged symbols stand after compaction
            self._look(np.r_[now, np.maximum(now - 1, 0)], symbols, segment, rank, piece)
        if not done:
            return []
        segment, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(segment, kind="stable")
        segment, symbols = segment[order], symbols[order]
        segment, symbols = self._bytes(segment, symbols)
        return np.split(symbols, np.searchsorted(segment, np.arange(1, len(segments))))

    def _look(self, at, symbols, segment, rank, piece) -> None:
        """Refresh rank and piece of the pairs that begin at ``at``."""
        rank[at] = _NONE
        at = at[at < len(symbols) - 1]
        at = at[segment[at] == segment[at + 1]]
        rank[at], piece[at] = self.lookup(symbols[at], symbols[at + 1])

    def _leftmost(self, at, symbols, segment, piece, rank) -> np.ndarray:
        """Occurrences to merge now: non-overlapping from the left, or the first alone."""
        # Alternate occurrences within runs of consecutive indices.
        run = np.cumsum(np.r_[True, np.diff(at) != 1])
        begin = np.searchsorted(run, run, side="left")
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        first = np.r_[True, segment[at[1:]] != segment[at[:-1]]]
        if first.all():
            return at
        # What stands beside each merged symbol afterwards: a neighbour, itself merged or not.
        merged, after = symbols.copy(), np.arange(1, len(symbols) + 1)
        merged[at] = piece[at]
        gone = np.zeros(len(symbols) + 1, dtype=bool)
        gone[at + 1] = True
        after[at] = at + 2
        last = len(symbols) - 1
        right = np.minimum(after[at], last)
        right_ok = (after[at] <= last) & (segment[right] == segment[at])
        left = np.maximum(at - 1, 0)
        left = np.where(gone[left], np.maximum(left - 1, 0), left)
        left_ok = (at > 0) & (segment[left] == segment[at]) & (left < at)
        better = np.zeros(len(at), dtype=bool)
        for other, ok, flip in ((right, right_ok, False), (left, left_ok, True)):
            for beside in (merged[other], symbols[other]):  # merged or still as it was
                a, b = (beside, piece[at]) if flip else (piece[at], beside)
                better |= ok & (self.lookup(a, b)[0] <= rank[at])
        unsafe = np.zeros(int(segment[-1]) + 1, dtype=bool)
        unsafe[segment[at[better]]] = True
        return at[first | ~unsafe[segment[at]]]

    def _bytes(self, segment: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their UTF-8 bytes."""
        odd = np.flatnonzero(symbols >= 1 << 21)
        if not len(odd):
            return segment, symbols
        spelled = [chr(c).encode() for c in (symbols[odd] & ((1 << 21) - 1)).tolist()]
        sizes = np.ones(len(symbols), dtype=np.int64)
        sizes[odd] = [len(s) for s in spelled]
        out, where = np.repeat(symbols, sizes), np.cumsum(sizes) - sizes
        for k in range(4):
            has = odd[sizes[odd] > k]
            out[where[has] + k] = self.byte_id[[s[k] for s in spelled if len(s) > k]]
        return np.repeat(segment, sizes), out


def segments(text: str) -> list[str]:
    """The escaped text, cut where no piece reaches across."""
    return _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Codec:
    """Encodes and decodes whole texts; distinct segments are merged once per process."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.cache = WordCache(self._encode, limit=500_000)

    def _encode(self, new: list[str]) -> list[tuple[str, int, bytes]]:
        out, names, surface = [], list(map(str, range(self.model.size))), self.model.surface
        for at in range(0, len(new), 20_000):
            for ids in self.model.encode_segments(new[at : at + 20_000]):
                listed = ids.tolist()
                out.append((" ".join([names[i] for i in listed]), len(listed), b"".join([surface[i] for i in listed])))
        return out

    def encode_all(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """(ids in decimal joined by spaces, their number, decoded UTF-8) of each text, with the end id."""
        cut = [segments(t) for t in texts]
        known, end = self.cache.ensure(set().union(*cut)), str(self.model.end_id)
        for parts in cut:
            found = [known[p] for p in parts]
            decoded = b"".join([f[2] for f in found])
            ids = " ".join([f[0] for f in found] + [end])
            yield ids, sum([f[1] for f in found]) + 1, decoded[1:] if decoded[:1] == b" " else decoded


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model_path: str, keep_text: bool = False) -> DataFrame:
    """Per document: ids and decoded text.

    Returns doc_id, n_tokens, ids (array of int, end id included) and decoded if
    ``keep_text``, else the digests ids_sha256 and decoded_sha256.  Narrow: no shuffle.
    """
    schema = "doc_id long, n_tokens long, " + (
        "ids array<int>, decoded string" if keep_text else "ids_sha256 string, decoded_sha256 string"
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(codec(model_path).encode_all([t or "" for t in batch.column("text").to_pylist()]))
        decoded = [f[2].decode("utf-8", "replace") for f in found]
        columns = [batch.column("doc_id"), pa.array([f[1] for f in found], pa.int64())]
        if keep_text:
            columns += [pa.array([list(map(int, f[0].split())) for f in found], pa.list_(pa.int32())), pa.array(decoded)]
        else:
            columns += [
                pa.array([hashlib.sha256(f[0].encode()).hexdigest() for f in found]),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
            ]
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_slices(docs.select("doc_id", "text"), run, schema)
