"""SentencePiece (BPE with byte fallback) encoding by suffix-array matching, and decoding.

The words of a batch are written one after another, each different one once, and the positions of that text
are sorted by what follows them, as far as the longest piece reaches. A binary search then gives every piece
its range of occurrences; sorted by position, they are its edges in the lattice over the text. Edges relax
piece by piece, best score first, which is the order in which the vocabulary's merges apply: an edge is taken
where it spans two neighbouring segments at that time. An edge is looked at once, so words of any length go
the same way. Characters without a piece become their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.common import map_columns, ship, slices

SPACE = "▁"
_UNKNOWN = 1  # the code of characters that no piece has; 0 parts words
#: How much text is a batch, and how many characters are indexed at once (a longer word goes whole).
BATCH_BYTES, AT_ONCE = 2_000_000, 250_000


class PieceCoder:
    def __init__(self, model_path: str, at_once: int = AT_ONCE):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.byte_ids = {int(pieces[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        single = {pieces[i]: i for i in plain if len(pieces[i]) == 1}
        several = sorted((i for i in plain if len(pieces[i]) > 1), key=lambda i: -model.get_score(i))
        self.codes = {c: k + 2 for k, c in enumerate(sorted({c for i in plain for c in pieces[i]}))}
        self.code_of = np.full(0x110000, _UNKNOWN, dtype=np.int64)
        self.code_of[[ord(c) for c in self.codes]] = list(self.codes.values())
        self.single_of = np.full(0x110000, -1, dtype=np.int64)
        self.single_of[[ord(c) for c in single]] = list(single.values())
        self.reach = max((len(pieces[i]) for i in several), default=1)
        self.piece_ids = np.array(several, dtype=np.int64)
        self.lengths = np.array([len(pieces[i]) for i in several], dtype=np.int64)
        self.above = self._above([pieces[i] for i in several])
        rows = np.zeros((len(several), self.reach), dtype=">u2")
        for row, i in zip(rows, several, strict=True):
            row[: len(pieces[i])] = [self.codes[c] for c in pieces[i]]
        self.low = self._keys(rows.copy())
        rows[rows == 0] = 0xFFFF
        self.high = self._keys(rows)
        # control characters that no piece has part words too
        apart = "".join(c for c in "\n\r\t" if c not in self.codes)
        self.word = re.compile(f"{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+" + (f"|[{apart}]" if apart else ""))
        self.as_bytes = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for b, i in self.byte_ids.items():
            self.as_bytes[i] = bytes([b])
        self.at_once = at_once

    @staticmethod
    def _above(pieces: list[str]) -> list[list[int]]:
        """For each rank those of the pieces that it is one of two parts of, in order."""
        rank = {p: r for r, p in enumerate(pieces)}
        out: list[list[int]] = [[] for _ in pieces]
        for p, r in rank.items():
            for k in range(1, len(p)):
                parts = [rank.get(x, -1 if len(x) == 1 else None) for x in (p[:k], p[k:])]
                if None not in parts:
                    for x in set(parts) - {-1}:
                        out[x].append(r)
        return out

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{2 * self.reach}").ravel()

    # ---- matching ----

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The positions in the order of what follows them, and each piece's first and last place in it."""
        n = len(codes)
        rank, span = codes, 1
        while span < self.reach:  # ranks by the first 1, 4, 16, ... codes
            wide = rank
            base = int(rank.max(initial=0)) + 2
            for k in (1, 2, 3):
                after = np.zeros(n, dtype=np.int64)
                after[: max(n - k * span, 0)] = rank[k * span :] + 1
                if base > 1 << 15 and k > 1:  # four ranks no longer fit into one number
                    wide = np.unique(wide, return_inverse=True)[1]
                wide = wide * base + after
            rank = np.unique(wide, return_inverse=True)[1]
            span *= 4
        order = np.argsort(rank, kind="stable")
        padded = np.concatenate([codes, np.zeros(self.reach, dtype=np.int64)]).astype(">u2")
        keys = self._keys(np.lib.stride_tricks.sliding_window_view(padded, self.reach)[order])
        return order, np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")

    # ---- relaxation ----

    def encode_words(self, words: list[str]) -> list[bytes]:
        text = "\0".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = self.code_of[points]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        codes[begins[1:] - 1] = 0
        order, first, last = self.occurrences(codes)
        n = len(codes)
        following = np.arange(1, n + 2)  # the next segment's start
        is_start = np.ones(n + 1, dtype=bool)
        ids = self.single_of[points]
        edges: dict[int, np.ndarray] = {}

        def relax(r: int) -> bool:
            start, size = edges[r], self.lengths[r]
            middle = following[start]
            end = start + size
            ready = is_start[start] & (middle < end)
            ready &= following[np.minimum(middle, n)] == end
            if not ready.any():
                return False
            start, middle = start[ready], middle[ready]
            if len(start) > 1 and int(np.diff(start).min()) < size:  # of edges that overlap, the left one
                keep, at = [], -1
                for k, s in enumerate(start.tolist()):
                    if s >= at:
                        keep.append(k)
                        at = s + size
                start, middle = start[keep], middle[keep]
            following[start] = start + size
            is_start[middle] = False
            ids[start] = self.piece_ids[r]
            return True

        for r in np.flatnonzero(last > first).tolist():
            edges[r] = np.sort(order[first[r] : last[r]])
            again = [r]
            while again:  # a piece can make way for one with a better score that was looked at before
                q = heapq.heappop(again)
                if relax(q):
                    for p in self.above[q]:
                        if p > r:
                            break
                        if p in edges and p not in again:
                            heapq.heappush(again, p)
        heads = np.flatnonzero(is_start[:n] & (codes > 0))
        got = ids[heads]
        cut, stop = np.searchsorted(heads, begins).tolist(), np.searchsorted(heads, begins + sizes).tolist()
        blob = got.astype("<u4").tobytes()
        out = [blob[4 * i : 4 * j] for i, j in zip(cut, stop, strict=True)]
        for k in np.unique(np.searchsorted(begins, heads[got < 0], "right") - 1).tolist():  # words that need bytes
            mine = range(cut[k], stop[k])
            plain = [j for i in mine for j in ([int(got[i])] if got[i] >= 0 else self._fallback(text[heads[i]]))]
            out[k] = np.array(plain, dtype="<u4").tobytes()
        return out

    def _fallback(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]

    # ---- texts ----

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes."""
        split = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        ids: dict[str, bytes] = {}
        part: list[str] = []
        size = 0
        for w in set().union(*split):
            part.append(w)
            size += len(w) + 1
            if size >= self.at_once:
                ids.update(zip(part, self.encode_words(part), strict=True))
                part, size = [], 0
        if part:
            ids.update(zip(part, self.encode_words(part), strict=True))
        return [b"".join(map(ids.__getitem__, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.as_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def coder(model_path: str) -> PieceCoder:
    """One for each Python worker."""
    return PieceCoder(model_path)


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _with_column(rows: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, source: str, make) -> DataFrame:
    """rows and one more column, made of the one named `source`; a column of that name is replaced."""
    ship(rows.sparkSession)
    rows = rows.drop(name)
    at, at_end = rows.columns.index(source), len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(make(b.column(at).to_pylist()), arrow)], names=[f"c{i}" for i in range(at_end + 1)])

    return map_columns(rows, run, [T.StructField(name, kind)])


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """docs (with a column text) and ids: little-endian unsigned 32-bit numbers; none for an empty or null text.

    A column ids of docs is replaced; all others stay. Repeated rows are encoded like any other; an empty
    table gives none.
    """
    path = model_path or default_model_path()
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return _with_column(docs, "ids", T.BinaryType(), pa.binary(), "text", lambda texts: coder(path).encode([t or "" for t in texts]))


def decode_documents(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """rows (with a column ids) and decoded: their texts; '' for null ids. A column decoded of rows is replaced."""
    path = model_path or default_model_path()
    return _with_column(rows, "decoded", T.StringType(), pa.string(), "ids", lambda ids: [coder(path).decode(i or b"") for i in ids])


def round_trips(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and round_trip: whether decoding gives the text back (null counts as empty)."""
    rows = decode_documents(encode_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model_path), model_path)
    return rows.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))
