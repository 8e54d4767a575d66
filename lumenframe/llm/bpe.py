"""Byte-level BPE encoding and decoding in numpy, for rank files of the tiktoken kind.

Texts are cut by the pre-tokenizer pattern. The distinct pieces of a batch that are not known yet are put into
matrices by length, one piece a row, padded to the bucket's width. In each round every row merges its leftmost pair
of minimum rank: pair ranks come from an open-addressing hash table of (left id, right id), rows without a pair leave
the matrix and the others close up by one column. Pieces above LONG bytes (rare: unbroken runs) would make such a
matrix quadratic; they are merged in the same order with a heap over a linked list.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import small_batches

LONG = 512
NONE = np.int32(2**31 - 1)
#: Cells of one matrix, and pieces that a worker remembers.
CELLS, MEMORY = 1 << 18, 400_000
#: Text that a worker turns into one output batch.
BATCH_BYTES = 4 << 20


class BytePairTables:
    """Ranks of a vocabulary as arrays: ids of single bytes, a hash table of mergeable pairs, and all tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array([p for p, _ in pairs], dtype=np.uint64), np.array([r for _, r in pairs], dtype=np.int32)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, NONE, dtype=np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[left][free], return_index=True)
            won = left[free][first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merged token, NONE where the pair does not merge."""
        shape = left.shape
        keys = (left.ravel().astype(np.uint64) << np.uint64(32)) | right.ravel().astype(np.uint64)
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out.reshape(shape)

    def merge_rows(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges pieces, one a row of bytes padded to the same width; returns padded ids and the rows' new lengths."""
        n, width = raw.shape
        ids, rows = self.byte_ids[raw], np.arange(n)
        out, out_lengths = np.empty((n, width), np.int32), lengths.copy()
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        ranks[np.arange(width - 1)[None, :] >= (lengths - 1)[:, None]] = NONE
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
            else:
                at, best = np.zeros(len(rows), np.int64), np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                gone = rows[done]
                out[gone, : ids.shape[1]], out_lengths[gone] = ids[done], lengths[done]
                live = ~done
                ids, ranks, rows, lengths, at, best = ids[live], ranks[live], rows[live], lengths[live], at[live], best[live]
                if not len(rows):
                    break
            r = np.arange(len(rows))
            ids[r, at] = best
            lengths = lengths - 1
            width = int(lengths.max())
            kept = np.arange(width)[None, :]
            ids = np.where(kept <= at[:, None], ids[:, :width], ids[:, 1 : width + 1])
            if width > 1:
                kept = kept[:, :-1]
                ranks = np.where(kept < at[:, None], ranks[:, : width - 1], ranks[:, 1:width])
                for j in (at - 1, at):  # only the merged token's two neighbours have new pairs
                    ok = np.flatnonzero((j >= 0) & (j < lengths - 1))
                    ranks[ok, j[ok]] = self.pair_ranks(ids[ok, j[ok]], ids[ok, j[ok] + 1])
            else:
                ranks = ranks[:, :0]
        return out, out_lengths

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece: lowest rank first, leftmost first among equals."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                pair = (ids[i], ids[after[i]])
                if pair not in known:
                    known[pair] = int(self.pair_ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
                if known[pair] != NONE:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian u32) of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        for k in np.flatnonzero(lengths > LONG).tolist():
            out[k] = self.merge_long(pieces[k])
        # Buckets: every length up to 12, then powers of two.
        bucket = np.where(lengths <= 12, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for width in np.unique(bucket[(lengths > 0) & (lengths <= LONG)]).tolist():
            own = np.flatnonzero((bucket == width) & (lengths <= LONG))
            step = max(1, CELLS // width)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                cells = np.arange(width)[None, :]
                raw = flat[np.minimum(starts[part][:, None] + cells, len(flat) - 1)]
                ids, n = self.merge_rows(raw, lengths[part]) if width > 1 else (self.byte_ids[raw], lengths[part])
                joined = ids[cells < n[:, None]].astype("<u4").tobytes()
                ends = (np.cumsum(n) * 4).tolist()
                for k, a, b in zip(part.tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[k] = joined[a:b]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens one after the other."""
        own = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(own):
            return b""
        lengths = self.lengths[own]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[own] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()


#: White_Space below U+0250, and the letters there; both are the same in all Unicode versions.
LATIN_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
LATIN_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"


class BytePairEncoder:
    """Encodes texts piece by piece and remembers pieces, up to MEMORY of them."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.tables = BytePairTables(read_ranks(vocabulary))
        # In this library \s also matches U+001C to U+001F, which are not white space by Unicode.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # The same pattern for texts of Latin characters without number signs above ASCII, in the faster standard library.
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_SPACE}{LATIN_LETTER}0-9]").replace(r"\p{L}", f"[{LATIN_LETTER}]").replace(r"\p{N}", "[0-9]").replace(r"\s", f"[{LATIN_SPACE}]").replace(r"\S", f"[^{LATIN_SPACE}]")
        # Patterns with other classes of these kinds have no such form here.
        self.latin = None if r"\p" in latin or re.search(r"\[[^\]]*\\[psS]", pattern.replace(r"[^\s\p{L}\p{N}]", "")) else re.compile(latin)
        self.beyond = re.compile(r"[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.latin is not None and (text.isascii() or not self.beyond.search(text)):
            return self.latin.findall(text)
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the new pieces of all texts are merged together, so that matrices are full."""
        cut = [self.pieces(t) for t in texts]
        new: set[str] = set()
        for own in cut:
            new.update(own)
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
        new.difference_update(self.known)
        todo = list(new)
        for i in range(0, len(todo), 100_000):
            part = todo[i : i + 100_000]
            self.known.update(zip(part, self.tables.encode_pieces([p.encode("utf-8") for p in part]), strict=True))
        look = self.known.__getitem__
        return [b"".join(map(look, own)) for own in cut]


def read_ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}


_ENCODERS: dict[int, BytePairEncoder] = {}


def encoder(vocabulary: bytes, pattern: str) -> BytePairEncoder:
    """One encoder a worker process and vocabulary."""
    key = hash((vocabulary, pattern))
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(vocabulary, pattern)
    return _ENCODERS[key]


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (token ids as little-endian u32) and decoded (the ids' bytes).

    vocabulary_path is a rank file that the driver reads and broadcasts (about a megabyte). Null counts as empty;
    an empty text has no ids. Texts of any length are encoded whole; repeated rows give equal rows; an empty table
    gives none. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size < BATCH_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                part = [t or "" for t in texts[start:end]]
                ids = own.encode(part)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(start, end - start), pa.array(ids, pa.binary()), pa.array([own.tables.decode(x) for x in ids], pa.binary())], schema=schema)
                start = end

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
