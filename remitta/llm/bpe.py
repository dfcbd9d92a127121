"""Byte-level BPE encoding and decoding as a monoid reduction over a tree.

A piece (one match of the pattern) is cut into halves until a half is a token itself; neighbouring encodings are
joined. Two encodings join by concatenation if the two tokens that meet are stable: if the encoding of their joined
bytes is these two tokens. If not, a window of tokens around the border is encoded again and grows on each side
until the token outside and the first (last) token inside are stable, or nothing is left outside. A token sequence
whose neighbours are all stable is the encoding of its bytes, so tokens outside the window can't change. Decoding
joins the tokens' bytes up the same kind of tree.

Defined cases: null and empty texts have no tokens (digests of no bytes). A text or piece of any length is encoded
whole. Repeated rows get equal results, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.llm.common import binary_texts, id_text, slices

#: Pieces, pairs of tokens and short runs of bytes that a task remembers; a full memory is emptied.
MEMORY, SHORT_MEMORY, SHORT, HALF = 250_000, 60_000, 16, 8


class _Pieces(dict):
    """Piece -> its ids as bytes, worked out when first asked for."""

    def __init__(self, coder: TreeBPE):
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.coder.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {r: b for b, r in ranks.items()}
        self.vocab = [self.bytes_of.get(i, b"") for i in range(max(ranks.values(), default=-1) + 1)]
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self)
        self.halves: dict[bytes, list[int]] = {}
        self.windows: dict[bytes, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by definition: the pair of the least rank is merged first, the leftmost of equal ones."""
        if len(data) <= SHORT:
            known = self.windows.get(data)
            if known is None:
                if len(self.windows) >= SHORT_MEMORY:
                    self.windows.clear()
                known = self.windows[data] = self._merged_short(data)
            return known
        n, ranks = len(data), self.ranks
        parts = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, whole = heapq.heappop(queue)
            j = after[i] if parts[i] else n
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != len(whole) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(new := whole + parts[after[j]])) is not None:
                    heapq.heappush(queue, (r, i, new))
            if (h := before[i]) >= 0 and (r := ranks.get(new := parts[h] + whole)) is not None:
                heapq.heappush(queue, (r, h, new))
        return [ranks[p] for p in parts if p]

    def _merged_short(self, data: bytes) -> list[int]:
        """The same without a queue."""
        get, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        of = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(of):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del of[at]
            if at < len(of):
                of[at] = get(parts[at] + parts[at + 1])
            if at:
                of[at - 1] = get(parts[at - 1] + parts[at])

    def stable(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.vocab[a] + self.vocab[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join([self.vocab[t] for t in left[len(left) - i :] + right[:j]]))
            ok_left = i >= len(left) or self.stable(left[-i - 1], window[0])
            ok_right = j >= len(right) or self.stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            i = i if ok_left else min(2 * i, len(left))
            j = j if ok_right else min(2 * j, len(right))

    def encode_piece(self, data: bytes) -> list[int]:
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        short = len(data) <= HALF
        if short and (ids := self.halves.get(data)) is not None:
            return ids
        half = len(data) // 2
        ids = self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))
        if short:
            if len(self.halves) >= SHORT_MEMORY:
                self.halves.clear()
            self.halves[data] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, self.pattern.findall(text))), np.uint32)
        return ids if sys.byteorder == "little" else ids.astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= 4096:
            vocab = self.vocab
            return b"".join([vocab[i] for i in ids.tolist()])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(2)
def installed(name: str) -> TreeBPE:
    """The tokenizer of an installed vocabulary; every executor has the files."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return TreeBPE(read_ranks(f.read()), public_tokenizers.PATTERN)


def bpe(spark: SparkSession, docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip (decoded bytes are the text's), and the ids if asked for; one row per row of docs."""
    rows = id_text(docs, id_col, text_col)

    def run(batches):
        coder = installed(vocabulary)
        for batch in slices(batches):
            out = []
            for data in binary_texts(batch):
                ids = coder.encode(data.decode())
                back = coder.decode(ids)
                out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == data, ids.tolist() if with_ids else None))
            cols = list(zip(*out)) or [()] * 5
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[4], pa.list_(pa.int64()))] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids"] * with_ids)

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<bigint>" * with_ids)


def decoded(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of rows with ids; ids that aren't UTF-8 together give replacement characters."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.expr("array()")).cast("array<bigint>").alias("ids"))

    def run(batches):
        coder = installed(vocabulary)
        for batch in slices(batches):
            texts = [coder.decode(np.asarray(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
