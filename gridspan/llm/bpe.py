"""Byte-level BPE by monoid tree reduction.

Encodings of byte strings form a monoid: the halves of a piece are encoded on their own, then joined by re-encoding a
window of tokens around the seam. The window grows on a side until its first (last) token equals the token that stood
there: every neighbouring pair of tokens is then one that some correct encoding holds, and tokens outside can not change,
because a token sequence is the encoding of its bytes if and only if each neighbouring pair encodes to itself. Leaves of
a few bytes are merged directly, lowest rank first. Decoding concatenates the tokens' bytes up a tree of halves.

Edge cases: null and empty texts have no token. Texts are whole: long pieces only deepen the tree. Lone surrogates
cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a piece below which merges are applied directly, and new pieces, of about 250 bytes each, after which a task drops those that did not come again.
LEAF, REMEMBERED = 24, 50_000
#: Characters of text whose tokens a task holds as Python numbers at a time.
HELD = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file (base64 token, space, rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}

    def leaf(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours, leftmost first, until none has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < 1 << 60:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a piece: the halves' tokens joined."""
        if len(piece) <= LEAF:
            return self.leaf(piece)
        middle = len(piece) // 2
        return self.join(self.encode(piece[:middle]), self.encode(piece[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: re-encode windows about the seam until their edges stand."""
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = b"".join(map(self.bytes_of.__getitem__, chain(left[len(left) - a :], right[:b])))
            mid = self.leaf(window)
            open_left = a < len(left) and mid[0] != left[len(left) - a]
            open_right = b < len(right) and mid[-1] != right[b - 1]
            if not open_left and not open_right:
                return left[: len(left) - a] + mid + right[b:]
            a += open_left * max(1, a)
            b += open_right * max(1, b)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a token sequence, concatenated up a tree of halves."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class Remembered(dict):
    """Tokens of distinct pieces, encoded once. Those that came since the last `renew` or the one before stay."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.older: dict[str, tuple[int, ...]] = {}

    def renew(self) -> None:
        self.older = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.pop(piece, None) or tuple(self.codec.encode(piece.encode("utf-8", "replace")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def encoder(ranks: dict[bytes, int], pattern: str):
    """A function from text to token ids, for one task."""
    import regex

    split = regex.compile(pattern).findall
    known = Remembered(Codec(ranks))

    def encode(text: str | None) -> list[int]:
        if len(known) > REMEMBERED:
            known.renew()
        return list(chain.from_iterable(map(known.__getitem__, split(text)))) if text else []

    return encode, known.codec


def encode_decode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The columns of docs, then ids (array of int) and decoded (binary), the bytes that the ids give back.

    The rank table is a fixed vocabulary, so its broadcast does not grow with the documents.
    """
    docs = docs.drop("ids", "decoded")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    at = docs.columns.index("text")

    def run(batches):
        encode, codec = encoder(ranks.value, pattern)
        for batch in batches:
            ids, start, held = [], 0, 0
            for i, text in enumerate(batch.column(at), 1):
                ids.append(encode(text := text.as_py()))
                held += len(text or "")
                if held >= HELD or i == batch.num_rows:
                    rows = batch.slice(start, i - start)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.binary())], [*rows.schema.names, "ids", "decoded"])
                    ids, start, held = [], i, 0

    return docs.mapInArrow(run, docs.withColumns({"ids": F.array().cast("array<int>"), "decoded": F.lit(None).cast("binary")}).schema)
