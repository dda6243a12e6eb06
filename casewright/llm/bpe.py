"""Byte-level BPE encoding by longest matches and backtracking, and decoding.

Bytes are mapped to Latin-1 characters for pyahocorasick. A sequence of tokens is the one that merging would
give if and only if each pair of neighbours is: so the encoder takes the longest match at each place, falls
back to shorter ones (the longest token that begins it) where a neighbour doesn't agree, and steps back where
none is left, marking the place so that it is never tried again. Whether two tokens agree is found by taking
their merges back, and remembered. The steps are linear in the piece's length.
"""

from __future__ import annotations

import base64
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import MARKS, UnitEncoder, worker_encoder


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(ranks: dict[bytes, int], piece: bytes, least: int = 1) -> list[bytes]:
    """The definition: of all neighbours whose bytes together are a token, those of the lowest rank merge first; ends where `least` parts are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        found = [(ranks[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class PieceEncoder:
    """Encodes one piece of bytes; all 256 single bytes have to be tokens."""

    def __init__(self, ranks: dict[bytes, int], memo_limit: int = 200_000):
        import ahocorasick

        self.ranks, self.memo_limit = ranks, memo_limit
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        #: The two parts of each token that merging makes; others are only found as whole pieces.
        self.parts = {}
        for token, rank in ranks.items():
            parts = merged(ranks, token, 2)
            if len(parts) <= 2:
                self.parts[rank] = tuple(ranks[x] for x in parts) if len(parts) == 2 else ()
        self.above = max(self.bytes) + 1
        #: Merges come in the order of ranks.
        self.rising = all(max(parts, default=-1) < rank for rank, parts in self.parts.items())
        made = {self.bytes[rank] for rank in self.parts}
        self.shorter = {ranks[t]: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in made), -1) for t in made}
        #: Beginnings of tokens, with the longest token that begins each.
        self.begun: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token in made:
            self.automaton.add_word(token.decode("latin-1"), ranks[token])
            for n in range(1, len(token) + 1):
                if token[:n] not in self.begun:
                    self.begun[token[:n]] = ranks[token[:n]] if token[:n] in made else self.begun[token[: n - 1]]
        self.automaton.make_automaton()
        self.agree: dict[tuple[int, int], bool] = {}

    def _agrees(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.agree.get(pair)
        if known is None:
            if len(self.agree) >= self.memo_limit:
                self.agree.clear()
            known = self.agree[pair] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Merging the bytes of two tokens gives just these.

        Their merges are taken back from the last on. Parts that meet at the border would have merged if that came
        before what was last taken back; of merges of one rank the left one comes first.
        """
        if not self.rising:
            a, b = self.bytes[left], self.bytes[right]
            return merged(self.ranks, a + b) == [a, b]
        ranks, text, parts, limit = self.ranks, self.bytes, self.parts, self.above
        while True:
            if ranks.get(text[left] + text[right], limit) < limit:
                return False
            if parts[left] and (left > right or not parts[right]):
                limit, left = left, parts[left][1]
            elif parts[right]:
                limit, right = right + 1, parts[right][0]
            else:
                return True

    def _longest(self, piece: bytes, at: int) -> int:
        begun, end = self.begun, at + 1
        while end < len(piece) and piece[at : end + 1] in begun:
            end += 1
        return begun[piece[at:end]]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, shorter, n, agrees = self.size, self.shorter, len(piece), self._agrees
        tokens, at = [], 0
        for _, token in self.automaton.iter_long(piece.decode("latin-1")):  # each the longest where the one before ends
            if tokens and not agrees(tokens[-1], token):
                break
            tokens.append(token)
            at += size[token]
        if at == n:
            return tokens
        open_at = bytearray(b"\1" * (n + 1))
        while at < n:
            end = at + size[token]
            if open_at[end] and (not tokens or agrees(tokens[-1], token)):
                tokens.append(token)
                at = end
                if at < n:
                    token = self._longest(piece, at)
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_at[at] = 0
                token = tokens.pop()
                at -= size[token]
        return tokens


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class RankEncoder(UnitEncoder):
    """By a rank file and a pattern that splits texts into pieces, each of which is encoded on its own."""

    def __init__(self, path: str, pattern: str, memo_limit: int = 700_000):
        import regex

        super().__init__(True, memo_limit)
        self.pattern, self.pieces = regex.compile(pattern), PieceEncoder(load_ranks(path))
        #: The pattern keeps a word, with a blank before it, apart from marks behind it.
        self.marked = all(self.pattern.findall(f" \u00e9X{mark}") == [" \u00e9X", mark] for mark in (MARKS, *MARKS))

    def _unit(self, unit: str) -> list[int]:
        return [x for piece in self.pattern.findall(unit) for x in self.pieces.encode(piece.encode())]

    def _packed(self, units: list[str]) -> list[bytes]:
        """A word and the marks behind it are two pieces, and words that are known aren't encoded again."""
        new, encode = {}, self.pieces.encode
        for unit in sorted(units, key=len):  # words come before the same with marks
            stem = unit.rstrip(MARKS)
            if not self.marked or not stem.removeprefix(" ").isalpha():
                new[unit] = _bytes(self._unit(unit))
            elif len(stem) == len(unit):
                new[unit] = _bytes(encode(unit.encode()))
            else:
                known = new.get(stem) or self.units.get(stem) or _bytes(encode(stem.encode()))
                new[unit] = known + _bytes(encode(unit[len(stem) :].encode()))
        return [new[unit] for unit in units]

    _whole = _unit


def _schema(docs: DataFrame, id_col: str, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), *more])


_DECODED = T.StructField("decoded", T.BinaryType())


def _encoded(batches, schema: T.StructType, ranks_path: str, pattern: str):
    """doc_id, ids of record batches of ids and texts, 1000 rows at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, encode_all = to_arrow_schema(schema), worker_encoder(RankEncoder, ranks_path, pattern).encode_all
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            ends, ids = encode_all(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([part.column(0), lists.cast(arrow.field(1).type)], schema=arrow)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of each whole text, without special tokens; a null or empty text has none.

    One row for each row, repeated and null ids too; other columns aren't read. No shuffle.
    """
    schema = _schema(docs, id_col)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lambda batches: _encoded(batches, schema, ranks_path, pattern), schema)


_tables: dict[str, list[bytes]] = {}


def _with_decoded(batches, schema: T.StructType, ranks_path: str):
    """Record batches of doc_id and ids, with the bytes of the ids."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    if ranks_path not in _tables:
        _tables[ranks_path] = {rank: token for token, rank in load_ranks(ranks_path).items()}
    table = _tables[ranks_path]
    for batch in batches:
        lists = batch.column(1)
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        decoded = [b"".join(map(table.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(arrow.field(1).type), pa.array(decoded, pa.binary())], schema=arrow)


def decode_documents(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `decoded` binary, the bytes of doc_id's ids; null ids decode to none. An unknown id fails the job."""
    schema = T.StructType([tokens.schema["doc_id"], tokens.schema["ids"], _DECODED])
    return tokens.select("doc_id", "ids").mapInArrow(lambda batches: _with_decoded(batches, schema, ranks_path), schema)


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What decode_documents gives of encode_documents' rows, with both steps in one Python worker.

    Spark gives each step of a task a worker of its own and idle ones are used again for either, so that in time all
    would hold an encoder's memos: twice the memory.
    """
    between = _schema(docs, id_col)
    schema = _schema(docs, id_col, _DECODED)

    def run(batches):
        return _with_decoded(_encoded(batches, between, ranks_path, pattern), schema, ranks_path)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
