"""Hierarchical multi-length packing.

Documents are tokenised and packed where they are read, without a shuffle: each input partition cuts
its documents' whole windows off, routes what remains to the shortest context-size tier that holds it,
packs tier by tier from the longest, fills the gaps of longer windows from shorter tiers, and deals the
finished windows of each tier to step groups of equal token count and even attention cost: a group is made once
its tier has a whole step's windows, and what the tiers have left at a partition's end is dealt to mixed groups.
All groups hold `step_tokens` but the last of each partition, which holds what is left. A task keeps one buffer
of `buffer_tokens` and less than a step of each tier; nothing is grouped by a key, so no key can be hot, and a
lost task repeats its partition with the same result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import FileEncoder, worker_encoder

#: Context sizes, longest first; all are powers of two.
TIERS = (2048, 1024, 512, 256)
END_ID = 1
ID_BYTES = 4
#: Text units whose ids a worker keeps, some 200 bytes each; packing leaves the memory for twice the usual number.
MEMO = 1_400_000


class TierPacker:
    """Packs (key, ids) of one partition. Pieces are tuples (length, serial, key, start, ids, doc_tokens)."""

    def __init__(self, tiers=TIERS, buffer_tokens: int = 1 << 20, step_tokens: int = 1 << 15):
        self.tiers, self.buffer_tokens, self.step_tokens = tuple(tiers), buffer_tokens, step_tokens
        self.pool: list[tuple] = []
        self.done: dict[int, list[list[tuple]]] = defaultdict(list)
        self.tokens = self.serial = self.sequences = self.steps = 0

    def add(self, key, ids: bytes) -> None:
        n, window = len(ids) // ID_BYTES, self.tiers[0]
        for start in range(0, n, window):
            length = min(window, n - start)
            piece = (length, self.serial, key, start, ids[start * ID_BYTES : (start + length) * ID_BYTES], n)
            self.serial += 1
            if length == window:
                self.done[window].append([piece])
            else:
                self.pool.append(piece)
            self.tokens += length

    @staticmethod
    def _cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
        length, serial, key, start, ids, n = piece
        return (at, serial, key, start, ids[: at * ID_BYTES], n), (length - at, serial, key, start + at, ids[at * ID_BYTES :], n)

    def _fill(self, window: list[tuple], gap: int) -> int:
        """Fills a window's gap by the longest pieces that fit, at last by a part of the shortest; gives the gap left."""
        pool = self.pool
        while gap and pool:
            k = bisect_right(pool, (gap, float("inf"))) - 1
            if k >= 0:
                piece = pool.pop(k)
            else:
                piece, rest = self._cut(pool.pop(0), gap)
                insort(pool, rest)
            window.append(piece)
            gap -= piece[0]
        return gap

    def pack(self, last: bool) -> None:
        """Packs the buffered pieces; without `last`, what fills no window waits for the next buffer."""
        self.pool.sort()
        for tier in self.tiers:
            shortest = tier // 2 if tier != self.tiers[-1] else 0
            while self.pool and self.pool[-1][0] > shortest:
                window = [self.pool.pop()]
                if self._fill(window, tier - window[0][0]):
                    self.pool = sorted(window)
                    break
                self.done[tier].append(window)
            else:
                continue
            break
        if last and self.pool:
            self._tail()

    def _tail(self) -> None:
        """The last pieces of a partition, under one window: into windows of the powers of two that sum to them."""
        left = sum(p[0] for p in self.pool)
        while left:
            size = min(1 << (left.bit_length() - 1), self.tiers[0])
            window: list[tuple] = []
            gap = size
            while gap:
                piece = self.pool.pop()
                if piece[0] > gap:
                    piece, rest = self._cut(piece, gap)
                    self.pool.append(rest)
                window.append(piece)
                gap -= piece[0]
            self.done[size].append(window)
            left -= size

    def _groups(self, last: bool) -> Iterator[list[list[tuple]]]:
        """Step groups of finished windows; what makes no whole group waits, unless these are the last."""
        for tier in sorted(self.done, reverse=True):
            each = max(1, self.step_tokens // tier)
            whole = len(self.done[tier]) // each * each
            windows, self.done[tier] = self.done[tier][:whole], self.done[tier][whole:]
            # In turn and back, dearest first, so that the groups' sums of squared piece lengths stay even.
            windows.sort(key=lambda w: -sum(p[0] ** 2 for p in w))
            groups: list[list[list[tuple]]] = [[] for _ in range(whole // each)]
            for k, window in enumerate(windows):
                turn, place = divmod(k, len(groups))
                groups[place if turn % 2 == 0 else -1 - place].append(window)
            yield from groups
        if last:
            # Sizes are powers of two: from the longest on, a group is filled to the token.
            group, left = [], self.step_tokens
            for tier in sorted(self.done, reverse=True):
                for window in self.done.pop(tier):
                    group.append(window)
                    left -= tier
                    if left <= 0:
                        yield group
                        group, left = [], self.step_tokens
            if group:
                yield group

    def rows(self, last: bool = True) -> Iterator[tuple]:
        """(key, start, length, ids, doc_tokens, sequence, offset, tier, step) of the windows of all finished step groups."""
        for group in self._groups(last):
            for window in group:
                offset, tier = 0, sum(p[0] for p in window)
                for length, _, key, start, ids, n in window:
                    yield key, start, length, ids, n, self.sequences, offset, tier, self.steps
                    offset += length
                self.sequences += 1
            self.steps += 1
        self.tokens = sum(p[0] for p in self.pool)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tiers=TIERS, buffer_tokens: int = 1 << 20, step_tokens: int = 1 << 15, keeps_spaces: bool = True) -> DataFrame:
    """Packs all documents into windows of the tiers' sizes; one row per piece of a document.

    Columns: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, tier,
    step_group. Each id lies in one piece. Windows of the tiers are full; the end of a partition goes to windows
    of smaller powers of two, full as well. A null or empty text has its end id alone. Repeated rows are packed
    each on its own, null ids too. Other columns of `docs` are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset", "tier", "step_group"))])

    def run(batches):
        import struct

        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, end = to_arrow_schema(schema), struct.pack("<I", end_id)
        base = TaskContext.get().partitionId() << 40
        encode = worker_encoder(FileEncoder, tokenizer, keeps_spaces, MEMO).encode
        packer = TierPacker(tiers, buffer_tokens, step_tokens)

        def out(last):
            rows = list(packer.rows(last))
            if rows:
                cols = [list(c) for c in zip(*rows)]
                cols[5] = [base + x for x in cols[5]]
                cols[8] = [base + x for x in cols[8]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k in range(len(keys)):
                packer.add(keys[k], encode(batch.column(1)[k].as_py()) + end)
                if packer.tokens >= buffer_tokens:
                    packer.pack(last=False)
                    yield from out(False)
        packer.pack(last=True)
        yield from out(True)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
