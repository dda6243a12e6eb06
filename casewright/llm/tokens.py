"""Token ids of whole texts by the stages of a `tokenizers` file, with a memo of text units.

A unit is a run of white space with the run of other characters after it (or, for files that drop
white space, just the latter). Neither kind of pre-tokenizer lets a token cross from one unit to the
next, so the ids of a text are those of its units in order, and repeated units are encoded once.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import filterfalse

import numpy as np

#: White space besides blank and newline (fixed values: Unicode White_Space).
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0                　"
#: Python counts these as white space, the tokenizers' patterns do not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Marks that no pre-tokenizer joins to letters before them; an apostrophe may be.
MARKS = ".,;:!?*#$%&()[]{}<>|/\"+-=_~@^"
#: So many units are encoded in one go at most: the library's notes of a word take many times its bytes.
AT_ONCE = 10_000
_UNIT = re.compile(r"\s*\S+|\s+\Z")
#: White space that isn't ASCII.
FAR_SPACE = [c for c in OTHER_SPACE if c > "\x7f"]
#: By a byte of UTF-8: whether it is white space.
_ASCII_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


class _Memo(dict):
    """unit -> its ids as little-endian unsigned 32-bit integers; emptied when full."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self.encode(unit)
        self[unit] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class UnitEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers.

    keeps_spaces: a blank belongs to the word after it; else white space is dropped. memo_limit bounds the entries
    of each memo. Subclasses say how one unit, and a whole text, is encoded.
    """

    def __init__(self, keeps_spaces: bool, memo_limit: int = 700_000):
        self.keeps_spaces = keeps_spaces
        self.units = _Memo(self._unit, memo_limit)
        self.spaced = _Memo(lambda word: self._unit(" " + word), memo_limit)

    def _unit(self, unit: str) -> list[int]:
        raise NotImplementedError

    def _whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def _packed(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, for encoders that take many at once."""
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(self._unit, units)]

    def _learn(self, memo: _Memo, words: list[str], before: str = "") -> None:
        distinct = set(words)
        missing = list(filterfalse(memo.__contains__, distinct))
        if missing:
            if len(memo) + len(missing) > memo.limit:
                memo.clear()
                missing = list(distinct)
            for at in range(0, len(missing), AT_ONCE):
                part = missing[at : at + AT_ONCE]
                memo.update(zip(part, self._packed([before + w for w in part])))

    def _by_units(self, text: str) -> bool:
        """The ids of the text are those of its units."""
        return not any(c in text for c in SEPARATORS)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._by_units(text):
            ids = self._whole(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        if not self.keeps_spaces:
            words = text.split()
            self._learn(self.units, words)
            return b"".join(map(self.units.__getitem__, words))
        plain = text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", "\n\n", " \n", "\n ")) and not any(c in text for c in OTHER_SPACE)
        if not plain:
            return b"".join(map(self.units.__getitem__, _UNIT.findall(text)))
        lines, split = [], [line.split(" ") for line in text.split("\n")]
        self._learn(self.spaced, [w for words in split for w in words[1:]], " ")
        for words in split:
            lines.append(self.units[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:])))
        return self.units["\n"].join(lines)

    def encode_all(self, texts):
        """(ends, ids) of an Arrow column of texts: ids[ends[i] : ends[i + 1]], unsigned 32-bit integers, are those that encode() gives for text i.

        Units are cut and told apart by Arrow and numpy for all texts together, so that Python sees each distinct one
        once and those that aren't known are encoded many at a time. Texts that can't be cut so are encoded one by one.
        """
        import pyarrow as pa

        column = texts.fill_null("").cast(pa.string())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "<i4")
        raw, bounds = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
        if not len(raw):
            return np.zeros(len(column) + 1, np.int64), np.zeros(0, "<u4")
        space = _ASCII_SPACE[raw]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        odd = set()
        for i, text in enumerate(column.to_numpy(zero_copy_only=False)):
            if not self._by_units(text) or any(c in text for c in FAR_SPACE):
                odd.add(text)
                begins[bounds[i] : bounds[i + 1]] = False
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.append(np.flatnonzero(begins), len(raw)).astype("<i4")
        found = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(raw)).dictionary_encode()
        units = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if odd:  # no unit of another text is like one of these
            packed = [self.encode(u) if u in odd else None for u in units]
            rest = iter(self._known([u for u in units if u not in odd]))
            packed = [next(rest) if x is None else x for x in packed]
        else:
            packed = self._known(units)
        sizes, which = np.fromiter(map(len, packed), np.int64, len(packed)) // 4, found.indices.to_numpy()
        many = sizes[which]
        after = np.concatenate([[0], np.cumsum(many)])
        place = np.repeat(((np.cumsum(sizes) - sizes)[which] - after[:-1]).astype("i4"), many)  # fewer ids than bytes
        place += np.arange(after[-1], dtype="i4")
        ids = np.frombuffer(b"".join(packed), "<u4")[place]
        return after[np.searchsorted(starts, bounds)], ids

    def _known(self, units: list[str]) -> list[bytes]:
        words = units if self.keeps_spaces else [u.strip() for u in units]
        self._learn(self.units, words if self.keeps_spaces else [w for w in words if w])
        return [self.units[w] if w else b"" for w in words]


class FileEncoder(UnitEncoder):
    """The ids of Tokenizer.from_file(path).encode(text, add_special_tokens=False), whatever the file.

    Where its pre-tokenizer doesn't keep units apart, which is probed once, and for texts that may hold one of its
    added tokens' strings, whole texts are encoded.
    """

    #: Runs of blanks and lines, words with marks behind them, digits, apostrophes, other scripts, and letters that change when lower-cased.
    PROBE = " Two  words, words. words? (words) words-- ***words$$$\n\nit's 12345 a_b-c. \tX\n é 日本 テスト! \u00a0İI ΟΔΟΣ.\n don't 'll 's"

    def __init__(self, path: str, keeps_spaces: bool, memo_limit: int = 700_000):
        from tokenizers import Tokenizer

        super().__init__(keeps_spaces, memo_limit)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.apart, self.closes = Tokenizer.from_file(path), True, None
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            vocabulary = self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.starts = {f(t[0]) for t in self.added for f in (str.lower, str.upper)}
        units = self.PROBE.split() if not keeps_spaces else _UNIT.findall(self.PROBE)
        self.apart = b"".join(self._packed(units)) == struct.pack(f"<{len(ids := self._whole(self.PROBE))}I", *ids)

    def _by_units(self, text: str) -> bool:
        if not self.apart or not super()._by_units(text):
            return False
        return not any(c in text for c in self.starts) or not any(t in low for low in [text.lower()] for t in self.added)

    def _rust(self, text: str | list[str], n: int) -> list[bytes] | None:
        """The ids of each of the `n` words of a text, or of a list of units; None if the text's words aren't its pieces.

        Where the file's vocabulary tells the last token of a piece, the library needn't keep track of words.
        """
        if self.closes is not None and isinstance(text, str):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = [0, *((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()]
            ids = ids.tobytes()
            return [ids[x:y] for x, y in zip(ends[:-1], ends[1:])] if len(ends) == n + 1 and ends[-1] == len(ids) else None
        found = self.tokenizer.encode(text, is_pretokenized=not isinstance(text, str), add_special_tokens=False)
        words = np.array(found.word_ids, np.int64)
        if isinstance(text, str) and (not len(words) or words[-1] + 1 != n):
            return None
        ends, ids = (np.searchsorted(words, np.arange(n + 1)) * 4).tolist(), np.array(found.ids, "<u4").tobytes()
        return [ids[x:y] for x, y in zip(ends[:-1], ends[1:])]

    def _packed(self, units: list[str]) -> list[bytes]:
        """Letters with marks behind them are a piece of letters and one of marks: words are encoded without their marks, and once."""
        blank = " " if self.keeps_spaces else ""
        known = self.spaced if self.keeps_spaces else self.units
        heads, tails = [], []  # of each unit; one that is encoded whole has no head
        for unit in units:
            body = unit.removeprefix(blank)
            stem = body.rstrip(MARKS)
            if self.apart and stem.isalpha() and (body is not unit or not blank):
                heads.append(stem)
                tails.append(body[len(stem) :])
            else:
                heads.append("")
                tails.append(unit)
        stems, rest = dict.fromkeys(filterfalse(known.__contains__, heads)), dict.fromkeys(tails)
        stems.pop("", None), rest.pop("", None)
        told = self._rust(blank + " ".join(stems), len(stems)) if stems else []
        if told is None:
            told = self._rust([blank + x for x in stems], len(stems))
        stems = dict(zip(stems, told)) | {"": b""}
        rest = dict(zip(rest, self._rust(list(rest), len(rest)) if rest else [])) | {"": b""}
        return [(stems[head] if head in stems else known[head]) + rest[tail] for head, tail in zip(heads, tails)]

    def _unit(self, unit: str) -> list[int]:
        return self.tokenizer.encode([unit], is_pretokenized=True, add_special_tokens=False).ids

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple, UnitEncoder] = {}


def worker_encoder(kind: type[UnitEncoder], *args) -> UnitEncoder:
    """One encoder for each file and Python worker; workers outlive tasks, and so do the memos."""
    key = (kind, *args)
    if key not in _encoders:
        _encoders[key] = kind(*args)
    return _encoders[key]
