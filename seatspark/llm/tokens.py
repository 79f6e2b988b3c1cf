"""Token ids of whole text columns by a public tokenizer file.

Texts are cut before a single space between two visible characters (what may be
white space beyond ASCII counts as none); neither of the pre-tokenizers used
here forms a token across that place. Each distinct piece is encoded once by
the tokenizers library and kept, so a text costs a hash and a look-up for each
word. Texts that hold the string of a special token in any case are given to
the tokenizer whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from .textops import byte_values, ranges, run_hashes

KEPT_PIECES = 1 << 20  # the kept pieces are forgotten beyond this number
_encoders: dict[str, "PieceEncoder"] = {}  # one a worker process, for all its tasks


def _may_begin_blank(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether a character of these first bytes may be white space beyond ASCII (some letters are taken for it)."""
    return (first == 0xC2) & (second < 0xA1) | (first >= 0xE1) & (first <= 0xE3) & (
        (second == 0x80) | (second == 0x81) | (second == 0x9A))


def _may_end_blank(third: np.ndarray, second: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The same of a character's last bytes."""
    return _may_begin_blank(second, last) & (second == 0xC2) | _may_begin_blank(third, second) & (third != 0xC2)


def encoder_for(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder:
    """Encodes UTF-8 slices as ``Tokenizer.encode(text, add_special_tokens=False)`` would each text.

    So the string of a special token, as `<|endoftext|>`, gives that token's id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.values = byte_values(np.ones(256, bool), fold_case=False)
        self.separator = self._separator()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes of the kept pieces, sorted
        self.slots = np.zeros(0, np.int64)  # and their places among the lengths
        self.ids, self.lengths = array("I"), array("q")

    def _separator(self) -> tuple[str, int]:
        """A text between pieces that is one token of its own, and its id; none: ("", -1)."""
        for sep in ("\n", " \x01"):
            ids = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a.", "a." + sep + " .b", " .b")]
            if len(ids[1]) == len(ids[0]) + 1 + len(ids[2]) and ids[1] == ids[0] + [ids[1][len(ids[0])]] + ids[2]:
                return sep, ids[1][len(ids[0])]
        return "", -1

    def _joinable(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces that begin with a space, do not hold the separator's mark and do not end in white space."""
        marks = np.concatenate([[0], np.cumsum(data == ord(self.separator[0].strip(" ")))])
        last, second, third = (data[np.maximum(ends - k, begins)] for k in (1, 2, 3))
        return (data[begins] == 32) & (marks[ends] == marks[begins]) & (last > 32) & ~_may_end_blank(third, second, last)

    def _learn(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode the pieces of ``data`` and keep their ids; plain pieces many at a time, between separators.

        Returns the pieces in the order in which they were kept.
        """
        sep, sep_id = self.separator
        plain = self._joinable(data, begins, ends) if sep else np.zeros(len(begins), bool)
        raw, joined, alone = data.tobytes(), np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
        kept = []
        for i in range(0, len(joined), 512):
            group = joined[i:i + 512]
            text = "".join(raw[x:y].decode() + sep for x, y in zip(begins[group].tolist(), ends[group].tolist()))
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            is_end = ids == sep_id
            at = np.flatnonzero(is_end)
            if len(at) == len(group):
                self.ids.frombytes(ids[~is_end].tobytes())
                self.lengths.frombytes((np.diff(at, prepend=-1) - 1).astype(np.int64).tobytes())
                kept.append(group)
            else:
                alone += group.tolist()
        for i in range(0, len(alone), 512):
            texts = [raw[begins[k]:ends[k]].decode() for k in alone[i:i + 512]]
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                self.ids.extend(e.ids)
                self.lengths.append(len(e.ids))
        return np.concatenate([*kept, np.array(alone, np.int64)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the bounds of each row among them."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n, bool)
        at = np.flatnonzero(data[1:-1] == 32) + 1
        visible = (data[at - 1] > 32) & (data[at + 1] > 32)
        visible &= ~_may_end_blank(data[np.maximum(at - 3, 0)], data[np.maximum(at - 2, 0)], data[at - 1])
        visible &= ~_may_begin_blank(data[at + 1], data[np.minimum(at + 2, n - 1)])
        cut[at[visible]] = True
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        uniq, place_of, inverse = np.unique(run_hashes(self.values[data], starts),
                                            return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_PIECES:
            self._forget()
        place = np.searchsorted(self.keys, uniq)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != uniq) if len(self.keys) else np.arange(len(uniq))
        if len(new):
            ends = np.append(starts[1:], n)
            first, slots = place_of[new], np.empty(len(new), np.int64)
            before = len(self.lengths)
            slots[self._learn(data, starts[first], ends[first])] = np.arange(before, before + len(new))
            self.keys, self.slots = np.insert(self.keys, place[new], uniq[new]), np.insert(self.slots, place[new], slots)
            place = np.searchsorted(self.keys, uniq)
        kept = np.frombuffer(self.lengths, np.int64)
        which = self.slots[place][inverse]
        lengths = kept[which]
        ids = np.frombuffer(self.ids, np.uint32)[ranges((np.cumsum(kept) - kept)[which], lengths)] \
            if len(self.ids) else np.zeros(0, np.uint32)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self._with_special(data, offsets, ids, ends[np.searchsorted(starts, offsets)])

    def _with_special(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray,
                      bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` with the rows that hold a special token's string encoded whole."""
        raw, rows = data.tobytes(), set()
        low = raw.lower()
        for text in self.special:
            at = low.find(text)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = low.find(text, at + 1)
        if not rows:
            return ids, bounds
        parts, sizes, done = [], np.diff(bounds), 0
        for r in sorted(rows):
            whole = self.tokenizer.encode(raw[offsets[r]:offsets[r + 1]].decode(), add_special_tokens=False).ids
            parts += [ids[done:bounds[r]], np.array(whole, np.uint32)]
            sizes[r], done = len(whole), bounds[r + 1]
        return np.concatenate([*parts, ids[done:]]), np.concatenate([[0], np.cumsum(sizes)])
