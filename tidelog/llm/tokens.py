"""Token ids of Arrow text columns through the tokenizers library, each distinct piece encoded once.

Both vocabularies cut a text before their merges: at white space, and between letters or digits and
other signs. So the ids of a text are those of its pieces one after another. The pieces are words,
``spaced`` ones with the one space before them and the white space between, cut further where a
Latin letter or digit meets an ASCII sign (but not after an apostrophe, as 's is one token). A
worker keeps what it has encoded, up to MOST pieces or MOST_IDS ids, and then starts anew: that bounds
its memory and changes no result. Texts in which a piece may depend on its neighbours (other white
space than ASCII's, special tokens) go to the library whole."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import Known, Words, expand, hash_spans

#: Pieces and ids that a worker keeps; bytes of text that it takes at a time.
MOST, MOST_IDS, STEP_BYTES = 400_000, 2_000_000, 1 << 20

_ODD = re.compile("<\\||[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_LATIN = re.compile("(?: (?=.))?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
#: What byte-level vocabularies write for bytes that are no visible characters: 256 and on, in order.
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF))}
#: First UTF-8 bytes of what _ODD may find.
_LEAD = np.zeros(256, bool)
_LEAD[[0x3C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def spaced_pieces(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the pieces: `` ?\\S+|\\s+(?!\\S)|\\s+`` on ASCII white space."""
    first, n = words.first, len(words.bounds) - 1
    lead = np.zeros(len(words), bool)  # the word's row begins with it
    lead[first[:-1][np.diff(first) > 0]] = True
    gap_start = np.empty(len(words), np.int64)
    gap_start[1:] = words.ends[:-1]
    begin = words.bounds[words.rows]
    gap_start[lead] = begin[lead]
    gap = words.starts - gap_start
    space = (gap > 0) & (words.buf[np.maximum(words.starts - 1, 0)] == 0x20)
    word_start = words.starts - space
    rest = gap >= 2  # all of the gap but its last character
    last = (gap >= 1) & ~space
    # White space after a row's last word is one piece.
    tail_start = np.where(np.diff(first) > 0, words.ends[np.maximum(first[1:] - 1, 0)] if len(words) else 0, words.bounds[:-1])
    tail = words.bounds[1:] > tail_start
    starts = np.concatenate([gap_start[rest], words.starts[last] - 1, word_start, tail_start[tail]])
    ends = np.concatenate([words.starts[rest] - 1, words.starts[last], words.ends, words.bounds[1:][tail]])
    rows = np.concatenate([words.rows[rest], words.rows[last], words.rows, np.arange(n)[tail]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], rows[order]


_ALNUM = np.zeros(256, bool)
_ALNUM[[i for i in range(128) if chr(i).isalnum()]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def cut_at_signs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces, cut where a letter or digit meets an ASCII sign; pieces are in order and don't overlap."""
    letter, sign = _ALNUM[buf], _SIGN[buf]
    wide = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    ends_letter = letter.copy()
    ends_letter[1:] |= wide  # the second byte of a Latin letter
    begins_letter = letter.copy()
    begins_letter[:-1] |= wide
    cut = np.zeros(len(buf), bool)
    cut[1:] = ends_letter[:-1] & sign[1:] | sign[:-1] & (buf[:-1] != 0x27) & begins_letter[1:]
    inner = np.flatnonzero(cut)
    at = np.searchsorted(starts, inner, "right") - 1
    ok = (at >= 0) & (inner > starts[np.maximum(at, 0)]) & (inner < ends[np.maximum(at, 0)]) if len(starts) else np.zeros(len(inner), bool)
    inner, at = inner[ok], at[ok]
    where = np.searchsorted(inner, starts, "right") + np.arange(len(starts))  # place of each old start among all
    first = np.ones(len(starts) + len(inner), bool)
    all_starts = np.empty(len(first), np.int64)
    all_starts[where] = starts
    first[where] = False
    all_starts[first] = inner
    last_of = np.searchsorted(inner, ends, "left") + np.arange(len(starts))
    all_ends = np.empty(len(first), np.int64)
    all_ends[:-1] = all_starts[1:]
    all_ends[last_of] = ends
    all_rows = np.empty(len(first), np.int64)
    all_rows[where] = rows
    all_rows[first] = rows[at]
    return all_starts, all_ends, all_rows


class Encoder:
    """ids(column) gives all ids one after another and each row's first place (one more than rows)."""

    def __init__(self, path: str, spaced: bool, most: int = MOST, most_ids: int = MOST_IDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.known, self.most_ids = Tokenizer.from_file(path), spaced, Known(most), most_ids
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, texts: list[str]) -> None:
        """The ids of new pieces. Latin words are one pre-token: they go to the library's model in its byte letters."""
        model, lower = self.tokenizer.model, not self.spaced
        ids: list[list[int]] = []
        rest = []
        for k, x in enumerate(texts):
            if _LATIN(x):
                x = (x.lower() if lower else x).encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids.append([t.id for t in model.tokenize(x)])
            else:
                rest.append(k)
                ids.append([])
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for j, e in zip(some, self.tokenizer.encode_batch_fast([texts[j] for j in some], add_special_tokens=False)):
                ids[j] = e.ids
        lens = list(map(len, ids))
        found = list(chain.from_iterable(ids))
        n = len(found)
        if self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(n, self.used), np.uint32)])
        self.pool[self.used : self.used + n] = found
        lens = np.array(lens, np.int64)
        self.at = np.concatenate([self.at, self.used + np.cumsum(lens) - lens])
        self.len = np.concatenate([self.len, lens])
        self.used += n

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(column)
        words = Words(column)
        whole = {}
        lead = np.flatnonzero(_LEAD[words.raw])
        for i in np.unique(np.searchsorted(words.bounds, lead, "right") - 1).tolist():
            text = column[i].as_py()
            if _ODD.search(text):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if whole:
            words = Words(pa.array(["" if i in whole else x for i, x in enumerate(column.to_pylist())], pa.string()))
        starts, ends, rows = spaced_pieces(words) if self.spaced else (words.starts, words.ends, words.rows)
        starts, ends, rows = cut_at_signs(words.buf, starts, ends, rows)
        if self.known.n > self.known.most or self.used > self.most_ids:
            self._clear()

        def learn(places: np.ndarray) -> None:
            data = words.buf.tobytes()
            self._learn([data[a:b].decode() for a, b in zip(starts[places].tolist(), ends[places].tolist())])

        slots = self.known.slots_for(hash_spans(words.buf, starts, ends), learn)
        lens = self.len[slots]
        ids = self.pool[expand(self.at[slots], lens)]
        counts = np.bincount(rows, lens, n).astype(np.int64) if n else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        if not whole:
            return ids, first
        parts = [whole.get(i, ids[first[i] : first[i + 1]]) for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """This worker's encoder for the file; kept from task to task."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]
