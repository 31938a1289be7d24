"""The splitting of text before byte-pair merges, as a deterministic finite-state transducer.

States say what kind of run the last characters form; each transition says whether a piece
starts at the character just read, at the one before it, or neither. Text is cut into chunks of
equal length. For every chunk the map from entry state to exit state is worked out for all
states at once, the maps are composed by a parallel prefix scan, and with the entry states known
the chunks are run once more, all in step, to mark where pieces start.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers.pre_tokenizers import ByteLevel

from pairwright.llm.texts import binary, flat

CHUNK = 512

STATES = ["start", "letters", "digits", "other", "quote", "quote_r", "quote_v", "quote_l", "suffix", "blank", "space", "blanks", "spaces"]
#: Character classes: letters that can stand in a suffix after an apostrophe have one each.
CLASSES = ["letter", "digit", "other", "quote", "blank", "space", "s", "t", "r", "e", "v", "m", "l", "d"]
HERE, BEFORE = 1, 2  # a piece starts at this character; at the previous one


def _fresh(kind: str) -> str:
    """The state after the first character of a piece."""
    if kind in ("digit", "other", "quote", "blank", "space"):
        return {"digit": "digits"}.get(kind, kind)
    return "letters"


def _run_of(kind: str) -> str:
    """The state of a run that has begun with a blank."""
    return {"digit": "digits", "other": "other", "quote": "other"}.get(kind, "letters")


def _step(state: str, kind: str) -> tuple[str, int]:
    white = kind in ("blank", "space")
    if state == "quote" and kind in "stmdrvl":
        return ({"r": "quote_r", "v": "quote_v", "l": "quote_l"}.get(kind, "suffix"), 0)
    if state in ("quote_r", "quote_v", "quote_l"):
        if kind == ("l" if state == "quote_l" else "e"):
            return "suffix", 0
        target, starts = _step("letters", kind)
        return target, starts | BEFORE
    if state in ("blank", "space", "blanks", "spaces"):
        if white:
            return kind + "s", 0
        retro = BEFORE if state in ("blanks", "spaces") else 0
        if state in ("blank", "blanks"):
            return _run_of(kind), retro
        return _fresh(kind), retro | HERE
    run = _run_of(kind) if not white else ""
    if state == run and state in ("letters", "digits") or run == "other" and state in ("other", "quote"):
        return run, 0
    return _fresh(kind), HERE


@cache
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Flat (next state, starts) tables; the second half of the classes begins a new text."""
    n, k = len(STATES), len(CLASSES)
    following, starts = np.zeros((n, 2 * k), np.uint8), np.zeros((n, 2 * k), np.uint8)
    for i, state in enumerate(STATES):
        for j, kind in enumerate(CLASSES):
            target, out = _step(state, kind)
            following[i, j], starts[i, j] = STATES.index(target), out
            target, out = _step("start", kind)
            # A suffix left open at the end of a text is settled by the first character after it.
            late = BEFORE if state.startswith("quote_") else 0
            following[i, k + j], starts[i, k + j] = STATES.index(target), out | late
    return following.ravel(), starts.ravel()


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", "letter"), (r"\p{N}+", "digit")):
        for run in regex.finditer(pattern, every):
            table[ord(run[0][0]) : ord(run[0][-1]) + 1] = CLASSES.index(kind)
    # Code points that are too new for one Unicode version or other: as the library has them.
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for char in every:
        if unicodedata.category(char) == "Cn" and table[ord(char)] != CLASSES.index("other"):
            kinds = [k for first, k in (("a", "letter"), ("1", "digit")) if len(split(first + char)) == 1]
            table[ord(char)] = CLASSES.index(kinds[0] if kinds else "other")
    # The code points of the property White_Space.
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = CLASSES.index("space")
    table[0x20] = CLASSES.index("blank")
    table[0x27] = CLASSES.index("quote")
    for letter in "strevmld":
        table[ord(letter)] = CLASSES.index(letter)
    return table


def _entries(kinds: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The entry state of every column (chunk) of ``kinds``, by composing the chunks' state maps."""
    width = 2 * len(CLASSES)
    maps = np.repeat(np.arange(len(STATES), dtype=np.uint8)[:, None], kinds.shape[1], axis=1)
    row = 0
    while row < len(kinds):
        for kind in kinds[row : row + 8]:
            maps = following[maps.astype(np.int64) * width + kind]
        row += 8
        if (maps == maps[:1]).all():  # every entry state has led to the same state
            last = maps[0]
            for kind in kinds[row:]:
                last = following[last.astype(np.int64) * width + kind]
            maps = np.repeat(last[None], len(STATES), axis=0)
            break
    reach, scan = 1, maps.T.copy()
    while reach < len(scan):
        scan[reach:] = np.take_along_axis(scan[reach:], scan[:-reach].astype(np.int64), axis=1)
        reach *= 2
    return np.concatenate([[0], scan[:-1, 0]]).astype(np.uint8)


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Places of the code points at which a piece starts. Texts begin at ``text_starts``."""
    following, starts = _machine()
    k, n = len(CLASSES), len(points)
    kinds = _classes()[points]
    kinds[text_starts] += k
    lanes = max(1, -(-n // CHUNK))
    # The filling at the end begins a new text, so that it settles what is open.
    padded = np.full(lanes * CHUNK + 1, k, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded[:-1].reshape(lanes, CHUNK).T)
    state = _entries(columns, following)
    marks = np.empty((CHUNK, lanes), np.uint8)
    for i, kind in enumerate(columns):
        at = state.astype(np.int64) * (2 * k) + kind
        marks[i] = starts[at]
        state = following[at]
    flags = np.append(marks.T.ravel(), starts[int(state[-1]) * 2 * k + k])[: n + 1]
    begins = (flags[:n] & HERE) > 0
    begins |= (flags[1:] & BEFORE) > 0
    return np.flatnonzero(begins)


class Pieces:
    """The pieces of all texts of a slice: a binary array, and the first piece of every text."""

    def __init__(self, texts: pa.Array):
        data, offsets = flat(texts)
        places = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            self.words, self.first = pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
            return
        begun = offsets[:-1][np.diff(offsets) > 0]
        starts = places[piece_starts(points, np.searchsorted(places, begun))]
        self.words = binary(np.append(starts, len(data)), data)
        self.first = np.searchsorted(starts, offsets)


def split_special(texts: list[str | None], special: str) -> tuple[pa.Array, np.ndarray]:
    """(parts between the special strings, number of the first part of each text)."""
    parts: list[str] = []
    first = [0]
    for text in texts:
        parts += (text or "").split(special) if special else [text or ""]
        first.append(len(parts))
    return pa.array(parts, pa.large_string()), np.array(first, np.int64)
