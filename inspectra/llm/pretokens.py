"""The byte-level tokenizers' splitting pattern as a deterministic transducer, run over all texts of a step at once.

The pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`. A transition may mark the current
character, the one before it or both as the start of a piece. The stream is cut into chunks; each chunk's map from any state to
the state after it is found without knowing where it starts, the maps compose through a parallel prefix scan, and a second
pass from the states so found emits the marks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

CHUNK = 256
#: Character classes: other letters, the letters of contractions, digits, white space, blank, apostrophe, rest, end of text.
LETTER, STMD, E_, R_, V_, L_, DIGIT, SPACE, BLANK, APOSTROPHE, OTHER, END = range(12)
#: States. START: the next character begins a piece. QUOTE*: an apostrophe began a piece (and r, v or l followed).
#: BLANK1, SPACE1: one white-space character, the last a blank or not; BLANKS, SPACES: several.
START, WORD, NUMBER, REST, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, BLANK1, BLANKS, SPACE1, SPACES = range(12)
STATES = 12
HERE, BEFORE = 1, 2


def matched_by_tokenizers(pattern: str, every: str) -> str:
    """The characters of `every` that the tokenizers library's regular expressions match."""
    from tokenizers import Regex, pre_tokenizers

    return "".join(x for x, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every))


def matched_by_tiktoken(pattern: str, every: str) -> str:
    """The characters of `every` that the tiktoken library's regular expressions match."""
    import tiktoken

    plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return plain.decode(plain.encode_ordinary(every))


@functools.cache
def class_table(matched: Callable[[str, str], str]) -> np.ndarray:
    """The class of every code point, by the Unicode version of the library that `matched` asks."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", SPACE)):
        table[np.frombuffer(matched(pattern, every).encode("utf-32-le"), "<u4")] = kind
    for chars, kind in (("stmd", STMD), ("e", E_), ("r", R_), ("v", V_), ("l", L_), (" ", BLANK), ("'", APOSTROPHE)):
        for c in chars:
            table[ord(c)] = kind
    return table


@functools.cache
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for (state, class)."""
    nxt, marks = np.zeros((STATES, 12), np.uint8), np.zeros((STATES, 12), np.uint8)
    begins = {DIGIT: NUMBER, SPACE: SPACE1, BLANK: BLANK1, APOSTROPHE: QUOTE, OTHER: REST} | dict.fromkeys((LETTER, STMD, E_, R_, V_, L_), WORD)
    letters = (LETTER, STMD, E_, R_, V_, L_)
    for state in range(STATES):
        for c, to in begins.items():
            nxt[state, c], marks[state, c] = to, HERE
        nxt[state, END] = START
    for c in letters:
        for state, mark in ((WORD, 0), (BLANK1, 0), (BLANKS, BEFORE), (SPACES, BEFORE | HERE), (QUOTE_R, BEFORE), (QUOTE_V, BEFORE), (QUOTE_L, BEFORE)):
            nxt[state, c], marks[state, c] = WORD, mark
    for c in (DIGIT, SPACE, BLANK, APOSTROPHE, OTHER, END):
        for state in (QUOTE_R, QUOTE_V, QUOTE_L):
            marks[state, c] |= BEFORE
    for state, mark in ((NUMBER, 0), (BLANK1, 0), (BLANKS, BEFORE), (SPACES, BEFORE | HERE)):
        marks[state, DIGIT] = mark
    for state, mark in ((REST, 0), (BLANK1, 0), (BLANKS, BEFORE), (QUOTE, 0)):
        for c in (OTHER, APOSTROPHE):
            nxt[state, c], marks[state, c] = REST, mark
    for c in (OTHER, APOSTROPHE):
        marks[SPACES, c] = BEFORE | HERE
    for state in (BLANK1, BLANKS, SPACE1, SPACES):
        nxt[state, BLANK], nxt[state, SPACE] = BLANKS, SPACES
        marks[state, BLANK] = marks[state, SPACE] = 0
    nxt[QUOTE, STMD] = START
    marks[QUOTE, STMD] = 0
    for c, to in ((R_, QUOTE_R), (V_, QUOTE_V), (L_, QUOTE_L)):
        nxt[QUOTE, c], marks[QUOTE, c] = to, 0
    for state, c in ((QUOTE_R, E_), (QUOTE_V, E_), (QUOTE_L, L_)):
        nxt[state, c], marks[state, c] = START, 0
    return nxt, marks


def chunk_starts(classes: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """The state in which each chunk (row) begins. maps[i, s]: the state after chunk i if it begins in s."""
    flat = nxt.ravel()
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[None], len(classes), 0)
    for k in range(classes.shape[1]):
        maps = flat[maps.astype(np.intp) * 12 + classes[:, k : k + 1]]
    step = 1
    while step < len(maps):  # maps[i] becomes the composition of chunks i-2*step+1 .. i
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)])
        step *= 2
    return np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character of a stream of classes in which END follows each text."""
    nxt, marks = transducer()
    n = len(classes)
    rows = max(1, -(-n // CHUNK))
    padded = np.full(rows * CHUNK, END, np.uint8)
    padded[:n] = classes
    padded = padded.reshape(rows, CHUNK)
    state, flat_next, flat_marks = chunk_starts(padded, nxt), nxt.ravel(), marks.ravel()
    out = np.zeros((rows, CHUNK), np.uint8)
    for k in range(CHUNK):
        at = state.astype(np.intp) * 12 + padded[:, k]
        out[:, k], state = flat_marks[at], flat_next[at]
    out = out.ravel()
    found = (out & HERE).astype(bool)
    found[:-1] |= (out[1:] & BEFORE).astype(bool)
    return found[:n]


def split_pieces(texts: list[str], table: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes laid end to end, where each piece begins and ends in them, and the text it is of."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    classes = table[points]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    classes[ends] = END
    starts = np.flatnonzero(piece_starts(classes))
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[ends] = 0
    at = np.concatenate([[0], np.cumsum(width)])
    begin = at[starts]
    owner = np.searchsorted(ends, starts)
    raw = "".join(texts).encode()
    return raw, begin, np.append(begin[1:], len(raw)), owner
