"""Byte-pair encoding of one piece as a deterministic transducer that counts tokens.

The encoding of a prefix ends in a token that is a suffix of the prefix, and what stands before
that token is the encoding of the shorter prefix. So the last tokens at the places a longer token
could still reach back to are all that decides what follows. A state is the longest suffix read
that begins some token, with the last token at each of its places and how many tokens more or
fewer the encoding had there. A transition on a byte is annotated with the tokens it adds (it may
be none, or fewer than none). States are compiled when they are first reached.
"""

from __future__ import annotations

import json

MAX_STATES = 300_000
_NEVER = 1 << 60


def _byte_of_char() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabulary files: the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Tokens and ranked pairs of a vocabulary file of the ``tokenizers`` library."""

    def __init__(self, content: str):
        held = json.loads(content)
        model, byte = held["model"], _byte_of_char()
        if model["type"] != "BPE" or held["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is asked for")
        decode = lambda text: bytes(byte[c] for c in text)
        self.ids = {decode(text): i for text, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # id: left part, right part, rank
        for rank, (a, b) in enumerate(pairs):
            left, right = decode(a), decode(b)
            pair, joined = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.merges[pair] = (rank, joined)
            self.parts.setdefault(joined, (*pair, rank))
        self.specials = [t["content"] for t in held["added_tokens"]]
        self.special_ids = [t["id"] for t in held["added_tokens"]]
        self.bytes = {i: token for token, i in self.ids.items()}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts at one side (0: left, 1: right) of a token, from the single byte up.

        Each comes with the rank of the merge that takes it in.
        """
        found, absorbed = [], _NEVER
        while token is not None:
            found.append((token, absorbed))
            left, right, absorbed = self.parts.get(token, (None, None, 0))
            token = (left, right)[side]
        return found[::-1]


class CountingMachine:
    """The transducer; ``count`` is the number of tokens of a piece."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.starts = {token[:i] for token in table.ids for i in range(len(token) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.clear()

    def clear(self) -> None:
        start = (b"", ((-1, 0),))
        self.states = [start]
        self.number = {start: 0}
        self.reach: dict[bytes, list[bool]] = {}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _fit(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their bytes."""
        if left < 0:
            return True
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self._stands(left, right)
        return known

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        held = self.edges.get((token, side))
        if held is None:
            held = self.edges[token, side] = self.table.edge(token, side)
        return held

    def _stands(self, left: int, right: int) -> bool:
        """Replays the merges at both sides of the border, lowest rank first.

        The border falls if the parts beside it can merge before either is taken in by its own
        token. Of equal ranks the merge further left comes first.
        """
        ours, theirs, merges = self._edge(left, 1), self._edge(right, 0), self.table.merges
        i = k = 0
        while True:
            (a, ends_a), (b, ends_b) = ours[i], theirs[k]
            across = merges.get((a, b))
            if across is not None and across[0] < ends_a and across[0] <= ends_b:
                return False
            if ends_a == ends_b == _NEVER:
                return True
            if ends_a <= ends_b:
                i += 1
            else:
                k += 1

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, ends = self.states[state]  # ends[k]: (last token, tokens more) k bytes back
        read = suffix + bytes([byte])
        for cut in range(len(read)):
            back = len(read) - 1 - cut  # the token takes this many bytes read earlier
            token = self.table.ids.get(read[cut:])
            if token is not None and self._fit(ends[back][0], token):
                added = ends[back][1] + 1
                break
        else:
            raise ValueError("no token ends here: the vocabulary lacks single bytes")
        cut = 0
        while read[cut:] not in self.starts:
            cut += 1
        kept = read[cut:]
        # Places where no token that is still to come can begin say nothing.
        reach = self.reach.get(kept)
        if reach is None:
            reach = self.reach[kept] = [kept[len(kept) - k :] in self.starts for k in range(1, len(kept) + 1)]
        earlier = ((e[0], e[1] - added) if open_ else None for e, open_ in zip(ends, reach))
        target = (kept, ((token, 0), *earlier))
        at = self.number.get(target)
        if at is None:
            at = self.number[target] = len(self.states)
            self.states.append(target)
            self.moves.append({})
        self.moves[state][byte] = (at, added)
        return at, added

    def count(self, piece: bytes) -> int:
        if len(self.states) > MAX_STATES:  # states are compiled again when they are needed
            self.clear()
        state = total = 0
        moves = self.moves
        for byte in piece:
            state, added = moves[state].get(byte) or self._compile(state, byte)
            total += added
        return total
