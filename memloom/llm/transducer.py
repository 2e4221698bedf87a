"""A BPE vocabulary compiled into a deterministic transducer that counts tokens.

Reading a word byte by byte, the merge result of every prefix is known from its
last token alone: a split is the merge result exactly if each two neighbouring
tokens stay apart when merged on their own. A state therefore holds, for every
suffix of what was read that can still grow into a token, where that suffix
stands in the tree of tokens, the last token before it and how many tokens have
been counted since. The next byte closes exactly one candidate token. Its
transition is annotated with the tokens that are emitted (a negative number takes
back tokens that have merged), and the end of a word has transitions of its own.

States are compiled when they are first reached and numbered. Results do not depend on the order in which texts come. When
there are ``MOST_STATES`` or ``MOST_PAIRS`` of what grows with the texts, the tables are dropped and compiled anew from the
state reached, inside a word if need be.

A long text is cut into chunks at places where words may continue. What a chunk does is a map from the state before it to
the state after it and the tokens emitted (``ChunkMap``): numbers, never text. A chunk that holds a word's end sends every
state that enters it to one state, so its map is what happens up to that end for the entering state, and constants after it. Maps compose associatively;
``prefix_scan`` composes them in pairs, level by level.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

START = -1
NEVER = 1 << 60
#: Compiled states, and remembered pairs of tokens, that are held at most (each some hundred bytes).
MOST_STATES, MOST_PAIRS = 100_000, 300_000


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


State = tuple[tuple[int, int, int], ...]
BEGIN: State = ((0, START, 0),)


class CountingTransducer:
    """Counts the tokens of words under a BPE vocabulary with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.letter = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.final = [vocab[c + end] for _, c in sorted(byte_letters().items())]
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        self.formed: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair = vocab[a], vocab[b]
            made = vocab[a + b]
            self.rank[pair] = rank
            if made not in parts:
                parts[made], self.formed[made] = pair, rank
        self.parts = parts
        symbols: dict[int, tuple[int, ...]] = {t: (t,) for t in (*self.letter, *self.final)}
        for made in sorted(parts, key=self.formed.__getitem__):
            a, b = parts[made]
            symbols[made] = symbols[a] + symbols[b]
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [START]
        for token, run in symbols.items():
            node = 0
            for s in run:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(START)
                node = self.child[node][s]
            self.token[node] = token
        self.apart: dict[tuple[int, int], bool] = {}
        self.states: list[State] = []
        self.number: dict[State, int] = {}
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.closes: list[dict[int, int]] = []
        self._forget()

    def _forget(self) -> None:
        """Back to the start state alone, which is number 0."""
        for table in (self.states, self.number, self.steps, self.closes):
            table.clear()
        self.enter(BEGIN)

    def enter(self, key: State) -> int:
        """The number of a state."""
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.closes.append({})
        return to

    def run(self, state: int, word: bytes) -> tuple[int, int]:
        """The state after bytes inside a word, and the tokens emitted."""
        total, steps = 0, self.steps
        for byte in word:
            move = steps[state].get(byte) or self._step(state, byte)
            state = move[0]
            total += move[1]
        return state, total

    def end(self, state: int, last: int) -> int:
        """Tokens emitted by a word's last byte."""
        emitted = self.closes[state].get(last)
        if emitted is None:
            emitted = self.closes[state][last] = self._close(state, self.final[last])[1]
        return emitted

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at the given edge of ``token`` while it is merged, each with the rank that replaces it."""
        out, until = [(token, NEVER)], NEVER
        while token in self.parts:
            until, token = self.formed[token], self.parts[token][side]
            out.append((token, until))
        return out[::-1]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side remain two; equal ranks merge from the left."""
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= MOST_PAIRS:
                self.apart.clear()
            known = self.apart[key] = self._stay_apart(self._spine(left, 1), self._spine(right, 0))
        return known

    def _stay_apart(self, a: list[tuple[int, int]], b: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_until == NEVER and y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _close(self, state: int, symbol: int) -> tuple[int, int]:
        """The one token that ends with ``symbol``, and the tokens this transition emits."""
        for node, last, since in self.states[state]:
            after = self.child[node].get(symbol)
            if after is not None:
                token = self.token[after]
                if token != START and (last == START or self.stay_apart(last, token)):
                    return token, 1 - since
        raise AssertionError("every byte is a token")

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        if len(self.states) >= MOST_STATES:
            here = self.states[state]
            self._forget()
            state = self.enter(here)
        symbol = self.letter[byte]
        token, emitted = self._close(state, symbol)
        grown = []
        for node, last, since in self.states[state]:
            after = self.child[node].get(symbol)
            if after is not None and self.child[after]:
                grown.append((after, last, since + emitted))
        to = self.enter((*grown, (0, token, 0)))
        made = self.steps[state][byte] = (to, emitted)
        return made

    def count(self, word: bytes) -> int:
        """Tokens of one word (a piece between the splits of the vocabulary's rule)."""
        state, total = self.run(0, word[:-1])
        return total + self.end(state, word[-1])


@dataclass(frozen=True)
class Open:
    """A place inside a text: no word is open (``last`` is None), or one whose bytes but the last, ``last``, have led to ``state``."""

    state: State = BEGIN
    last: int | None = None


class ChunkMap:
    """What a chunk does to the place before it: the place after it and the tokens emitted.

    ``head`` are the chunk's first bytes if they go on with a word, ``ends`` whether that word ends in the chunk, ``count`` and ``after`` what
    follows it. The map for a place is made when it is asked for and kept, as two numbers.
    """

    def __init__(self, machine: CountingTransducer, head: bytes, ends: bool, count: int = 0, after: Open = Open()) -> None:  # noqa: B008
        self.machine, self.head, self.ends, self.tokens, self.after = machine, head, ends, count, after
        self.known: dict[Open, tuple[Open, int]] = {}

    def __call__(self, before: Open) -> tuple[Open, int]:
        got = self.known.get(before)
        if got is None:
            got = self.known[before] = self._through(before)
        return got

    def _through(self, before: Open) -> tuple[Open, int]:
        machine, word = self.machine, self.head
        if before.last is not None:
            word = bytes([before.last]) + word
        if not word:
            return self.after, self.tokens
        state, total = machine.run(machine.enter(before.state), word[:-1])
        if not self.ends:
            return Open(machine.states[state], word[-1]), total
        return self.after, total + machine.end(state, word[-1]) + self.tokens


@dataclass(frozen=True)
class Composed:
    """First one map, then another; for each place again two numbers."""

    first: ChunkMap | Composed
    then: ChunkMap | Composed

    def __call__(self, before: Open) -> tuple[Open, int]:
        place, n = self.first(before)
        place, more = self.then(place)
        return place, n + more


def prefix_scan(maps: list) -> list:
    """The composition of the first 1, 2, ... maps, in rounds of doubling reach; within a round all compositions are independent."""
    out, reach = list(maps), 1
    while reach < len(out):
        out = [Composed(out[i - reach], out[i]) if i >= reach else out[i] for i in range(len(out))]
        reach *= 2
    return out


def total_tokens(maps: list) -> int:
    """Tokens of a text from its chunks' maps, the first word starting with the first chunk."""
    if not maps:
        return 0
    place, n = Open(), 0
    level = list(maps)
    while len(level) > 1:  # the last entry of the scan, by a balanced reduction
        level = [Composed(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    place, n = level[0](Open())
    return n
