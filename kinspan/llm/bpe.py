"""Byte-pair encoding and decoding by a backtracking encoder.

A token sequence is what the merges give for a text exactly if every two
neighbours are compatible, that is, if no merge would have crossed the border
between them. So the encoder takes the longest token at each place (an
Aho-Corasick automaton finds all of them in one pass), accepts it if it is
compatible with the token before, else tries the next shorter one, and steps
back where none is left; places from which no sequence goes on are marked and
never visited again, which keeps the work linear. Decoding copies bytes by an
offset table over one blob of all tokens' bytes.

All pieces that a batch of texts brings are encoded side by side: automaton,
pair-compatibility table and backtracking work on arrays with an entry a piece.
The automaton reads pieces from their ends, so that its one output at a place is
the longest token that begins there.

Memory: a worker process keeps the tables of a vocabulary (a few dozen MB) and runs
between spaces that it met, with their ids, up to KNOWN_BYTES. What is known changes the
time that a text takes and nothing else.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table
from .words import mix, ranges

#: The pattern by which byte-level BPE cuts a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of runs between spaces (with their ids) that a worker keeps; half of them are
#: those met lately. Longer runs than KNOWN_LENGTH are not kept.
KNOWN_BYTES = 64 << 20
KNOWN_LENGTH = 64
#: What an entry takes beside its key and value.
ENTRY_BYTES = 200
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 19
#: Longer texts (in code points) are taken in parts of about this length.
LONG_TEXT = 4 << 20
#: Pieces up to this many bytes are encoded side by side, longer ones alone.
LONG_PIECE = 160
#: Slots of the table of known pairs.
PAIR_SLOTS = 1 << 17
#: Stands for a word's end after its last byte, where a vocabulary has such tokens.
END = "Ā"
_NEVER = np.int32(1 << 30)

_single_space = re.compile(r"(?<=\S) (?=\S)")
_odd_space = re.compile(r" (?:(?=\s)|(?<=\s ))")


def byte_characters() -> dict[str, int]:
    """The printable characters that vocabulary files write for bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Lookup:
    """Non-negative 64-bit keys to 32-bit values, -1 for absent ones; arrays in and out."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held >= 0))
        at = slot[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (held >= 0)
            left, at = left[go], at[go]
        return out

    def one(self, key: int) -> int:
        """The value of one key."""
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (held := self.keys[slot]) != key:
            if held < 0:
                return -1
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return int(self.values[slot])


class Automaton:
    """Aho-Corasick automaton over byte strings; steps are taken for many texts at once."""

    def __init__(self, patterns: list[bytes]):
        nodes: dict[tuple[int, int], int] = {}
        self.node_of: list[int] = []
        for p in patterns:
            at = 0
            for b in p:
                at = nodes.setdefault((at, b), len(nodes) + 1)
            self.node_of.append(at)
        parent, byte = (np.array([k[i] for k in nodes], np.int64) for i in (0, 1))
        self.goto = Lookup(parent << 8 | byte, np.arange(1, len(nodes) + 1, dtype=np.int32))
        depth = np.zeros(len(nodes) + 1, np.int32)
        for child, up in enumerate(parent.tolist(), 1):
            depth[child] = depth[up] + 1
        self.fail = np.zeros(len(nodes) + 1, np.int32)
        self.by_depth = [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]
        for level in self.by_depth[1:]:
            self.fail[level] = self.step(self.fail[parent[level - 1]], byte[level - 1])

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after a byte each."""
        byte = byte.astype(np.int64)
        out = self.goto(state.astype(np.int64) << 8 | byte)
        left = np.flatnonzero((out < 0) & (state > 0))
        at = state[left]
        while len(left):
            at = self.fail[at]
            found = self.goto(at.astype(np.int64) << 8 | byte[left])
            out[left] = found
            go = (found < 0) & (at > 0)
            left, at = left[go], at[go]
        return np.maximum(out, 0)

    def step_one(self, state: int, byte: int) -> int:
        """The state after a byte."""
        while (found := self.goto.one(state << 8 | byte)) < 0 and state:
            state = int(self.fail[state])
        return max(found, 0)

    def states(self, data: np.ndarray, length: np.ndarray, width: int = 128) -> np.ndarray:
        """The state after each byte of some long texts (one behind the other), in parts that
        are stepped side by side: a state depends on as many bytes before as the deepest node
        has, with which a part begins."""
        deep = len(self.by_depth)
        n = -(-length // width)
        inside = ranges(n) * width  # where each part begins in its text
        starts = np.repeat(np.cumsum(length) - length, n) + inside
        lead = np.minimum(inside, deep)
        steps = np.minimum(width, np.repeat(length, n) - inside) + lead
        out, state = np.zeros(len(data), np.int32), np.zeros(len(starts), np.int32)
        for k in range(int(steps.max(initial=0))):
            live = np.flatnonzero(steps > k)
            at = starts[live] - lead[live] + k
            state[live] = self.step(state[live], data[at])
            own = k >= lead[live]
            out[at[own]] = state[live[own]]
        return out

    def longest(self, of_node: np.ndarray) -> np.ndarray:
        """``of_node`` (a pattern or -1 for each node) handed on along failure links, so
        that a node has the longest pattern that its string ends with."""
        out = of_node.copy()
        for level in self.by_depth:
            lacks = level[out[level] < 0]
            out[lacks] = out[self.fail[lacks]]
        return out


class MergeTable:
    """Tokens, their merges and the pair-compatibility table of a tokenizer file.

    Tokens are strings of one character a byte, with END after a word's last
    byte if the vocabulary marks word ends.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_characters()
        suffix = model.get("end_of_word_suffix") or ""
        self.marks_ends = bool(suffix)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {}
        for token, i in model["vocab"].items():
            if suffix and token.endswith(suffix) and token != suffix:
                named[token] = "".join(chr(to_byte[c]) for c in token[: -len(suffix)]) + END, i
            elif all(c in to_byte for c in token):
                named[token] = "".join(chr(to_byte[c]) for c in token), i
        self.ids = dict(named.values())
        n = 1 + max([*self.ids.values(), *self.specials.values()])
        self.text: list[str] = [""] * n
        for s, i in self.ids.items():
            self.text[i] = s
        self.length = np.array([len(s) for s in self.text], np.int32)
        self.left, self.right, self.born = (np.full(n, -1, np.int32) for _ in range(3))
        pairs, ranks = [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = a[: -len(suffix)] + b if suffix and a.endswith(suffix) else a + b
            left, right, made = named[a][1], named[b][1], named[whole][1]
            pairs.append(left << 20 | right)
            ranks.append(rank)
            if self.born[made] < 0:
                self.left[made], self.right[made], self.born[made] = left, right, rank
        self.rank = Lookup(np.array(pairs, np.int64), np.array(ranks, np.int32))
        self._pair, self._fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self._one: dict[int, bool] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each token ``b`` can follow ``a``: no merge crosses their border."""
        pair = a.astype(np.int64) << 20 | b
        slot = (mix(pair.astype(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        fits = self._fits[slot]
        new = np.flatnonzero(self._pair[slot] != pair)
        if len(new):
            asked, where = np.unique(pair[new], return_inverse=True)
            found = self._compatible(asked >> 20, asked & ((1 << 20) - 1))
            fits[new] = found[where]
            at = slot[new]
            self._fits[at], self._pair[at] = found[where], pair[new]
            # Of two pairs in one slot the last one stays: key and answer are set alike.
            self._fits[at] = np.where(self._pair[at] == pair[new], found[where], self._fits[at])
        return fits

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undoes the merges of both sides, latest first. A pair that stands at the
        border would merge if its rank comes before either part's own merge; of
        equal ranks the left one is merged first."""
        fits = np.ones(len(left), bool)
        live = np.arange(len(left))
        left, right = left.astype(np.int32), right.astype(np.int32)
        left_goes, right_goes = (np.full(len(left), _NEVER) for _ in range(2))
        while len(live):
            rank = self.rank(left.astype(np.int64) << 20 | right)
            merges = (rank >= 0) & (rank < left_goes) & (rank <= right_goes)
            fits[live[merges]] = False
            born_left, born_right = self.born[left], self.born[right]
            go = ~merges & ((born_left >= 0) | (born_right >= 0))
            live, left, right, left_goes, right_goes, born_left, born_right = (x[go] for x in (live, left, right, left_goes, right_goes, born_left, born_right))
            on_right = born_right >= born_left
            right_goes, left_goes = np.where(on_right, born_right, right_goes), np.where(on_right, left_goes, born_left)
            left, right = np.where(on_right, left, self.right[left]), np.where(on_right, self.left[right], right)
        return fits


    def compatible_one(self, left: int, right: int) -> bool:
        """As compatible, of one pair."""
        pair = left << 20 | right
        found = self._one.get(pair)
        if found is None:
            if len(self._one) >= PAIR_SLOTS:
                self._one.clear()
            found = self._one[pair] = self._fits_one(left, right)
        return found

    def _fits_one(self, left: int, right: int) -> bool:
        left_goes = right_goes = int(_NEVER)
        while True:
            rank = self.rank.one(left << 20 | right)
            if 0 <= rank < left_goes and rank <= right_goes:
                return False
            born_left, born_right = int(self.born[left]), int(self.born[right])
            if born_left < 0 and born_right < 0:
                return True
            if born_right >= born_left:
                right_goes, right = born_right, int(self.left[right])
            else:
                left_goes, left = born_left, int(self.right[left])


class Backtracker:
    """The encoder proper: token ids of pieces under a vocabulary without word ends."""

    def __init__(self, table: MergeTable):
        self.table = table
        words = [(s.encode("latin-1"), i) for s, i in table.ids.items() if not s.endswith(END)]
        ids = np.array([i for _, i in words])
        self.reader = Automaton([w[::-1] for w, _ in words])
        of_node = np.full(len(self.reader.fail), -1, np.int32)
        of_node[self.reader.node_of] = ids
        self.longest = self.reader.longest(of_node)
        # The next shorter token with which a token begins: the reversed one's proper suffix.
        self.shorter = np.full(len(table.text), -1, np.int32)
        self.shorter[ids] = self.longest[self.reader.fail[self.reader.node_of]]

    def encode(self, pieces: list[str], kind: np.dtype) -> dict[str, bytes]:
        """The ids of each piece as bytes of numbers of a kind."""
        raw = [p.encode() for p in pieces]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        short = np.flatnonzero(length <= LONG_PIECE)
        short = short[np.argsort(-length[short], kind="stable")]
        order = short.tolist()
        tokens, ends = self._side_by_side([raw[i] for i in order], length[short])
        flat, ends = tokens.astype(kind).tobytes(), (ends * kind.itemsize).tolist()
        out = {pieces[i]: flat[lo:hi] for i, lo, hi in zip(order, [0, *ends][: len(ends)], ends, strict=True)}
        for i in np.flatnonzero(length > LONG_PIECE).tolist():
            out[pieces[i]] = self._alone(raw[i]).astype(kind).tobytes()
        return out

    def _longest_at(self, data: np.ndarray, base: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place; pieces come longest first."""
        out = np.full(len(data), -1, np.int32)
        state = np.zeros(len(base), np.int32)
        last = base + length - 1
        for k in range(int(length[0])):
            n = int(np.searchsorted(-length, -k, "left"))  # pieces with more than k bytes
            at = last[:n] - k
            state = self.reader.step(state[:n], data[at])
            out[at] = self.longest[state]
        return out

    def _side_by_side(self, pieces: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, and where those of each piece end. ``pieces`` come longest first."""
        if not pieces or not length[0]:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        table = self.table
        base = np.cumsum(length) - length
        longest = self._longest_at(np.frombuffer(b"".join(pieces), np.uint8), base, length)
        longest = np.append(longest, np.int32(-1))
        dead = np.zeros(len(longest) + len(pieces), bool)  # a place after each piece's end too
        mark = base + np.arange(len(pieces))
        tokens, count = np.zeros(len(longest), np.int32), np.zeros(len(pieces), np.int64)
        live = np.flatnonzero(length > 0)
        at, token = np.zeros(len(live), np.int64), longest[base[live]]
        while len(live):
            stuck = token < 0
            back = np.flatnonzero(stuck)
            if len(back):
                who = live[back]
                if (count[who] == 0).any():
                    raise ValueError("the vocabulary cannot spell this text")
                dead[mark[who] + at[back]] = True
                count[who] -= 1
                token[back] = tokens[base[who] + count[who]]
                at[back] -= table.length[token[back]]
            end = at + table.length[token]
            fits = ~dead[mark[live] + end]
            tried = np.flatnonzero(fits & (count[live] > 0))
            before = tokens[base[live[tried]] + count[live[tried]] - 1]
            fits[tried] = table.compatible(before, token[tried])
            go = np.flatnonzero(fits)
            who = live[go]
            tokens[base[who] + count[who]] = token[go]
            count[who] += 1
            at[go] = end[go]
            other = np.flatnonzero(~fits)
            token[other] = self.shorter[token[other]]
            token[go] = longest[base[who] + end[go]]
            left = ~(fits & (end == length[live]))
            live, at, token = live[left], at[left], token[left]
        return tokens[np.repeat(base, count) + ranges(count)], np.cumsum(count)

    def _alone(self, piece: bytes) -> np.ndarray:
        """A long piece: its tokens in the same way, place by place."""
        table, n = self.table, len(piece)
        data = np.frombuffer(piece, np.uint8)
        longest = self._longest_at_alone(data)
        length, shorter, dead = table.length.tolist(), self.shorter, bytearray(n + 1)
        tokens: list[int] = []
        at, token = 0, int(longest[0])
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    if not tokens or table.compatible_one(tokens[-1], token):
                        break
                token = int(shorter[token])
            if token >= 0:
                tokens.append(token)
                at = end
                token = int(longest[at]) if at < n else -1
            else:
                dead[at] = 1
                if not tokens:
                    raise ValueError("the vocabulary cannot spell this text")
                token = tokens.pop()
                at -= length[token]
        return np.array(tokens, np.int32)

    def _longest_at_alone(self, data: np.ndarray) -> np.ndarray:
        """As _longest_at, for one piece in parts: the automaton's state after a part's end
        and as many bytes more as its deepest node is that of the whole piece."""
        deep, width = len(self.reader.by_depth), 512
        n = len(data)
        starts = np.arange(0, n, width)
        stops = np.minimum(starts + width + deep, n)
        length = stops - starts
        flat = data[np.repeat(starts, length) + ranges(length)]
        order = np.argsort(-length, kind="stable")
        found = self._longest_at(flat, (np.cumsum(length) - length)[order], length[order])
        return np.concatenate([found[b : b + min(width, n - s)] for b, s in zip((np.cumsum(length) - length).tolist(), starts.tolist(), strict=True)])


class Known:
    """What runs between spaces (behind their space) and bare pieces encode to, bounded in
    bytes: those met lately, and those met before, which go when the others are too many."""

    def __init__(self, limit: int | None = None):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.long: list[str] = []
        self.size, self.limit = 0, (KNOWN_BYTES if limit is None else limit) // 2

    def missing(self, runs: set[str]) -> list[str]:
        """Those of ``runs`` that are not known; the others are from now on met lately."""
        runs = runs.difference(self.new)
        old = {r: self.old[r] for r in runs if r in self.old} if self.old else {}
        self.add(old)
        return [r for r in runs if r not in old]

    def add(self, found: dict[str, bytes]) -> None:
        self.long += [r for r in found if len(r) > KNOWN_LENGTH]
        self.new.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)

    def add_bare(self, found: dict[str, bytes]) -> None:
        short = {p: x for p, x in found.items() if len(p) <= KNOWN_LENGTH}
        self.bare.update(short)
        self.size += sum(map(len, short)) + sum(map(len, short.values())) + ENTRY_BYTES * len(short)

    def turn(self) -> None:
        """After some texts: forgets long runs, and the older half if the newer one is full."""
        for r in self.long:
            if r in self.new:
                self.size -= len(r) + len(self.new.pop(r)) + ENTRY_BYTES
        self.long = []
        if self.size > self.limit:
            self.old, self.new, self.bare, self.size = self.new, {}, {}, 0


def parts_of(text: str) -> list[str]:
    """A text in parts of about LONG_TEXT: each but the first begins with a single space
    between two visible characters, where pieces begin anew."""
    cuts = [0]
    while len(text) - cuts[-1] > LONG_TEXT:
        border = _single_space.search(text, cuts[-1] + LONG_TEXT)
        if border is None:
            break
        cuts.append(border.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def batches_of(column: pa.Array, size: int | None = None) -> Iterator[list[str]]:
    """The texts of a column (null is empty) in lists of about ``size`` bytes."""
    size = ENCODE_BYTES if size is None else size
    lengths = np.array([x or 0 for x in pc.binary_length(column.cast(pa.large_string())).to_pylist()], np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield [t or "" for t in column.slice(at, to - at).to_pylist()]
        at = to


class RunWise:
    """Encodes texts of a byte-level vocabulary by the runs between their spaces, each once.

    A single space between two visible characters always begins a piece, so that each run
    can be encoded on its own with the space before it. Subclasses encode pieces.
    """

    kind: np.dtype

    def __init__(self, specials: dict[str, int]):
        self.pieces = regex.compile(BYTE_LEVEL_PATTERN)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.special_ids = {s: np.array([i], self.kind).tobytes() for s, i in specials.items()}

    def encode_pieces(self, words: list[str], pieces: list[str]) -> tuple[list[bytes], dict[str, bytes]]:
        """Ids of words with a space before each, and of other pieces."""
        raise NotImplementedError

    def _pieces_of(self, text: str) -> list[str]:
        """Pieces of any text; special tokens are pieces of their own."""
        if text.isalpha():
            return [text]
        if self.special is None or not self.special.search(text):
            return self.pieces.findall(text)
        return [p for part in self.special.split(text) for p in ([part] if part in self.special_ids else self.pieces.findall(part))]

    def _pieces_of_runs(self, runs: list[str]) -> list[list[str]]:
        """Pieces of visible runs without inner spaces, each with the space before it."""
        joined = " " + " ".join(runs) if runs else ""
        if self.special is not None and self.special.search(joined):
            return [self._pieces_of(" " + r) for r in runs]
        pieces = self.pieces.findall(joined)
        at = [k for k, p in enumerate(pieces) if p[0] == " "]
        return [pieces[lo:hi] for lo, hi in zip(at, [*at[1:], len(pieces)][: len(at)], strict=True)]

    def _learn(self, runs: list[str], odd: list[str], heads: list[str], known: Known) -> list[bytes]:
        """Makes runs known (``odd`` ones have spaces in them); ids of the heads of texts."""
        words = [r for r in runs if r.isalpha()]
        others = [r for r in runs if not r.isalpha()]
        cut = [*self._pieces_of_runs(others), *(self._pieces_of(" " + r) for r in odd), *map(self._pieces_of, heads)]
        ids, new = dict(self.special_ids), []
        for p in {p for x in cut for p in x}.difference(ids):
            held = known.new.get(p[1:]) if p[0] == " " and len(p) > 1 else known.bare.get(p)
            if held is None:
                new.append(p)
            else:
                ids[p] = held
        # A word met with marks behind it is known without them too.
        inner = [p[1:] for p in new if p[0] == " " and p[1:].isalpha()]
        words = list({*words, *inner})
        spaced = [" " + w for w in words]
        rest = [p for p in new if not (p[0] == " " and p[1:].isalpha())]
        of_words, found = self.encode_pieces(spaced, rest)
        learnt = dict(zip(words, of_words, strict=True))
        ids |= found
        ids.update((" " + w, learnt[w]) for w in inner)
        whole = [ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x]) for x in cut]
        learnt.update(zip([*others, *odd], whole, strict=False))
        known.add(learnt)
        known.add_bare({p: found[p] for p in rest if p[0] != " " or len(p) == 1})
        return whole[len(others) + len(odd) :]

    def encode_texts(self, texts: list[str], known: Known) -> list[np.ndarray]:
        """Ids of each text."""
        if len(texts) == 1 and len(texts[0]) > LONG_TEXT and len(parts := parts_of(texts[0])) > 1:
            return [np.concatenate([self.encode_texts([part], known)[0] for part in parts])]
        split, heads, seen, odd = [], [], set(), set()
        for text in texts:
            runs = text.split(" ")
            if len(runs) > 1 and (not runs[0] or not runs[-1] or _odd_space.search(text)):
                # Spaces that are no borders of pieces: at an end, or beside white space.
                runs = _single_space.split(text)
                heads.append(runs.pop(0))
                odd.update([r for r in runs if " " in r or r[-1].isspace()])
            else:
                heads.append(runs.pop(0))
            split.append(runs)
            seen.update(runs)
        missing = known.missing(seen)
        starts = self._learn([r for r in missing if r not in odd], [r for r in missing if r in odd], heads, known)
        get = known.new.__getitem__
        out = [np.frombuffer(head + b"".join(map(get, runs)), self.kind) for head, runs in zip(starts, split, strict=True)]
        known.turn()
        return out


class ByteLevelBpe(RunWise):
    """Encoder and decoder of a byte-level BPE file (no word ends)."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.tracker = Backtracker(self.table)
        words = [s.encode("latin-1") for s in self.table.text]
        for s, i in self.table.specials.items():
            words[i] = s.encode()
        self.kind = np.dtype("<u2" if len(words) <= 1 << 16 else "<u4")
        super().__init__(self.table.specials)
        self.known = Known()
        self.decimal = [str(i) for i in range(len(words))]
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])

    def encode_pieces(self, words: list[str], pieces: list[str]) -> tuple[list[bytes], dict[str, bytes]]:
        found = self.tracker.encode(words + pieces, self.kind)
        return [found[w] for w in words], found

    def encode(self, text: str) -> np.ndarray:
        return self.encode_texts([text], Known())[0].astype(np.uint32)

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids with commas between them."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist())).encode()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        return self.blob[ranges(lengths) + np.repeat(starts, lengths)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteLevelBpe:
    """One encoder a file and worker process, with what it knows of earlier texts."""
    return ByteLevelBpe(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text; null counts as empty and has no ids.

    Texts of any length are encoded whole; repeated rows and null ids stay rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            at = 0
            for texts in batches_of(batch.column(1)):
                ids = [x.astype(np.int32) for x in bpe.encode_texts(texts, bpe.known)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids]))], ["id", "ids"])
                at += len(texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of every row of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Per row of documents: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty; repeated rows give repeated results; a null
    doc_id stays null; an empty table gives no rows. Texts of any length are taken
    whole. Columns beside doc_id and text are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for texts in batches_of(batch.column("text")):
                for ids in bpe.encode_texts(texts, bpe.known):
                    rows[0].append(len(ids))
                    rows[1].append(hashlib.sha256(bpe.decimals(ids)).hexdigest())
                    rows[2].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(rows, list(schema)[1:], strict=True))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text there and back; see round_trips for odd rows."""
    return round_trips(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
