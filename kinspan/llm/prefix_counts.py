"""Exact token counts at every prefix of a text, by dynamic programming.

For each place of a piece (a word, in bytes) the encoding of the bytes up to there
has one last token; it is the one token ending there that is compatible with the last
token of what comes before it. So ``count[end] = count[start] + 1`` fills the counts of
all prefixes in one pass over the Aho-Corasick matches. A vocabulary with word ends asks
the same of the tokens that close a word: they give the count of the prefix as a text of
its own. Pieces are independent, so a text's table, with an entry for every code point,
is the running sum over its pieces with the counts within each; the tokens of the text,
whether it exceeds a budget, and where it has to be cut are read from that table and
nothing is encoded again.

Runs between spaces are found, hashed and looked up as arrays. The pieces of those that a
batch brings anew are filled in side by side, an array step a byte.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import END, Automaton, MergeTable
from .runs import RunTable, blocks_of, different_runs
from .shared import read_table
from .words import CHUNK_BYTES, chunks, ranges

TOKEN_LIMIT = 2048
#: The pattern of the pieces of a vocabulary that marks word ends.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Runs between spaces whose tables a worker keeps (about 90 bytes each).
KNOWN_RUNS = 1 << 20
_ENTRY = np.dtype("<u4")
#: Bytes of a piece that are filled in alone in the time of a step of many pieces.
ALONE = 40
#: Code points up to which a piece is taken anew rather than gone on with.
SHORT_TAIL = 8
#: Runs between spaces of a text whose table is held at once.
TABLE_RUNS = 1 << 17


@dataclass
class Filled:
    """Tables of some pieces, an entry a byte: piece i has ``length[i]`` from ``base[i]`` on.

    ``last`` and ``inner`` are the last token and the count of the bytes up to there as part
    of a word, ``final`` their count as a word of their own, ``state`` the automaton's;
    ``ends`` tells bytes that end a code point, ``points`` how many did before each byte.
    """

    base: np.ndarray
    length: np.ndarray
    last: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    state: np.ndarray
    ends: np.ndarray
    points: np.ndarray


class Growing:
    """Counts of a piece that goes on in this way or that: behind the first bytes of a piece
    of ``filled``, or from nothing. What two ways have in common is not filled in twice."""

    def __init__(self, counter: PrefixCounter, filled: Filled | None = None, base: int = 0, n: int = 0):
        self.counter, self.filled, self.base, self.n = counter, filled, base, n
        self.held = b""
        self.steps: list[tuple[int, int, int, int]] = []  # state, last token, count, count as a word

    def _before(self, k: int) -> tuple[int, int]:
        if k >= self.n:
            return self.steps[k - self.n][1:3]
        return int(self.filled.last[self.base + k]), int(self.filled.inner[self.base + k])

    def _closing(self, token: int, k: int) -> tuple[int, int]:
        counter = self.counter
        while token >= 0:
            before = k - counter.sizes[token]
            if before < 0:
                return token, 1
            prior, count = self._before(before)
            if prior >= 0 and counter.table.compatible_one(prior, token):
                return token, count + 1
            token = counter.shorters[token]
        return -1, 0

    def count(self, more: bytes) -> int:
        """Tokens of the piece's first bytes and ``more``."""
        if not more:
            return int(self.filled.final[self.base + self.n - 1])
        keep = len(more) if self.held.startswith(more) else next((i for i, (x, y) in enumerate(zip(self.held, more, strict=False)) if x != y), len(self.held))
        del self.steps[keep:]
        self.held = more
        for k in range(self.n + keep, self.n + len(more)):
            state = self.steps[-1][0] if self.steps else int(self.filled.state[self.base + self.n - 1]) if self.n else 0
            state = self.counter.reader.step_one(state, more[k - self.n])
            final = self._closing(int(self.counter.ending[1][state]), k)[1]
            self.steps.append((state, *self._closing(int(self.counter.ending[0][state]), k), final))
        return self.steps[len(more) - 1][3]


class PrefixCounter:
    """Token counts of texts under a BPE file with word ends (white space is dropped)."""

    def __init__(self, path: str):
        self.table = table = MergeTable(path)
        if not table.marks_ends:
            raise ValueError("a vocabulary with word ends is needed")
        self.pieces = regex.compile(WORD_PATTERN)
        self.pieces_and_spaces = regex.compile(WORD_PATTERN + r"|\p{White_Space}+")
        self.special = re.compile("(" + "|".join(map(re.escape, table.specials)) + ")")
        self.normalizer = Tokenizer.from_file(path).normalizer
        inner = [(s.encode("latin-1"), i) for s, i in table.ids.items() if not s.endswith(END)]
        final = [(s[:-1].encode("latin-1"), i) for s, i in table.ids.items() if s.endswith(END)]
        self.reader = Automaton([w for w, _ in inner + final])
        nodes = np.array(self.reader.node_of)
        self.known = RunTable(_ENTRY, KNOWN_RUNS)
        self.size = np.zeros(len(table.text), np.int32)  # bytes of a token, its end mark not counted
        self.shorter = np.full(len(table.text), -1, np.int32)  # the next shorter token that ends there too
        self.ending: list[np.ndarray] = []
        for words, own in ((inner, nodes[: len(inner)]), (final, nodes[len(inner) :])):
            ids = np.array([i for _, i in words])
            of_node = np.full(len(self.reader.fail), -1, np.int32)
            of_node[own] = ids
            longest = self.reader.longest(of_node)
            self.ending.append(longest)
            self.size[ids] = [len(w) for w, _ in words]
            self.shorter[ids] = longest[self.reader.fail[own]]
        self.sizes, self.shorters = self.size.tolist(), self.shorter.tolist()

    def prefix_counts(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each prefix of each piece (in code points, from one on) as a word of its
        own, in one array; where each piece begins there, and its code points."""
        filled = self.fill(pieces)
        sizes = filled.points[filled.base + filled.length] - filled.points[filled.base]
        return filled.final[filled.ends], filled.points[filled.base], sizes

    def fill(self, pieces: list[str]) -> Filled:
        """The tables of some pieces."""
        raw = [p.encode() for p in pieces]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-length, kind="stable")
        base = np.zeros(len(raw), np.int64)
        base[order] = np.cumsum(length[order]) - length[order]
        data = np.frombuffer(b"".join([raw[i] for i in order.tolist()]), np.uint8)
        # A step side by side takes as long as ALONE bytes of a piece alone: the longest ones
        # go alone as far as the others then have so many fewer steps.
        falling = np.append(length[order], 0)
        n = int(np.argmin(np.append(0, np.cumsum(falling[:-1])) + ALONE * falling))
        ends = np.cumsum(length[order[:n]]).tolist()
        held = ends[-1] if n else 0
        states = self.reader.states(data[:held], length[order[:n]])
        parts = [self._fill_alone(states[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)]
        if n < len(raw):
            parts.append(self._fill(data[held:], length[order[n:]]))
        columns = (np.concatenate([np.zeros(0, np.int32), *own]) for own in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 4
        # Code points end before each byte that begins one.
        ends = np.append((data[1:] & 0xC0) != 0x80, True) if len(data) else np.zeros(0, bool)
        return Filled(base, length, *columns, ends, np.concatenate([[0], np.cumsum(ends)]))

    def _fill_alone(self, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """As _fill, of one long piece with its states, place by place."""
        size, shorter, fits = self.sizes, self.shorters, self.table.compatible_one
        last, inner, final = [], [], []
        for k, (token, closing) in enumerate(zip(self.ending[0][state].tolist(), self.ending[1][state].tolist(), strict=True)):
            for kind, token in ((0, token), (1, closing)):
                count = 0
                while token >= 0:
                    before = k - size[token]
                    if before < 0:
                        count = 1
                        break
                    if last[before] >= 0 and fits(last[before], token):
                        count = inner[before] + 1
                        break
                    token = shorter[token]
                if kind:
                    final.append(count)
                else:
                    last.append(token)
                    inner.append(count)
        return tuple(np.array(x, np.int32) for x in (last, inner, final)) + (state,)

    def _fill(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Last tokens, inner and closing counts and states at the end of each byte of the
        pieces; longest pieces first."""
        base = np.cumsum(length) - length
        last, inner = np.full(len(data), -1, np.int32), np.zeros(len(data), np.int32)
        final, states = np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
        state = np.zeros(len(length), np.int32)
        for k in range(int(length[0])):
            n = int(np.searchsorted(-length, -k, "left"))  # pieces with more than k bytes
            at = base[:n] + k
            state = states[at] = self.reader.step(state[:n], data[at])
            token, count = self._closing(self.ending[0][state], k, at, last, inner)
            last[at], inner[at] = token, count
            final[at] = self._closing(self.ending[1][state], k, at, last, inner)[1]
        return last, inner, final, states

    def _closing(self, token: np.ndarray, k: int, at: np.ndarray, last: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token that ends after byte k of each piece and fits what comes before it
        (-1: none), and the count there. ``token`` holds the longest ones ending there."""
        token, count = token.copy(), np.zeros(len(token), np.int32)
        live = np.flatnonzero(token >= 0)
        while len(live):
            size = self.size[token[live]]
            whole = size == k + 1
            before = at[live] - size
            prior = np.where(whole, -1, last[np.where(whole, 0, before)])
            fits = whole.copy()
            ask = np.flatnonzero(prior >= 0)
            fits[ask] = self.table.compatible(prior[ask], token[live[ask]])
            done = live[fits]
            count[done] = np.where(whole[fits], 1, inner[np.where(whole[fits], 0, before[fits])] + 1)
            live = live[~fits]
            token[live] = self.shorter[token[live]]
            live = live[token[live] >= 0]
        return token, count

    def run_tables(self, runs: list[str], known: dict[str, bytes]) -> list[bytes]:
        """Of each run between spaces: tokens of each of its prefixes (32-bit numbers, a code
        point each) and, for the space after it, those of the whole."""
        out: list = [None] * len(runs)
        lowered = [self._folded(r) for r in runs]
        plain = [i for i, r in enumerate(lowered) if r is not None]
        pieces = self.pieces_and_spaces.findall(" ".join([lowered[i] for i in plain]) + " ") if plain else []
        number = {p: k for k, p in enumerate(set(pieces))}
        width = np.fromiter(map(len, number), np.int64, len(number))
        names, table = [], [np.zeros(0, np.int32)]
        held, base, size = 0, np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        for p, k in number.items():
            own = known.get(p)
            if p in CONTRACTIONS:
                own = np.array([*range(1, len(p)), self._tokens_of(p)], np.int32)
            elif own is not None and p.isalpha():  # met as a run of one piece
                own = np.frombuffer(own, "<u4")[:-1].astype(np.int32)
            elif self.pieces.match(p):
                names.append(p)
                continue
            else:
                continue
            base[k], size[k] = held, len(own)
            held += len(own)
            table.append(own)
        if names:
            found, at, n = self.prefix_counts(names)
            where = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
            base[where], size[where] = at + held, n
            table.append(found)
        counts = np.concatenate(table).astype(np.int64)
        total = np.zeros(len(number), np.int64)
        total[size > 0] = counts[(base + size - 1)[size > 0]]
        each = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        before = np.cumsum(total[each]) - total[each]
        flat = np.repeat(before, width[each])
        flat[np.repeat(size[each] > 0, width[each])] += counts[np.repeat(base[each], size[each]) + ranges(size[each])]
        ends = np.cumsum([len(runs[i]) + 1 for i in plain])
        if plain:
            starts = np.append(0, flat[ends[:-1] - 1])
            flat -= np.repeat(starts, np.diff(ends, prepend=0))
        raw = flat.astype("<u4").tobytes()
        for i, lo, hi in zip(plain, [0, *(4 * ends).tolist()], (4 * ends).tolist(), strict=False):
            out[i] = raw[lo:hi]
        for i, r in enumerate(lowered):
            if r is None:
                out[i] = self._odd_run(runs[i]).astype("<u4").tobytes()
        return out

    def _folded(self, run: str) -> str | None:
        """A run as the vocabulary's normaliser leaves it, if a code point stays one and on
        its own; None for special tokens and for characters that change one another."""
        if run.isascii():
            return None if "<|" in run and self.special.search(run) else run.lower()
        if self.special.search(run) or not unicodedata.is_normalized("NFC", run):
            return None
        low = run.replace("Σ", "σ").lower()
        if len(low) != len(run):
            return None
        solid = "".join(low.split())
        return low if solid == "".join(self.normalizer.normalize_str(run).split()) and " " not in low else None

    def _tokens_of(self, piece: str) -> int:
        """Tokens of a piece taken whole."""
        return Growing(self).count(piece.encode())

    def _odd_run(self, run: str) -> np.ndarray:
        """The table of a run in which code points change one another or special tokens stand.

        A special token only splits the run; what stands before it goes on up to its last
        code point but one, as long as it isn't complete.
        """
        texts, marks, at = [], [*self.special.finditer(run)], 0
        for m in marks:
            texts.append(run[at : m.end() - 1])
            at = m.end()
        found = self._prefixes([*texts, run[at:]])
        out, held, at = [], 0, 0
        for m, counts in zip(marks, found, strict=False):
            out.append(counts + held)
            before = m.start() - at
            held += (int(counts[before - 1]) if before else 0) + 1
            out.append(np.array([held]))
            at = m.end()
        out.append(found[-1] + held)
        flat = np.concatenate(out)
        return np.append(flat, flat[-1] if len(flat) else 0)

    def _prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of the prefixes of 1, 2, ... code points of texts without special tokens.

        A text falls into clusters, before each of which nothing that comes later changes
        what the normaliser made of the code points before (see ``_begins``). So the whole
        normalised text's table tells the prefixes that end with a cluster. Within one, the
        table goes on from the cluster's begin over what the normaliser makes of its part.
        """
        cuts = [[k for k, c in enumerate(t) if k == 0 or _begins(c)] for t in texts]
        seen: dict[str, str] = {}

        def normal(part: str) -> str:
            if part not in seen:
                seen[part] = self.normalizer.normalize_str(part)
            return seen[part]

        parts = [[normal(t[a:b]) for a, b in zip(c, [*c, len(t)][1:], strict=True)] for t, c in zip(texts, cuts, strict=True)]
        whole = ["".join(p) for p in parts]
        split = [[(m.start(), m.group()) for m in self.pieces.finditer(w)] for w in whole]
        names = list({p for own in split for _, p in own})
        filled, number = self.fill(names), {p: k for k, p in enumerate(names)}
        ends = [np.flatnonzero(filled.ends[b : b + n]) for b, n in zip(filled.base.tolist(), filled.length.tolist(), strict=True)]
        known: dict[str, int] = {}

        def tokens(text: str, last: Growing) -> int:
            *names, tail = self.pieces.findall(text) or [""]
            for p in names:
                if p not in known:
                    known[p] = self._tokens_of(p)
            return sum(known[p] for p in names) + (last.count(tail.encode()) if tail else 0)

        out = []
        for text, cut, part, normed, pieces in zip(texts, cuts, parts, whole, split, strict=True):
            counts, held, reached = np.zeros(len(normed) + 1, np.int64), 0, 0
            for start, p in pieces:
                k = number[p]
                counts[reached + 1 : start + 1] = held
                own = filled.final[filled.base[k] + ends[k]].astype(np.int64)
                if p in CONTRACTIONS:
                    own[:-1] = range(1, len(p))
                reached = start + len(p)
                counts[start + 1 : reached + 1] = held + own
                held += int(own[-1])
            counts[reached + 1 :] = held
            places = np.cumsum([0, *map(len, part)])
            starts = [start for start, _ in pieces]
            table = np.zeros(len(text), np.int64)
            for k, begin in enumerate(cut):
                end, place = cut[k + 1] if k + 1 < len(cut) else len(text), int(places[k])
                table[end - 1] = counts[places[k + 1]]
                last, grown = Growing(self), None
                for inside in range(begin + 1, end):
                    other = normal(text[begin:inside])
                    if normed.startswith(other, place):
                        table[inside - 1] = counts[place + len(other)]
                        continue
                    j = bisect_left(starts, place) - 1  # the last piece that begins before the cluster
                    if j < 0 or starts[j] + len(pieces[j][1]) < place:
                        table[inside - 1] = counts[place] + tokens(other, last)
                        continue
                    if j and pieces[j - 1][1] == "'" and starts[j] == starts[j - 1] + 1 and place - starts[j - 1] < 3:
                        j -= 1  # with what follows it may become a contraction
                    start = starts[j]
                    if place - start <= SHORT_TAIL:
                        table[inside - 1] = counts[start] + tokens(normed[start:place] + other, last)
                    else:
                        kind = _letters if _letters.match(normed, place - 1) else _marks
                        more = kind.match(other).group()
                        piece = number[pieces[j][1]]
                        grown = grown or Growing(self, filled, int(filled.base[piece]), int(ends[piece][place - start - 1]) + 1)
                        table[inside - 1] = counts[start] + grown.count(more.encode()) + tokens(other[len(more) :], last)
            out.append(table)
        return out

    def tables(self, column: pa.Array) -> Iterator[list[tuple[int, np.ndarray]]]:
        """Number and table (tokens of the prefixes of 1, 2, ... code points) of the texts of a
        column, some at a time; the table of a long text comes in several parts."""
        for first, _, data, offsets in chunks(column):
            spaces = np.flatnonzero(data == 32)
            starts, ends = np.sort(np.append(offsets[:-1], spaces + 1)), np.sort(np.append(offsets[1:], spaces))
            # The runs of text i are those from begins[i] to begins[i + 1].
            begins = np.arange(len(offsets)) + np.searchsorted(spaces, offsets)
            held = np.uint32(0)
            for lo, hi in self._blocks(starts, ends):
                flat, sizes = self._runs(data[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])
                stops = np.cumsum(sizes)
                totals = flat[stops - 1]
                before = np.cumsum(totals, dtype=np.uint32) - totals
                texts = np.arange(np.searchsorted(begins, lo, "right") - 1, np.searchsorted(begins, hi, "left"))
                heads = np.maximum(begins[texts], lo) - lo
                owner = np.repeat(np.arange(len(texts)), np.diff(np.append(heads, hi - lo)))
                base = before - before[heads][owner]
                if begins[texts[0]] < lo:
                    base[owner == 0] += held
                flat = flat + np.repeat(base, sizes)
                held = flat[-1]
                edges = [*(stops[heads] - sizes[heads]).tolist(), len(flat)]
                out = []
                for k, (text, a, b) in enumerate(zip(texts.tolist(), edges, edges[1:], strict=False)):
                    # No space follows a text's last run.
                    whole = begins[text + 1] <= hi
                    out.append((first + text, flat[a : b - 1] if whole else flat[a:b]))
                yield out

    @staticmethod
    def _blocks(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        for lo, hi in blocks_of(starts, ends, CHUNK_BYTES):
            for at in range(lo, hi, TABLE_RUNS):
                yield at, min(hi, at + TABLE_RUNS)

    def _runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of runs one behind the other, and how many entries each has."""
        key, check, at, which = different_runs(data, starts, ends)
        if self.known.n + len(at) > self.known.entries:
            self.known = RunTable(_ENTRY, max(KNOWN_RUNS, len(at)))
        entry = self.known.find(key, check)
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            runs = [raw[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            entry[new] = self.known.add(key[new], check[new], self.run_tables(runs, {}))
        return self.known.gather(entry[which])

    def count(self, text: str) -> int:
        return int(self.table_of(text)[-1])

    def table_of(self, text: str) -> np.ndarray:
        """Tokens of the prefixes of 0, 1, 2, ... code points."""
        return np.concatenate([np.zeros(1, np.uint32), *(part for batch in self.tables(pa.array([text])) for _, part in batch)])


_letters, _marks = regex.compile(r"\p{L}*"), regex.compile(r"[^\p{White_Space}\p{L}\p{N}]*")


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Code points of class 0 that can combine with one before them: the second ones of
    canonical pairs, and the vowels and finals of Hangul."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x20000))  # none beyond
    seconds = {chr(int(x[1], 16)) for x in pairs if len(x) == 2 and x[0][0] != "<"}
    return frozenset(seconds) | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


def _begins(c: str) -> bool:
    """Whether normalising never changes what stands before ``c`` for what comes from it on."""
    return c < "\u0300" or not unicodedata.combining(c) and c not in _joining() and not unicodedata.combining((unicodedata.normalize("NFD", c))[0])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, counts array<int>): tokens of each text's prefixes of 0, 1, 2, ... code points.

    Null text counts as empty (counts is [0]); a null doc_id stays null; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(path)
        for batch in batches:
            waiting: list[list[np.ndarray]] = []
            ready = 0

            def rows(upto: int, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                """The rows from ``ready`` on, of the tables that wait."""
                parts = [np.concatenate(w).astype(np.int32) for w in waiting]
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(ready, upto - ready), pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *parts]))], ["doc_id", "counts"])

            for found in prefixes.tables(batch.column("text")):
                for text, part in found:
                    if text == ready + len(waiting):
                        waiting.append([np.zeros(1, np.uint32)])
                    waiting[-1].append(part)
                # The last one may go on.
                if len(waiting) > 1:
                    last = waiting.pop()
                    yield rows(ready + len(waiting))
                    ready, waiting = ready + len(waiting), [last]
            if waiting:
                yield rows(ready + len(waiting))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, counts array<int>")


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per row of documents: doc_id, n_bytes, n_tokens, over_limit, fitting_chars.

    All are read from the text's prefix table; fitting_chars is the code points of the
    longest prefix of at most ``limit`` tokens. Null text counts as empty; a null doc_id
    stays null; repeated rows give repeated results; an empty table gives no rows; texts of
    any length are taken whole, with a bounded part of their table at once; other columns
    are not read. Time grows with the text, whatever its script, special tokens and marks;
    only thousands of marks on one letter take time with the square of their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(path)
        for batch in batches:
            n = batch.num_rows
            bytes_ = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            tokens, fits, done = [0] * n, [0] * n, [0] * n
            for found in prefixes.tables(batch.column("text")):
                for text, part in found:
                    if len(part):
                        tokens[text] = int(part[-1])
                        # Counts may fall where code points join: the last place within the limit.
                        if tokens[text] <= limit:
                            fits[text] = done[text] + len(part)
                        elif len(inside := np.flatnonzero(part <= limit)):
                            fits[text] = done[text] + int(inside[-1]) + 1
                        done[text] += len(part)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bytes_, pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_()), pa.array(fits, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, by token_counts' prefix tables."""
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
