"""Byte-level BPE as a finite-state transducer, and decoding as a stream.

The ranks are compiled, as texts need it, into a deterministic transducer over
bytes. A sequence of tokens is the result of the merges if and only if every two
neighbours stand unmerged when they are encoded alone. So the transducer
guesses: a hypothesis is the last finished token and a node of the vocabulary's
trie. Sets of hypotheses become states when a text first leads to them; what all
hypotheses of a state share is emitted, after a lookahead that the longest token bounds. Each match of the split pattern
is encoded on its own; a match that is a token itself is that token.

Distinct pieces of the texts are encoded once (``pieces``): single spaces and
line feeds between others, and stops after letters, are bounds of matches. Texts
with other white space are matched as a whole.

Decoding reads ids in blocks through a state machine of UTF-8, which carries the
open character from token to token and block to block. Malformed bytes give U+FFFD.

Defined results: a null or empty text has no ids and decodes to nothing.
Repeated rows get equal results; extra columns stay inside ``row``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from readloom.llm import pieces
from readloom.llm.text import Texts, append, give_back, process_cache, ragged

VOCABULARY = "byte_bpe_50k.tiktoken"
LOW = (1 << 32) - 1
MOST_STATES = 400_000  # moves of the transducer, which is then built anew
LOOKAHEAD = 4096  # bytes of one match after which shared tokens are emitted
BLOCK_TOKENS = 1 << 16
TEXT_BLOCK = 1 << 20  # bytes of texts that are encoded together, or one text


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Ranks, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spines: dict[bytes, tuple] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """The merges one by one, for single tokens only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: bytes) -> tuple[bool, list, list]:
        """Whether the merges reach the token from its bytes, and the tokens at
        its right and left edge, smallest first, each with the rank that ends it."""
        if token not in self.spines:
            parts, last, first = [token[i : i + 1] for i in range(len(token))], [token[-1:]], [token[:1]]
            right, left = [], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if rank == 1 << 40:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == len(parts) - 1:
                    right.append((last[-1], rank))
                    last.append(parts[-1])
                if at == 0:
                    left.append((first[-1], rank))
                    first.append(parts[0])
            end = 1 << 41
            self.spines[token] = (len(parts) == 1, [*right, (last[-1], end)], [*left, (first[-1], end)])
        return self.spines[token]

    def side_by_side(self, one: bytes, two: bytes) -> bool:
        """Whether no merge crosses the bound between the two tokens."""
        return self._apart(self.spine(one)[1], self.spine(two)[2])

    def _apart(self, right: list, left: list) -> bool:
        i = j = 0
        while True:
            (a, ends_a), (b, ends_b) = right[i], left[j]
            rank = self.ranks.get(a + b, 1 << 40)
            if rank < ends_a and rank <= ends_b and rank < 1 << 40:
                return False
            if ends_a >= 1 << 40 and ends_b >= 1 << 40:
                return True
            if ends_a <= ends_b:  # of equal merges the left one comes first
                i += 1
            else:
                j += 1


class Transducer:
    """States are tuples of hypotheses (last finished token, trie node); the
    depth of the node says where the unfinished token starts. After each byte
    exactly one hypothesis is at the root, as every prefix has one encoding; the
    token that it has just finished is what the move tells."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.ranks = ranks
        self.size = [0] * (max(ranks.values(), default=-1) + 1)
        self.spelling = [b""] * len(self.size)
        self.children: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.token):
                    self.children.append({})
                    self.token.append(-1)
                    self.depth.append(0)
            self.token[node] = rank
            self.depth[node] = self.size[rank] = len(token)
            self.spelling[rank] = token
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            self.depth[node] = depth
            stack += [(child, depth + 1) for child in self.children[node].values()]
        self.beside: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states; they are built again as texts need them. A hypothesis
        is one number, (last token + 1) * 2^32 + node, and so is a move, keyed by
        state * 256 + byte: next state * 2^32 + finished token."""
        self.numbers = {(0,): 0}
        self.states: list[tuple[int, ...]] = [(0,)]
        self.moves: dict[int, int] = {}

    def follows(self, last: int, rank: int) -> bool:
        key = (last << 32) | rank
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > MOST_STATES:
                self.beside.clear()
            one, two = self.spelling[last], self.spelling[rank]
            known = self.beside[key] = self.merges.spine(two)[0] and self.merges.side_by_side(one, two)
        return known

    def move(self, state: int, byte: int) -> int:
        found, ended = [], -1
        children, token = self.children, self.token
        for hypothesis in self.states[state]:
            node = children[hypothesis & LOW].get(byte)
            if node is None:
                continue
            last = (hypothesis >> 32) - 1
            if children[node]:
                found.append((hypothesis & ~LOW) | node)
            rank = token[node]
            if ended < 0 <= rank and (self.follows(last, rank) if last >= 0 else self.merges.spine(self.spelling[rank])[0]):
                ended = rank
        found.append((ended + 1) << 32)
        found = tuple(found)
        to = self.numbers.get(found)
        if to is None:
            to = self.numbers[found] = len(self.states)
            self.states.append(found)
        out = self.moves[state << 8 | byte] = to << 32 | ended
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) > MOST_STATES:
            self.forget()
        state, ends, out, moves = 0, [], [], self.moves
        for byte in piece:
            to = moves.get(state << 8 | byte) or self.move(state, byte)
            state = to >> 32
            ends.append(to & LOW)
            if len(ends) >= LOOKAHEAD:
                ends = self.emit(state, ends, out)
        return out + self.back(ends, len(ends))

    def back(self, ends: list[int], at: int) -> list[int]:
        """The tokens that end at ``at``, read backwards."""
        out = []
        while at > 0:
            rank = ends[at - 1]
            out.append(rank)
            at -= self.size[rank]
        return out[::-1]

    def emit(self, state: int, ends: list[int], out: list[int]) -> list[int]:
        """Emit what all hypotheses share, and keep the rest."""
        places = {len(ends) - self.depth[hypothesis & LOW] for hypothesis in self.states[state]}
        while len(places) > 1:
            last = max(places)
            places.discard(last)
            places.add(last - self.size[ends[last - 1]])
        shared = places.pop()
        out += self.back(ends, shared)
        return ends[shared:]


#: Lead bytes of UTF-8 (first, last), the number of bytes that follow, and the range of the first of them.
LEADS = (
    [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F)]
    + [(0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
)
FOLLOWS = {byte: rest for first, last, *rest in LEADS for byte in range(first, last + 1)}
BAD = "\ufffd"


class Utf8:
    """UTF-8 as a state machine, byte by byte: how many bytes of the open
    character are still to come, the range of the next one, and the bits so far."""

    def __init__(self) -> None:
        self.need = self.low = self.high = self.point = 0

    def feed(self, data: bytes) -> str:
        """The characters that end in ``data``. A byte that can't go on with the
        open character ends it as U+FFFD and is looked at anew."""
        out = []
        for byte in data:
            if self.need and self.low <= byte <= self.high:
                self.need -= 1
                self.low, self.high, self.point = 0x80, 0xBF, self.point << 6 | byte & 0x3F
                if not self.need:
                    out.append(chr(self.point))
                continue
            out.append(self.end())
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in FOLLOWS:
                self.need, self.low, self.high = FOLLOWS[byte]
                self.point = byte & 0x3F >> self.need
            else:
                out.append(BAD)
        return "".join(out)

    def end(self) -> str:
        """What an open character leaves when nothing goes on with it."""
        self.need, was = 0, self.need
        return BAD if was else ""


class Codec:
    """Encoder and decoder of one vocabulary, kept by the worker process."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.pattern = regex.compile(pattern)
        self.table = pieces.Table(self._new)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # Tokens that are whole characters leave the decoder's state alone.
        self.whole = np.array([self._is_text(t) for t in self.tokens], bool)

    @staticmethod
    def _is_text(token: bytes) -> bool:
        try:
            token.decode()
            return True
        except UnicodeDecodeError:
            return False

    def _ids(self, text: str) -> list[int]:
        """By matches of the pattern over a text."""
        return [i for m in self.pattern.findall(text) for i in self.transducer.encode(m.encode())]

    def _new(self, spelled: list[bytes], tags: np.ndarray) -> list[np.ndarray]:
        del tags
        return [np.array(self._ids(piece.decode()), np.uint32) for piece in spelled]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each."""
        p = pieces.cut(data, offsets)
        n = len(p.starts)
        # What stands before a piece: 32, 10, or 0 at the start of a text.
        before = np.zeros(n, np.uint8)
        inner = np.ones(n, bool)
        filled = p.first[:-1] < p.first[1:]
        inner[p.first[:-1][filled]] = False
        before[inner] = data[p.starts[inner] - 1]
        # Texts with other white space than single spaces and line feeds are left to the pattern.
        odd = self._odd(data, offsets)
        tag = np.where(p.plain, pieces.BODY, pieces.RAW) + np.uint64(8) * (before == 32)
        body = pieces.keys(data, p.starts, p.middles, tag)
        stops, stop = np.zeros(n, np.uint64), p.ends > p.middles
        stops[stop] = pieces.keys(data, p.middles[stop], p.ends[stop], np.full(int(stop.sum()), pieces.STOPS))
        line = before == 10
        usual = np.repeat(~odd, np.diff(p.first))
        key, there = pieces.interleave((np.full(n, pieces.BREAK), line & usual), (body, usual), (stops, stop & usual))
        view = memoryview(data)

        def spell(at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
            piece, column = there[at] // 3, there[at] % 3
            begins = np.where(column == 2, p.middles[piece], p.starts[piece] - (before[piece] == 32))
            ends = np.where(column == 2, p.ends[piece], p.middles[piece])
            return [
                b"\n" if c == 0 else bytes(view[a:b])
                for c, a, b in zip(column.tolist(), begins.tolist(), ends.tolist(), strict=True)
            ], column

        ids, sizes = self.table.lookup(key, spell)
        done = np.concatenate([[0], np.cumsum(sizes)])
        edges = done[np.searchsorted(there, 3 * p.first)]
        if not odd.any():
            return ids, np.diff(edges)
        parts = [
            np.array(self._ids(bytes(view[offsets[i] : offsets[i + 1]]).decode()), np.uint32) if odd[i] else ids[edges[i] : edges[i + 1]]
            for i in range(len(odd))
        ]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    @staticmethod
    def _odd(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with two white-space characters in a row, or with one at an end,
        or with a piece that has white space inside it that may count as such."""
        blank = (data == 32) | (data == 10)
        twice = np.zeros(len(data), bool)
        twice[1:] = blank[1:] & blank[:-1]
        # White space past ASCII starts with C2, E1, E2 or E3.
        strange = ((data < 32) & (data != 10)) | (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        count = np.zeros(len(data) + 1, np.int64)
        np.cumsum(twice | strange, out=count[1:])
        odd = count[offsets[1:]] > count[offsets[:-1]]
        full = offsets[1:] > offsets[:-1]
        odd[full] |= blank[offsets[:-1][full]] | blank[offsets[1:][full] - 1]
        return odd

    def stream(self, blocks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of each block of ids; an incomplete character waits for the next.
        Only tokens that are not whole characters move the machine."""
        machine = Utf8()
        for ids in blocks:
            parts, at = [], 0
            for place in np.flatnonzero(~self.whole[ids]).tolist():
                parts += [self._between(machine, ids[at:place]), machine.feed(self.tokens[ids[place]])]
                at = place + 1
            yield "".join(parts) + self._between(machine, ids[at:])
        yield machine.end()

    def _between(self, machine: Utf8, ids: np.ndarray) -> str:
        """Text of tokens that are whole characters. The first of their bytes
        continues no character, so one that is open ends there."""
        return machine.end() + b"".join([self.tokens[i] for i in ids.tolist()]).decode() if len(ids) else ""

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.stream(ids[i : i + BLOCK_TOKENS] for i in range(0, len(ids), BLOCK_TOKENS)))


def codec(vocabulary: str) -> Codec:
    path = public_tokenizers.path(vocabulary)
    return process_cache(f"codec {path}", lambda: Codec(path, public_tokenizers.PATTERN))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """``row`` and ids (array of int)."""

    def kernel(texts: Texts) -> list[pa.Array]:
        own, flat, counts = codec(vocabulary), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first, last in texts.blocks(TEXT_BLOCK):
            ids, sizes = own.encode(*texts.part(first, last))
            flat.append(ids)
            counts.append(sizes)
            give_back()
        return [ragged(np.concatenate(flat).astype(np.int32), np.concatenate(counts))]

    return append(docs, kernel, "ids array<int>", keep=keep)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``row``, n_tokens, ids_sha256, decoded_sha256 of the text that the ids decode
    to, and the ids (binary, little-endian unsigned 32-bit integers) if asked for."""

    def kernel(texts: Texts) -> list[pa.Array]:
        own, rows = codec(vocabulary), []
        for first, last in texts.blocks(TEXT_BLOCK):
            ids, sizes = own.encode(*texts.part(first, last))
            edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                back = own.decode(ids[a:b]).encode()
                data = ids[a:b].astype("<u4").tobytes()
                rows.append((b - a, hashlib.sha256(data).hexdigest(), hashlib.sha256(back).hexdigest(), data if with_ids else None))
            give_back()
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary())
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)][: 4 if with_ids else 3]

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return append(docs, kernel, schema, keep=keep)
