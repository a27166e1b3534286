"""Byte-level BPE encoding and decoding by finite-state transducers.

Encoding. A sequence of tokens is the encoding of its bytes exactly if each two
neighbours are (``Merges.compatible``). That makes encoding a nondeterministic
transducer: a configuration is (last token, place in the token trie, output not
yet emitted). ``Transducer`` determinises it lazily: a state is the set of
configurations that are alive after a prefix, its transitions are built when a
byte first needs them, and what all configurations agree on is emitted. A state
never waits for more than the longest token, so its lookahead is bounded.

Decoding. ``Utf8Decoder`` walks the tokens' bytes through a UTF-8 state machine;
(state, token) transitions are built when first needed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rondel.llm.shared import lean, small_batches

#: Entries of the tables that grow with the text; full, they lose their elder (words), younger (states) or all (pairs) entries.
WORDS_KEPT, STATES_KEPT, PAIRS_KEPT = 150_000, 100_000, 200_000
#: Rows that a worker turns into Python objects at once.
ROWS = 200


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, of a rank file's lines."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Merges:
    """What the ranks say about pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._spine: dict[tuple[int, int], list[tuple[bytes, float]]] = {}
        self._known: dict[int, bool] = {}

    def merge(self, piece: bytes, below: float = float("inf")) -> list[bytes]:
        """Merge the leftmost pair of the least rank, again and again, as long as that rank is under ``below``."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below or rank == float("inf"):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The pieces at the token's last (side 1) or first (side 0) byte as it grows: (piece, rank of the merge that ends it)."""
        found = self._spine.get((token, side))
        if found is None:
            whole = self.bytes[token]
            halves = self.merge(whole, token) if len(whole) > 1 else []
            if len(halves) == 2:
                inner = self.spine(self.ranks[halves[side]], side)
                found = [*inner[:-1], (halves[side], token), (whole, float("inf"))]
            else:
                found = [(whole, float("inf"))]
            self._spine[token, side] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """No merge joins bytes of both tokens when their bytes are encoded together."""
        pair = left << 32 | right
        known = self._known.get(pair)
        if known is None:
            if len(self._known) >= PAIRS_KEPT:
                self._known.clear()
            known = self._known[pair] = self._compatible(self.spine(left, 1), self.spine(right, 0))
        return known

    def _compatible(self, ends: list, begins: list) -> bool:
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = ends[i], begins[j]
            across = self.ranks.get(a + b, float("inf"))
            # Equal ranks: the pair further left merges first, so left's own merge precedes, right's follows.
            if across < a_ends and across <= b_ends and across != float("inf"):
                return False
            if a_ends == b_ends == float("inf"):
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1


class Transducer:
    """Bytes of one piece -> its tokens."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for token, rank in merges.ranks.items():
            node = 0
            for b in token:
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.token):
                    self.children.append({})
                    self.token.append(-1)
            self.token[node] = rank
        # A state is its configurations' fields in a row: last token, node, held, last token, ...
        start = (-1, 0, ())
        self.states: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        # State and byte -> the next state, with what is emitted if anything is.
        self.moves: dict[int, int | tuple[int, tuple]] = {}

    def _forget(self) -> None:
        """Drop the younger half of the states: the beginnings of frequent pieces came first."""
        kept = STATES_KEPT // 2
        for state in self.states[kept:]:
            del self.number[state]
        del self.states[kept:]
        self.moves = {key: to for key, to in self.moves.items() if key >> 8 < kept and (to if to.__class__ is int else to[0]) < kept}

    def _move(self, state: int, byte: int) -> int | tuple[int, tuple]:
        alive, boundary = [], None
        children, tokens, fields = self.children, self.token, iter(self.states[state])
        for last, node, held in zip(fields, fields, fields):
            node = children[node].get(byte)
            if node is None:
                continue
            if children[node]:
                alive.append((last, node, held))
            if boundary is None:
                token = tokens[node]
                if token >= 0 and (last < 0 or self.merges.compatible(last, token)):
                    boundary = (token, 0, (*held, token))
        alive.append(boundary)
        # What the least and the largest output begin with, all do.
        outputs = [held for _, _, held in alive]
        least, largest, agreed = min(outputs), max(outputs), 0
        for x, y in zip(least, largest):
            if x != y:
                break
            agreed += 1
        emitted = least[:agreed]
        reached = tuple([x for last, node, held in alive for x in (last, node, held[agreed:])])
        number = self.number.get(reached)
        if number is None:
            number = self.number[reached] = len(self.states)
            self.states.append(reached)
        self.moves[state << 8 | byte] = found = (number, emitted) if emitted else number
        return found

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > STATES_KEPT:
            self._forget()
        state, out, known = 0, [], self.moves.get
        for byte in piece:
            found = known(state << 8 | byte)
            if found is None:
                found = self._move(state, byte)
            if found.__class__ is int:
                state = found
            else:
                state, emitted = found
                out += emitted
        # The configuration at a boundary, the last one, holds the rest.
        return out + list(self.states[state][-1]) if piece else out


class Utf8Decoder:
    """Tokens -> text, incrementally: bytes of a character that tokens cut are held until it is whole.

    Bytes that are not UTF-8 become U+FFFD, one for each maximal valid beginning,
    as the Unicode standard recommends.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self._moves: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}
        self.reset()

    def reset(self) -> None:
        self.held = b""

    @staticmethod
    def _lead(byte: int) -> tuple[int, int, int]:
        """(bytes that must follow, least and largest second byte); 0, 0, 0: not a lead byte."""
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return 0, 0, 0

    def _step(self, held: bytes, token: int) -> tuple[bytes, str]:
        out: list[str] = []
        for b in self.tokens[token]:
            if held:
                need, low, high = self._lead(held[0])
                if len(held) > 1:
                    low, high = 0x80, 0xBF
                if low <= b <= high:
                    held += bytes([b])
                    if len(held) == need + 1:
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held = b""
            if b < 0x80:
                out.append(chr(b))
            elif self._lead(b)[0]:
                held = bytes([b])
            else:
                out.append("�")
        return held, "".join(out)

    def feed(self, ids) -> str:
        """The text that these tokens complete."""
        held, out = self.held, []
        moves = self._moves[held]
        for token in ids:
            move = moves.get(token)
            if move is None:
                move = moves[token] = self._step(held, token)
            if move[0] != held:
                held = move[0]
                moves = self._moves.setdefault(held, {})
            out.append(move[1])
        self.held = held
        return "".join(out)

    def finish(self) -> str:
        """What is left at the end."""
        text = "�" if self.held else ""
        self.reset()
        return text


def ascii_pattern(pattern: str) -> str | None:
    """A pattern that splits ASCII texts alike with the standard library, which is faster; None if there are other properties than letters and numbers."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        if pattern.startswith((r"\p{L}", r"\p{N}"), at):
            letters = "A-Za-z" if pattern[at + 3] == "L" else "0-9"
            out.append(letters if inside else f"[{letters}]")
            at += 5
            continue
        step = 2 if pattern[at] == "\\" else 1
        if pattern[at : at + 2] in (r"\p", r"\P"):
            return None
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at : at + step])
        at += step
    return "".join(out)


class Codec:
    """Encodes and decodes whole texts with one rank file and one splitting pattern."""

    def __init__(self, raw: bytes, pattern: str):
        self.merges = Merges(parse_ranks(raw))
        self.ranks, self.tokens = self.merges.ranks, self.merges.bytes
        self._split = regex.compile(pattern).findall
        narrow = ascii_pattern(pattern)
        self._split_ascii = re.compile(narrow, re.ASCII).findall if narrow else self._split
        self.names = [str(i) for i in range(max(self.tokens, default=-1) + 1)]
        self.decoder = Utf8Decoder(self.tokens)
        # Two generations: what the younger lacks is looked for in the older.
        self._words: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        return (self._split_ascii if text.isascii() else self._split)(text)

    @cached_property
    def transducer(self) -> Transducer:
        return Transducer(self.merges)

    def _word(self, piece: str) -> tuple[int, ...]:
        ids = self._older.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            ids = (whole,) if whole is not None else tuple(self.transducer.encode(raw))
        if len(piece) <= 64:
            if len(self._words) >= WORDS_KEPT:
                self._words, self._older = {}, self._words
            self._words[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, word = self._words.get, self._word
        return list(chain.from_iterable([known(p) or word(p) for p in self.pieces(text)]))

    def decode(self, ids) -> str:
        return self.decoder.feed(ids) + self.decoder.finish()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec for each rank file and pattern in a process."""
    key = hashlib.sha256(raw).hexdigest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with token_ids array<int>, of the whole text (null: empty); all rows and columns are kept.

    The rank file (about 1 MB) is read by the driver and broadcast. No shuffle.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    with open(ranks_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("token_ids")
    at = docs.columns.index("text")

    def encode(batches):
        own = codec(raw.value, pattern)
        for batch in batches:
            for row in range(0, batch.num_rows, ROWS):
                part = batch.slice(row, ROWS)
                ids = [np.array(own.encode(t or ""), np.int32) for t in part.column(at).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, np.concatenate(ids))], names=[*part.schema.names, "token_ids"])

    return docs.mapInArrow(encode, StructType([*docs.schema.fields, StructField("token_ids", ArrayType(IntegerType()))]))


def decoded(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``tokens`` with decoded_text string, of token_ids (null: empty)."""
    from pyspark.sql.types import StringType, StructField, StructType

    with open(ranks_path, "rb") as f:
        raw = tokens.sparkSession.sparkContext.broadcast(f.read())
    tokens = tokens.drop("decoded_text")
    at = tokens.columns.index("token_ids")

    def decode(batches):
        own = codec(raw.value, pattern)
        for batch in batches:
            for row in range(0, batch.num_rows, ROWS):
                part = batch.slice(row, ROWS)
                text = pa.array((own.decode(ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else ()) for ids in part.column(at)), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "decoded_text"])

    return tokens.mapInArrow(decode, StructType([*tokens.schema.fields, StructField("decoded_text", StringType())]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs``.

    Null texts count as empty: no tokens, digests of nothing. Repeated rows give
    repeated results; an empty table gives none; other columns are ignored. One pass
    encodes and decodes, so no ids travel.
    """
    with open(ranks_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    @lean
    def both(batches):
        own = codec(raw.value, pattern)
        names = own.names
        for batch in batches:
            for row in range(0, batch.num_rows, ROWS):
                part = batch.slice(row, ROWS)
                counts, digests, backs = [], [], []
                for text in part.column(1).to_pylist():
                    ids = own.encode(text or "")
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    backs.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(backs, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(both, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
