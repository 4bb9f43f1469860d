"""Byte-level BPE as a finite-state transducer that is determinised while it runs.

A merge list encodes a text as tokens of which every two neighbours encode to
themselves when joined, and only one sequence of tokens has that property. So the
last token of a prefix is decided by the token before it alone. While a piece is
read, the prefixes that a token still under way could start from are *live*; as
soon as the encodings of all live prefixes agree on a boundary, no later byte can
move it, and the tokens before it are emitted. What follows that boundary is at
most a few tokens long. A state holds, for each live prefix, its tokens after that
boundary and the bytes that follow it; states and transitions are made when first
met and then looked up.
"""

from __future__ import annotations

import base64
import collections
import hashlib
from collections.abc import Callable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelayout.llm.rows import held_by_worker, id_and_text, map_texts

# Bounds of what a Python worker remembers: states start over, pieces leave by age.
MAX_STATES = 220_000
MAX_PIECES = 60_000
# Bytes of a piece between two looks at the number of states.
LOOKED_AT = 1024
MAX_PIECE = 32
DECODE_TOKENS = 4096


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and their rank, which is also the id, from a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


# What a live prefix is followed by so far, its last token (-1: none), and its tokens not yet emitted.
Live = tuple[bytes, int, tuple[int, ...]]


class State(dict[int, "State | tuple[State, tuple[int, ...]]"]):
    """Live prefixes, the longest unfinished token first; the last one is all that was read.

    As a dictionary: the byte read to the next state, with what is emitted if anything is.
    A transition that was not taken before is made by the transducer.
    """

    __slots__ = ("live", "rest", "made_by", "depth")

    def __init__(self, live: tuple[Live, ...], made_by: "Transducer", depth: int) -> None:
        self.live, self.rest, self.made_by, self.depth = live, live[-1][2], made_by, depth

    def __missing__(self, byte: int) -> "State | tuple[State, tuple[int, ...]]":
        state, emitted = self.made_by.step(self, byte)
        found = self[byte] = (state, emitted) if emitted else state
        return found


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        opened = (token[:size] for token in ranks for size in range(1, len(token)))
        self.open = {start: start for start in opened}  # all states share these
        self.max_states = max_states
        self.joins: dict[int, bool] = {}
        self.root = State(((b"", -1, ()),), self, 0)
        self.states = {self.root.live: self.root}

    def thin(self) -> None:
        """Let go of the states that were first met deepest within pieces, half of all or more.

        What is near the start of a piece is met by far the most often.
        """
        left, depth = self.max_states // 2, -1
        for at, count in sorted(collections.Counter(state.depth for state in self.states.values()).items()):
            left -= count
            if at and left < 0:
                break
            depth = at
        kept = {live: state for live, state in self.states.items() if state.depth <= depth}
        for state in self.states.values():
            if state.depth > depth:
                state.clear()
        for state in kept.values():
            for byte in [b for b, to in state.items() if (to[0] if to.__class__ is tuple else to).depth > depth]:
                del state[byte]
        self.states = kept

    def merged(self, data: bytes) -> list[bytes]:
        """The merges themselves, lowest rank first; only used on one or two tokens."""
        rank_of, none = self.ranks.get, 1 << 62
        parts = [data[at : at + 1] for at in range(len(data))]
        ranks = [rank_of(data[at : at + 2], none) for at in range(len(data) - 1)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], none)
        return parts

    def follows(self, last: int, token: int) -> bool:
        """Whether the two tokens stay as they are when joined; -1 is the start of a piece."""
        key = last << 32 | token
        known = self.joins.get(key)
        if known is None:
            if len(self.joins) >= 2 * self.max_states:
                self.joins.clear()
            parts = ([] if last < 0 else [self.tokens[last]]) + [self.tokens[token]]
            known = self.joins[key] = self.merged(b"".join(parts)) == parts
        return known

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Determinise one transition."""
        added, end, live = bytes((byte,)), None, []
        for suffix, last, chain in state.live:
            suffix += added
            if end is None and (token := self.ranks.get(suffix)) is not None and self.follows(last, token):
                end = (b"", token, (*chain, token))
            if (start := self.open.get(suffix)) is not None:
                live.append((start, last, chain))
        if end is None:
            raise ValueError(f"the vocabulary lacks byte {byte}")
        live.append(end)
        shared = 0  # tokens that all live prefixes agree on are settled
        for tokens in zip(*(chain for _, _, chain in live), strict=False):
            if len(set(tokens)) > 1:
                break
            shared += 1
        key = tuple((suffix, last, chain[shared:]) for suffix, last, chain in live)
        known = self.states.get(key)
        if known is None:
            known = self.states[key] = State(key, self, state.depth + 1)
        return known, end[2][:shared]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out = self.root, []
        for start in range(0, len(piece), LOOKED_AT):
            if len(self.states) > self.max_states:
                self.thin()
            for byte in piece[start : start + LOOKED_AT]:
                state = state[byte]
                if state.__class__ is tuple:
                    state, emitted = state
                    out += emitted
        return (*out, *state.rest)


class Utf8Stream:
    """Characters of bytes that come in parts cut anywhere.

    The state machine follows the tail of a part: how many bytes the last character
    still lacks and which range its next byte must be in. Complete characters are
    given out at once, an unfinished one waits for the next part.
    """

    def __init__(self) -> None:
        self.waiting = b""

    @staticmethod
    def missing(tail: bytes) -> int:
        """Bytes at the end of `tail` (up to 3) that start a character and do not end it."""
        for size in (1, 2, 3):
            if size > len(tail):
                return 0
            lead = tail[-size]
            if lead & 0xC0 == 0x80:
                continue
            need = 0 if lead < 0xC2 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF5 else 0
            if need <= size:
                return 0
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(
                lead, (0x80, 0xBF)
            )
            return size if size == 1 or low <= tail[1 - size] <= high else 0
        return 0

    def feed(self, part: bytes) -> str:
        data = self.waiting + part
        size = self.missing(data[-3:])
        self.waiting = data[len(data) - size :]
        return data[: len(data) - size].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts: pieces of the pattern, each through the transducer, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES) -> None:
        self.transducer = Transducer(ranks, max_states)
        self.pieces = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for piece in self.pieces.findall(text):
            found = known.get(piece)
            if found is None:
                found = self.older.get(piece)
                if found is None:
                    found = self.transducer.encode(piece.encode())
                if len(piece) <= MAX_PIECE:
                    if len(known) >= MAX_PIECES:
                        self.older, self.known = known, {}
                        known = self.known
                    known[piece] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> Iterator[str]:
        """Text in parts. Bytes that are no UTF-8 become U+FFFD; an unknown id is an error."""
        stream, tokens = Utf8Stream(), self.transducer.tokens
        for at in range(0, len(ids), DECODE_TOKENS):
            yield stream.feed(b"".join([tokens[token] for token in ids[at : at + DECODE_TOKENS]]))
        yield stream.close()


def codec(data: bytes, pattern: str, max_states: int = MAX_STATES) -> Codec:
    """One per Python worker, as long as it works for this operator."""
    return held_by_worker(("bpe", data, pattern, max_states), lambda: Codec(read_ranks(data), pattern, max_states))


def sent(docs: DataFrame, ranks_path: str) -> Callable[[], bytes]:
    """The rank file (under 1 MB), read by the driver and broadcast."""
    with open(ranks_path, "rb") as stream:
        held = docs.sparkSession.sparkContext.broadcast(stream.read())
    return lambda: held.value


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id` and `ids` (array of int) of every row. A null or empty text has no ids."""
    data = sent(docs, ranks_path)

    def each() -> Callable[[list[bytes]], list[list]]:
        found = codec(data(), pattern)
        return lambda texts: [[found.encode(text.decode(errors="replace")) for text in texts]]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return map_texts(id_and_text(docs, id_col, text_col), fields, each)


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`doc_id` and `text` of every row of ids. Null ids give the empty text."""
    data = sent(encoded, ranks_path)
    rows = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches):
        import pyarrow as pa

        found = codec(data(), pattern)
        for batch in batches:
            texts = ["".join(found.decode(ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


ROUND_TRIP = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_states: int = MAX_STATES
) -> DataFrame:
    """`doc_id`, `n_tokens` and digests of the ids and of the text decoded from them, in one pass.

    `ids_sha256` is of the decimal ids joined by blanks, `decoded_sha256` of the decoded
    text in UTF-8. A null text counts as empty: no tokens, and digests of nothing. Bytes that
    are no UTF-8 count as U+FFFD. Fewer states held take less memory and more time, and
    give the same tokens.
    """
    data = sent(docs, ranks_path)

    def each() -> Callable[[list[bytes]], list[list]]:
        found = codec(data(), pattern, max_states)
        decimal = [str(token) for token in range(max(found.transducer.tokens) + 1)]

        def batch(texts: list[bytes]) -> list[list]:
            columns: list[list] = [[], [], []]
            for text in texts:
                ids = found.encode(text.decode(errors="replace"))
                back = hashlib.sha256()
                for part in found.decode(ids):
                    back.update(part.encode())
                spelled = " ".join([decimal[token] for token in ids])
                columns[0].append(len(ids))
                columns[1].append(hashlib.sha256(spelled.encode()).hexdigest())
                columns[2].append(back.hexdigest())
            return columns

        return batch

    return map_texts(id_and_text(docs, id_col, text_col), ROUND_TRIP, each)
