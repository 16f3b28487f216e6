"""Byte-level BPE as a transducer.

The merges are compiled, as they are needed, into a deterministic finite-state
transducer over bytes. A piece's encoding is the one path of tokens in which
every two neighbours are what the merges make of their bytes. A state holds the
boundaries at which a token may have begun that still goes on: for each the node
of the vocabulary's trie that the bytes since it lead to, the token before it,
and the output up to it that has not been emitted yet (subset construction with
delayed output). As soon as all boundaries share a token, it is emitted: the
lookahead never exceeds the longest token. A transition is made when it is first
met and kept; every piece that is not itself a token runs through the transducer
from end to end. When its table is full, it is emptied but for the present state.

Where few tokens go on from a node, a boundary there is dropped if none of them
can follow the token before it, and that token is forgotten if all of them can:
states that would behave alike are one, and tokens are emitted sooner.

Decoding feeds token bytes to an incremental UTF-8 state machine; its
transitions are also tabled by token."""

from __future__ import annotations

import base64
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField

from .common import appended, table

#: Entries of a table before it is emptied. They bound memory, not what is done.
MOST_TRANSITIONS, MOST_PATHS, MOST_PIECES, MOST_PAIRS = 400_000, 900_000, 200_000, 400_000
#: Tokens below a node, at most, that are tried to tell apart what may come before.
FEW = 32
#: In a boundary, a token before it that any token can follow.
ANY = 0xFFFFF
LONG = 1 << 20
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """Pieces to tokens, packed as in ids. When it is full, what was met lately
    is kept aside for one more filling."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.before = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.before.get(piece) or array("I", self.encoder.piece(piece)).tobytes()
        if len(piece) <= 64:
            if len(self) >= MOST_PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = got
        return got


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        #: (first token + 1) << 24 | second token: whether the two stay neighbours
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self)
        self.edges: dict[int, tuple[list, list] | None] = {}
        # the vocabulary as a trie: (node, byte) to node, the token that ends in a node, whether a node goes on
        self.trie: dict[int, int] = {}
        self.token_at, self.goes_on = [-1], bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.goes_on[node] = 1
                below = self.trie.get(node << 8 | byte)
                if below is None:
                    below = self.trie[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.goes_on.append(0)
                node = below
            self.token_at[node] = rank
        #: the tokens below a node where they are few; node << 20 | (token before + 1): what to keep of that, -1 for nothing
        self.below: dict[int, list[int]] = {}
        self.kept: dict[int, int] = {}
        many = set()
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if node and node not in many:
                    few = self.below.setdefault(node, [])
                    few.append(rank)
                    if len(few) > FEW:
                        many.add(node)
                        del self.below[node]
                node = self.trie[node << 8 | byte]
        self.start()

    def start(self) -> None:
        """An empty table. A boundary is node << 40 | (token before it + 1) << 20
        | path, a state is the tuple of its boundaries, the oldest first."""
        #: state << 8 | byte: next state << 24 | emission
        self.go: dict[int, int] = {}
        self.states: list[tuple[int, ...]] = []
        self.number_of: dict[tuple[int, ...], int] = {}
        self.emissions: list[tuple[int, ...]] = [()]
        self.emission_of: dict[tuple[int, ...], int] = {(): 0}
        # paths of tokens not emitted yet: the first token (-1: no tokens) and the path after it; path << 20 | token to path
        self.heads, self.rests, self.longer = [-1], [0], {}
        self.state((0,))

    def state(self, live: tuple[int, ...]) -> int:
        got = self.number_of.get(live)
        if got is None:
            got = self.number_of[live] = len(self.states)
            self.states.append(live)
        return got

    def path(self, before: int, token: int) -> int:
        """The path with one more token."""
        key = before << 20 | token
        got = self.longer.get(key)
        if got is None:
            rest = self.path(self.rests[before], token) if before else 0
            got = self.longer[key] = len(self.heads)
            self.heads.append(self.heads[before] if before else token)
            self.rests.append(rest)
        return got

    def tokens(self, path: int) -> list[int]:
        out = []
        while path:
            out.append(self.heads[path])
            path = self.rests[path]
        return out

    def outer(self, token: int) -> tuple[list, list] | None:
        """The parts that stand at a token's left and right end while the merges
        make it, each with its rank and that of the merge that takes it up; None
        if the merges make something else of the token's bytes."""
        if token in self.edges:
            return self.edges[token]
        data = self.bytes_of[token]
        parts = [data[i : i + 1] for i in range(len(data))]
        left, right = [(parts[0], -1)], [(parts[-1], -1)]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                left.append((parts[0], rank))
            if i == len(parts) - 1:
                right.append((parts[-1], rank))
        got = None
        if len(parts) == 1:
            ends = lambda side: [(p, r, after) for (p, r), (_, after) in zip(side, [*side[1:], (b"", NEVER)])]
            got = ends(left), ends(right)
        self.edges[token] = got
        return got

    def neighbours(self, one: int | None, two: int) -> bool:
        """Whether the merges make the second token and leave the two apart: no
        merge across the boundary comes before the merges that take up its two
        parts. Of equal ranks the leftmost comes first."""
        after, got = self.outer(two), False
        before = self.outer(one)[1] if one is not None else None
        if after is not None:
            got = before is None or self.apart(before, after[0])
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[(-1 if one is None else one) + 1 << 24 | two] = got
        return got

    def apart(self, before: list, after: list) -> bool:
        """Follows the merges on both sides of a boundary in their order."""
        ranks, i, j = self.ranks, 0, 0
        while True:
            (a, _, taken_a), (b, _, taken_b) = before[i], after[j]
            r = ranks.get(a + b, NEVER)
            if r < taken_a and r <= taken_b:
                return False
            if taken_a <= taken_b:
                if taken_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def follows(self, last: int, token: int) -> bool:
        """``neighbours``, kept; ``last`` is the first token + 1, or 0 for none."""
        fit = self.pairs.get(last << 24 | token)
        return self.neighbours(last - 1 if last else None, token) if fit is None else fit

    def keep(self, node: int, last: int) -> int:
        key = node << 20 | last
        got = self.kept.get(key)
        if got is None:
            fits = [self.follows(last, t) for t in self.below[node]]
            if len(self.kept) >= MOST_PAIRS:
                self.kept.clear()
            got = self.kept[key] = -1 if not any(fits) else ANY if all(fits) else last
        return got

    def restart(self, state: int) -> int:
        """Empties the table; ``state`` is taken along under a new number."""
        live = [(x >> 20, self.tokens(x & 0xFFFFF)) for x in self.states[state]]
        self.start()
        kept = []
        for x, tokens in live:
            path = 0
            for t in tokens:
                path = self.path(path, t)
            kept.append(x << 20 | path)
        return self.state(tuple(kept))

    def transition(self, state: int, byte: int) -> int:
        """Determinises one transition."""
        if len(self.go) >= MOST_TRANSITIONS or len(self.heads) >= MOST_PATHS:
            state = self.restart(state)
        trie, token_at, few, heads, rests = self.trie, self.token_at, self.below, self.heads, self.rests
        new, live = -1, []
        for x in self.states[state]:
            below = trie.get(x >> 40 << 8 | byte)
            if below is None:
                continue
            token, last = token_at[below], x >> 20 & 0xFFFFF
            if token >= 0 and new < 0 and (last == ANY or self.follows(last, token)):
                new = token + 1 << 20 | self.path(x & 0xFFFFF, token)
            if self.goes_on[below]:
                if last != ANY and below in few:
                    last = self.keep(below, last)
                if last >= 0:
                    live.append(below << 40 | last << 20 | x & 0xFFFFF)
        if new < 0:
            raise ValueError("the vocabulary lacks a byte")
        live.append(new)
        emitted = ()
        while (first := heads[live[0] & 0xFFFFF]) >= 0 and all([heads[x & 0xFFFFF] == first for x in live]):
            emitted = (*emitted, first)
            live = [x >> 20 << 20 | rests[x & 0xFFFFF] for x in live]
        number = self.emission_of.get(emitted)
        if number is None:
            number = self.emission_of[emitted] = len(self.emissions)
            self.emissions.append(emitted)
        got = self.go[state << 8 | byte] = self.state(tuple(live)) << 24 | number
        return got

    def transduce(self, data: bytes) -> list[int]:
        go, emissions, state, out = self.go, self.emissions, 0, []
        for byte in data:
            to = go.get(state << 8 | byte)
            if to is None:
                to = self.transition(state, byte)
                go, emissions = self.go, self.emissions  # new ones after a restart
            state = to >> 24
            if to & 0xFFFFFF:
                out += emissions[to & 0xFFFFFF]
        return out + self.tokens(self.states[state][-1] & 0xFFFFF)

    def piece(self, piece: str) -> list[int]:
        """A piece that is a token itself is that token, whatever the merges make of it."""
        data = piece.encode()
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.transduce(data)

    def encode(self, text: str) -> array:
        pieces = self.pattern.findall(text) if len(text) < LONG else (m[0] for m in self.pattern.finditer(text))
        ids = array("I")
        ids.frombytes(b"".join(map(self.pieces.__getitem__, pieces)))
        return ids


#: Of a lead byte: how many bytes follow, and the range of the first of them.
def lead(byte: int) -> tuple[int, int, int]:
    if byte < 0x80:
        return 0, 0, 0
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return -1, 0, 0


class Decoder:
    """Text of token ids as they come. Its state is the unfinished character:
    the bytes seen, how many more it takes, and the range of the next one."""

    START = (b"", 0, 0x80, 0xBF)

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.moves: dict[tuple, tuple[str, tuple]] = {}
        self.clean: dict[int, str] = {}
        for i, b in self.bytes_of.items():
            text, state = self.run(self.START, b)
            if state == self.START and "�" not in text:
                self.clean[i] = text

    def run(self, state: tuple, data: bytes) -> tuple[str, tuple]:
        out, (seen, more, low, high) = [], state
        for byte in data:
            if more:
                if low <= byte <= high:
                    seen, more, low, high = seen + bytes((byte,)), more - 1, 0x80, 0xBF
                    if not more:
                        out.append(seen.decode())
                        seen = b""
                    continue
                out.append("�")  # what was begun is broken off; this byte begins anew
                seen, more = b"", 0
            more, low, high = lead(byte)
            if more > 0:
                seen = bytes((byte,))
            else:
                out.append(chr(byte) if more == 0 else "�")
                more, low, high = 0, 0x80, 0xBF
        return "".join(out), (seen, more, low, high)

    def feed(self, state: tuple, token: int) -> tuple[str, tuple]:
        got = self.moves.get((state, token))
        if got is None:
            if len(self.moves) >= MOST_PAIRS:
                self.moves.clear()
            got = self.moves[state, token] = self.run(state, self.bytes_of[token])
        return got

    def decode(self, ids) -> str:
        out, state, clean, start = [], self.START, self.clean, self.START
        for i in ids:
            if state == start and (t := clean.get(i)) is not None:
                out.append(t)
            else:
                t, state = self.feed(state, i)
                out.append(t)
        if state != start:
            out.append("�")
        return "".join(out)


coders: dict[type, tuple[tuple, Encoder | Decoder]] = {}


def coder_of(kind: type, shared, path: str, *more: str):
    """One of each kind in a worker process: its tables stay filled for later tasks."""
    key = (path, *more)
    if kind not in coders or coders[kind][0] != key:
        coders.pop(kind, None)
        coders[kind] = key, kind(shared.value, *more)
    return coders[kind][1]


def unpacked(data: bytes | None) -> array:
    ids = array("I")
    ids.frombytes(data or b"")
    return ids


IDS, DECODED = StructField("ids", BinaryType()), StructField("decoded", StringType())


def encoded(docs: DataFrame, path: str, pattern: str, back: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ids: the tokens as little-endian unsigned 32-bit integers; with
    ``back`` decoded too, in the same worker; columns of these names are replaced,
    those in ``drop`` are not returned. Null and empty texts have no tokens; a text
    of any length is encoded whole, piece by piece; repeated rows get the same;
    an empty table gives none. Of merges of equal rank the leftmost goes first."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # a file of fixed size

    def make():
        encoder = coder_of(Encoder, shared, path, pattern)
        decoder = coder_of(Decoder, shared, path) if back else None

        def each(batch: pa.RecordBatch) -> list:
            ids = [encoder.encode(t or "").tobytes() for t in batch.column("text").to_pylist()]
            out = [pa.array(ids, pa.binary())]
            if back:
                out.append(pa.array([decoder.decode(unpacked(x)) for x in ids], pa.string()))
            return out

        return each

    return appended(docs, [IDS, DECODED] if back else [IDS], make, drop)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """Adds decoded, the text of ids (null: empty). Bytes that are no UTF-8 become U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make():
        decoder = coder_of(Decoder, shared, path)
        return lambda batch: [pa.array([decoder.decode(unpacked(x)) for x in batch.column("ids").to_pylist()], pa.string())]

    return appended(rows, [DECODED], make)


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = encoded(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, back=True, drop=("text",))
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
