"""Operator 4, byte-level BPE encoding and decoding with a lazily determinised finite-state transducer.

Encoding. The encoding of a prefix determines its last token, and the encoding of the prefix before that token is what precedes
it. So the last token at a position is the one vocabulary suffix that stays apart from the last token where it starts, under
the merges. A later token can only start at a live position: one from which the bytes read so far are the beginning of a vocabulary entry. A
state of the transducer holds the bytes since its first live position and, for each live position, the token that ends there. It forgets what cannot
matter: a position goes when no entry that begins with the bytes since then would stay apart from the token that ends there, and tokens
that stay apart from the same entries are one (both where ``EXTENSIONS`` entries or fewer begin so). Hence natural text soon meets
no new states. States and transitions are made when first met and kept (lazy determinisation), and made anew when ``STATES`` of them
are held, which bounds memory and changes no result. Reading a byte yields the last token of the prefix; a token is emitted once the
paths of all live positions run through it, so the lookahead is bounded by the longest entry.

The pre-tokenizer's matches are encoded one by one; results of short pieces of text are kept in a bounded table, as natural text repeats its words.

Decoding streams the ids' bytes through an incremental UTF-8 state machine; it reports whether the whole stream is valid UTF-8. A token that is
valid by itself leaves the machine where it starts, so only the others, and what follows them, are stepped through, by (state, id).

Nulls and edges: a null text counts as empty: 0 tokens and the digest of no bytes. Repeated rows give repeated results; a null doc_id is
returned as null; extra columns are ignored. Surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import regex
from pyspark.sql import DataFrame

from cartulary.llm.batches import map_texts, worker_tables

#: White space as the pattern's dialect has it, then what may stand between: no match crosses from one chunk to the next.
WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(rf" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
CACHED_CHARS = 48
CACHED_PIECES = 400_000
STATES = 300_000
PAIRS = 300_000
EXTENSIONS = 64
BLOCK = 1024
NEVER = 1 << 62
ONE = [bytes((b,)) for b in range(256)]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class State(dict):
    """Transitions by byte: (state, id of the prefix's last token, its length)."""

    __slots__ = ("live", "owner", "since")

    def __init__(self, owner: Transducer, since: bytes, live: tuple):
        self.owner, self.since, self.live = owner, since, live

    def __missing__(self, byte: int) -> tuple:
        found = self[byte] = self.owner.step(self.since, self.live, byte)
        return found


class Transducer:
    """Byte pair encoding of byte strings by a rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.entries = sorted(ranks)
        self.beginnings = {t[:k] for t in ranks for k in range(1, len(t))}
        self.longest = max(map(len, ranks), default=1)
        self.pair: dict[tuple[bytes, bytes], bool] = {}
        self.spine: dict[bytes, tuple[list, list]] = {}
        self.reset()

    def reset(self) -> None:
        #: since the first live position: the bytes, and (position, token that ends there) in order; at the beginning that token is empty.
        self.start = State(self, b"", ((0, b""),))
        self.states = {(b"", ((0, b""),)): self.start}
        self.classes: dict[tuple[bytes, bytes], bytes | None] = {}
        self.names: dict[tuple, bytes] = {}

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The defining procedure: join the neighbouring parts of lowest rank, leftmost first, until none can be joined or ``least`` are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spines(self, token: bytes) -> tuple[list, list]:
        """The token's left and right spine in its merge tree, from a single byte up to the token, as (bytes, rank)."""
        found = self.spine.get(token)
        if found is None:
            if len(token) == 1:
                found = [(token, self.ranks[token])], [(token, self.ranks[token])]
            else:
                left, right = self.merged(token, 2)
                own = (token, self.ranks[token])
                found = [*self._spines(left)[0], own], [*self._spines(right)[1], own]
            self.spine[token] = found
        return found

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay apart when their joined bytes are encoded.

        The parts at the border grow along left's right spine and right's left spine in the order of rank; the tokens stay
        apart unless at some time the two parts can be joined before either grows (a growth to the left goes first at equal rank).
        """
        ours, theirs, i, j, ranks = self._spines(left)[1], self._spines(right)[0], 0, 0, self.ranks
        while True:
            up_left = ours[i + 1][1] if i + 1 < len(ours) else NEVER
            up_right = theirs[j + 1][1] if j + 1 < len(theirs) else NEVER
            joined = ranks.get(ours[i][0] + theirs[j][0], NEVER)
            if joined < up_left and joined <= up_right and joined != NEVER:
                return False
            if up_left == up_right == NEVER:
                return True
            if up_left <= up_right:
                i += 1
            else:
                j += 1

    def stable(self, left: bytes, right: bytes) -> bool:
        found = self.pair.get((left, right))
        if found is None:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            found = self.pair[left, right] = self.apart(left, right)
        return found

    def lasting(self, last: bytes, rest: bytes) -> bytes | None:
        """The token that stands for all that stay apart from the same entries beginning with ``rest`` as ``last`` does; None if there is no such entry."""
        key = (last, rest)
        if key not in self.classes:
            lo = bisect_right(self.entries, rest)
            hi = bisect_left(self.entries, rest + b"\xff" * self.longest, lo)  # what begins with rest sorts before that
            if hi - lo > EXTENSIONS:
                found = last
            else:
                sign = tuple([k for k in range(lo, hi) if self.apart(last, self.entries[k])])
                found = self.names.setdefault((rest, sign), last) if sign else None
            self.classes[key] = found
        return self.classes[key]

    def step(self, since: bytes, live: tuple, byte: int) -> tuple[State, int, int]:
        """Read a byte in a state: the next state, the id of the last token of what is read by then, and its length."""
        data = since + ONE[byte]
        ranks, here, after = self.ranks, None, []
        for pos, last in live:  # from the longest token down
            token = data[pos:]
            if here is None and token in ranks and (not last or self.stable(last, token)):
                here = token
            if token in self.beginnings:
                last = self.lasting(last, token) if last else last
                if last is not None:
                    after.append((pos, last))
        if here is None:
            raise ValueError("the rank table lacks a single byte")
        after.append((len(data), here))
        lo = after[0][0]
        key = (data[lo:], tuple([(pos - lo, last) for pos, last in after]))
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= STATES:
                self.reset()
            found = self.states[key] = State(self, *key)
        return found, ranks[here], len(here)

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        state, read = self.start, []
        if len(data) <= BLOCK:
            for byte in data:
                got = state[byte]
                read.append(got)
                state = got[0]
            return self._back(read, 0, len(read))
        out = []
        for byte in data:
            got = state[byte]
            read.append(got)
            state = got[0]
            if len(read) >= BLOCK:
                sure = self._certain(state, read)
                out += self._back(read, 0, sure)
                del read[:sure]
        return out + self._back(read, 0, len(read))

    @staticmethod
    def _back(read: list, lo: int, hi: int) -> list[int]:
        """The tokens from lo to hi, both of which are ends of tokens on one path."""
        out = []
        while hi > lo:
            _, token, size = read[hi - 1]
            out.append(token)
            hi -= size
        out.reverse()
        return out

    @staticmethod
    def _certain(state: State, read: list) -> int:
        """The last place that the paths of all live positions run through."""
        ends = {len(read) - len(state.since) + pos for pos, _ in state.live}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - read[last - 1][2])
        return ends.pop()


class Utf8Machine:
    """Incremental UTF-8 validation over whole tokens; steps are kept by (state, id). State: bytes still expected and the bounds of the next one."""

    START = (0, 0x80, 0xBF)

    def __init__(self, vocabulary: list[bytes]):
        self.vocabulary = vocabulary
        self.steps: dict[tuple, tuple | None] = {}
        self.odd = np.array([self.advance(self.START, v) != self.START for v in vocabulary])

    @staticmethod
    def advance(state: tuple | None, data: bytes) -> tuple | None:
        for b in data:
            if state is None:
                return None
            need, lo, hi = state
            if need:
                state = (need - 1, 0x80, 0xBF) if lo <= b <= hi else None
            elif b < 0x80:
                continue
            elif 0xC2 <= b <= 0xDF:
                state = (1, 0x80, 0xBF)
            elif 0xE0 <= b <= 0xEF:
                state = (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                state = (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF)
            else:
                state = None
        return state

    def run(self, ids: np.ndarray) -> bool:
        state, steps, start, done = self.START, self.steps, self.START, 0
        for at in np.flatnonzero(self.odd[ids]).tolist():
            if at < done:
                continue
            # until the machine is back at its start
            while at < len(ids):
                key = (state, int(ids[at]))
                if key not in steps:
                    steps[key] = self.advance(state, self.vocabulary[key[1]])
                state = steps[key]
                at += 1
                if state == start or state is None:
                    break
            if state is None:
                return False
            done = at
        return state == start


class Codec:
    def __init__(self, raw: bytes, pattern: str):
        ranks = parse_ranks(raw)
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.utf8 = Utf8Machine(self.vocabulary)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for piece in self.pattern.findall(chunk):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = np.array(self.machine.encode(piece.encode()), dtype="<u4").tobytes()
                if len(piece) <= CACHED_CHARS:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed. The chunks are those that no match of the pattern crosses, so equal chunks have equal ids wherever they stand."""
        if len(self.kept) > CACHED_PIECES:  # two generations: what is met again stays
            self.kept, self.older = {}, self.kept
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        kept, older = self.kept, self.older
        chunks = CHUNK.findall(text)
        long = []
        for chunk in set(chunks).difference(kept):
            kept[chunk] = older.get(chunk) or self._chunk(chunk)
            if len(chunk) > CACHED_CHARS:
                long.append(chunk)
        packed = b"".join(map(kept.__getitem__, chunks))
        for chunk in long:
            del kept[chunk]
        return packed

    def decode(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """The bytes, and whether they are UTF-8."""
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist())), self.utf8.run(ids)

    def digest(self, text: str | None) -> tuple[int, str, str, bool]:
        packed = self.encode(text or "")
        data, valid = self.decode(np.frombuffer(packed, dtype="<u4"))
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(data).hexdigest(), valid


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256, valid_utf8. The rank file, of fixed size, is read once and broadcast."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        codec = worker_tables(("bpe", pattern, ranks_path), lambda: Codec(ranks.value, pattern))
        return lambda texts: list(zip(*map(codec.digest, texts))) if texts else [[] for _ in range(4)]

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean", id_col, text_col)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
