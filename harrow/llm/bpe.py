"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding. Of each prefix of a piece of text, BPE has one encoding, and its last token t follows the
encoding of what stands before t. So one last token for each position holds all encodings, and a
sequence is an encoding if each two neighbours are the encoding of their joined bytes. The
nondeterministic transducer reads bytes from every boundary that may still start a token; its states
are pairs of a place in the trie of tokens and the last token before the boundary. Sets of such pairs
are the states of the deterministic one. They and their edges are made when a text first needs them
and are dropped when there are too many. Tokens are emitted as soon as all live boundaries agree on
them, so the lookahead is bounded by the text between the oldest live boundary and the read position.

Decoding. Tokens become bytes; a state machine over UTF-8 tells how many bytes at the end of the
stream belong to a code point that is not complete yet; only those are held back.

* null text: empty; empty text: no tokens; very long text: linear time; repeated documents: a row each;
* null doc_id: kept as null; empty table: no rows; further columns pass through ``encode`` unread.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .common import ddl, id_text, kept, map_rows, ship

#: Edges of the transducer and pieces of text that a worker remembers (some 190 MB with the vocabulary), and half of both,
#: which takes 70 MB less and a fifth more time.
CACHES = (600_000, 240_000)
LEAN_CACHES = (300_000, 120_000)
#: Bytes between two looks for tokens that are settled.
LOOK_EVERY = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes pieces of text, given as bytes, to token ids."""

    def __init__(self, ranks: dict[bytes, int], most_edges: int = CACHES[0]) -> None:
        if len(ranks) >= 1 << 17 or max(map(len, ranks), default=0) > 255:
            raise ValueError("a state holds tokens of 17 bits and 255 bytes")
        self.ranks, self.most_edges = ranks, most_edges
        self.tokens = {i: t for t, i in ranks.items()}
        self._child: list[dict[int, int]] = [{}]
        self._token: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                if byte not in self._child[node]:
                    self._child[node][byte] = len(self._child)
                    self._child.append({})
                    self._token.append(-1)
                node = self._child[node][byte]
            self._token[node] = i
        self._follows: dict[tuple[int, int], bool] = {}
        self._growth: dict[int, list[tuple[int, bytes, bytes]]] = {}
        self._reset()

    def _reset(self) -> None:
        """Forget the states. A state is the edges that were needed so far, and its set under None."""
        self._start: dict = {None: (0,)}
        self._states = {self._start[None]: self._start}
        self._edges = 0

    def _grown(self, token: int) -> list[tuple[int, bytes, bytes]]:
        """How a token grows by merges: (rank, what touches its right edge, what touches its left edge).

        A merge joins parts of lower ranks, so ranks rise, and both edges are known at any rank.
        """
        found = self._growth.get(token)
        if found is None:
            whole = self.tokens[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            found = [(-1, parts[-1], parts[0])]
            while len(parts) > 1:
                at = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found.append((self.ranks[parts[at]], parts[-1], parts[0]))
            self._growth[token] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """May token b stand right after token a in an encoding? No, if a merge across the border comes first.

        Of equal ranks the leftmost merge comes first: one inside a before one across the border, and
        that before one inside b.
        """
        found = self._follows.get((a, b))
        if found is not None:
            return found
        left, right = self._grown(a), self._grown(b)
        i = j = 0
        good = True
        while good:
            next_left = left[i + 1][0] if i + 1 < len(left) else 1 << 60
            next_right = right[j + 1][0] if j + 1 < len(right) else 1 << 60
            across = self.ranks.get(left[i][1] + right[j][2], 1 << 60)
            good = not (across < next_left and across <= next_right and across < 1 << 60)
            if next_left == next_right == 1 << 60:
                break
            if next_left <= next_right:
                i += 1
            else:
                j += 1
        if len(self._follows) >= self.most_edges:
            self._follows.clear()
        self._follows[a, b] = good
        return good

    def _step(self, state: dict, byte: int) -> tuple[dict, int]:
        """The next state, and the token that ends the encoding of all that was read.

        A state's set holds trie node, last token before the boundary plus one, and bytes since the
        boundary, in 17 and 8 bits below the node: a whole number takes a fifth of a tuple's memory.
        """
        if self._edges >= self.most_edges:
            self._reset()
            state = self._states.setdefault(state[None], {None: state[None]})
        live, last = [], -1
        for packed in state[None]:
            child = self._child[packed >> 25].get(byte)
            if child is None:
                continue
            token, before = self._token[child], (packed >> 8 & 0x1FFFF) - 1
            if last < 0 and token >= 0 and (before < 0 or self.follows(before, token)):
                last = token
            if self._child[child]:
                live.append(child << 25 | (packed & 0x1FFFFFF) + 1)
        live.append(last + 1 << 8)
        target = self._states.get(found := tuple(live))
        if target is None:
            target = self._states[found] = {None: found}
        self._edges += 1
        state[byte] = target, last
        return target, last

    def emit(self, piece: Iterable[int]) -> Iterator[int]:
        """Token ids of a stream of bytes, each as soon as it is settled."""
        state, lasts = self._start, []  # lasts: of the positions after the settled ones
        for byte in piece:
            state, last = state.get(byte) or self._step(state, byte)
            lasts.append(last)
            if len(lasts) >= LOOK_EVERY and len(lasts) % LOOK_EVERY == 0:
                # Where the ways back from all live boundaries meet first.
                ends = {len(lasts) - (packed & 0xFF) for packed in state[None]}
                while len(ends) > 1:
                    end = max(ends)
                    ends.remove(end)
                    ends.add(end - len(self.tokens[lasts[end - 1]]))
                meet = ends.pop()
                yield from self._back(lasts, meet)
                del lasts[:meet]
        yield from self._back(lasts, len(lasts))

    def short(self, piece: bytes) -> tuple[int, ...]:
        """``emit`` of a piece so short that nothing is emitted before its end."""
        state, lasts, step = self._start, [], self._step
        for byte in piece:
            state, last = state.get(byte) or step(state, byte)
            lasts.append(last)
        return tuple(self._back(lasts, len(lasts)))

    def _back(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(lasts[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]


class Codec:
    """Text to token ids and back, with a bounded memory of the pieces that were seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, caches: tuple[int, int] = CACHES) -> None:
        self.transducer, self.most_words = Transducer(ranks, caches[0]), caches[1]
        self.find = regex.compile(pattern).findall
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _learn(self, piece: str) -> tuple[int, ...]:
        if (known := self._older.get(piece)) is not None:
            return known
        raw = piece.encode("utf-8", "replace")
        whole = self.transducer.ranks.get(raw)
        if whole is not None:
            return (whole,)
        return self.transducer.short(raw) if len(raw) < LOOK_EVERY else tuple(self.transducer.emit(raw))

    def encode(self, text: str) -> list[int]:
        known, pieces = self._pieces, self.find(text)
        for piece in set(pieces).difference(known):
            known[piece] = self._learn(piece)
        out = list(chain.from_iterable(map(known.__getitem__, pieces)))
        if len(known) > self.most_words:  # what is used again moves up from the older half
            self._older, self._pieces = (known if len(known) < 4 * self.most_words else {}), {}
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.transducer.tokens.__getitem__, ids))


#: State machine of UTF-8. A state is the tuple of byte ranges that must still follow.
_TAIL = (0x80, 0xBF)
ACCEPT: tuple[tuple[int, int], ...] = ()


def utf8_step(state: tuple[tuple[int, int], ...], byte: int) -> tuple[tuple[int, int], ...] | None:
    """The next state, or None where no valid UTF-8 goes on like this."""
    if state:
        low, high = state[0]
        return state[1:] if low <= byte <= high else None
    if byte < 0x80:
        return ACCEPT
    # The lead bytes of UTF-8 and the ranges of the byte after them.
    for first, final, second, more in (
        (0xC2, 0xDF, _TAIL, 0), (0xE0, 0xE0, (0xA0, 0xBF), 1), (0xE1, 0xEC, _TAIL, 1), (0xED, 0xED, (0x80, 0x9F), 1),
        (0xEE, 0xEF, _TAIL, 1), (0xF0, 0xF0, (0x90, 0xBF), 2), (0xF1, 0xF3, _TAIL, 2), (0xF4, 0xF4, (0x80, 0x8F), 2),
    ):
        if first <= byte <= final:
            return (second, *[_TAIL] * more)
    return None


class StreamDecoder:
    """Token ids in chunks to text in chunks: an incomplete code point waits for the next chunk."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self._tokens, self._held = tokens, b""

    def feed(self, ids: Iterable[int]) -> str:
        raw = self._held + b"".join(map(self._tokens.__getitem__, ids))
        cut = len(raw) - incomplete(raw)
        self._held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        raw, self._held = self._held, b""
        return raw.decode("utf-8", "replace")


def incomplete(raw: bytes) -> int:
    """Bytes at the end that begin a code point but do not complete it. Only the last three can."""
    for back in range(1, min(3, len(raw)) + 1):
        state = ACCEPT
        for byte in raw[-back:]:
            state = utf8_step(state, byte)
            if state is None:
                break
        if raw[-back] >= 0xC0:
            return back if state else 0
    return 0


def codec(path: str, pattern: str, caches: tuple[int, int] = CACHES) -> Codec:
    """The worker's codec for a vocabulary file."""
    return kept(__name__, (path, pattern, caches), lambda: Codec(load_ranks(path), pattern, caches))


def _digested(own: Codec, text: str) -> tuple[list[int], str, str, int]:
    """The ids of a text, their digest, the digest of what they decode to, and its code points."""
    ids = own.encode(text)
    stream, digest, chars = StreamDecoder(own.transducer.tokens), hashlib.sha256(), 0
    for at in range(0, len(ids) + 1, 100_000):
        piece = stream.feed(ids[at : at + 100_000])
        digest.update(piece.encode("utf-8"))
        chars += len(piece)
    piece = stream.finish()
    digest.update(piece.encode("utf-8"))
    return ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), digest.hexdigest(), chars + len(piece)


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, and the code points decoded."""
    ship(docs.sparkSession)

    def run(rows):
        own = codec(path, pattern)
        for doc_id, text in rows:
            ids, ids_sha, decoded_sha, chars = _digested(own, text)
            yield doc_id, len(ids), ids_sha, decoded_sha, chars

    return map_rows(
        docs.select(*id_text(doc_id, text)), run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long",
    )


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", caches: tuple[int, int] = CACHES) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    ship(docs.sparkSession)

    def run(rows):
        own = codec(path, pattern, caches)
        for doc_id, text in rows:
            ids, ids_sha, decoded_sha, _ = _digested(own, text)
            yield doc_id, ids, len(ids), ids_sha, decoded_sha

    return map_rows(
        docs.select(*id_text(doc_id, text)), run,
        "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", per_batch=200,
    )


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """The documents with an array of token ids in column ``into``; other columns pass through."""
    ship(docs.sparkSession)
    docs = docs.drop(into)
    at = docs.columns.index(text)

    def run(rows):
        own = codec(path, pattern)
        for row in rows:
            yield *row, own.encode(row[at] or "")

    return map_rows(docs, run, f"{ddl(docs)}, `{into}` array<int>", per_batch=200)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """The rows with the text of their token ids in column ``into``; other columns pass through."""
    ship(encoded.sparkSession)
    encoded = encoded.drop(into)
    at = encoded.columns.index(ids)

    def run(rows):
        own = codec(path, pattern)
        for row in rows:
            stream = StreamDecoder(own.transducer.tokens)
            yield *row, stream.feed(row[at] or ()) + stream.finish()

    return map_rows(encoded, run, f"{ddl(encoded)}, `{into}` string", per_batch=200)
