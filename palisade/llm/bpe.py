"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

Encoding. The text is cut into pieces by the tokenizer's pattern. Within a piece the transducer reads bytes one at a
time and keeps, for each byte position, the last token of the encoding of the prefix ending there: it is the one
vocabulary token that ends there and is compatible with the last token of the prefix before it (two tokens are
compatible if their joined bytes encode to just these two). The merge list has a sufficient lookahead
(sufficient_lookahead()), a number of bytes after which no boundary can change: tokens that end so many bytes back are
stable, and are emitted and forgotten while the piece goes on, so the state is bounded whatever the piece's length.

Every piece goes through the transducer; the ids of recent short pieces are remembered, in a table of bounded size. Pieces
are found, encoded, digested and decoded as a stream: beside the text itself, no more than CHUNK pieces or ids are held.

Nulls: a null text is an empty one, with no tokens. Special token strings in a text become their special ids, as in
the tokenizers library. Repeated rows and ids are rows of their own; an empty table gives no rows; extra columns aren't
looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Fixed value: the pattern of byte-level BPE that cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of at most so many characters are remembered, in a table that is emptied at so many entries.
MEMO_CHARS, MEMO_SIZE = 32, 300_000
#: Pieces, bytes or ids that are handled at a time; bytes between two looks for stable tokens.
CHUNK, EMIT_EVERY = 4096, 64
#: Characters that are cut into pieces at a time, where the next place at which a piece must begin isn't much further on.
WINDOW = 1 << 14


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, mapped to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Merges:
    """The vocabulary and merge list of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        as_bytes = lambda s: bytes(of[c] for c in s)
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.rank = {m: i for i, m in reversed(list(enumerate(self.merges)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: s for s, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        made = {bytes([b]): -1 for b in range(256)}  # each symbol's rank of birth
        #: Whether each merge joins symbols that merges before it have made, so that merges happen in order of rank.
        self.proper = all(made.get(a, r) < r and made.get(b, r) < r and made.setdefault(a + b, r) == r for r, (a, b) in enumerate(self.merges))
        self._parts = {a + b: (a, b, r) for r, (a, b) in enumerate(self.merges)}
        #: Every suffix of every token, with the token's id where the suffix is a token itself, else -1.
        self.suffixes: dict[bytes, int] = {}
        for t in self.ids:
            for i in range(1, len(t)):
                self.suffixes.setdefault(t[i:], -1)
        self.suffixes |= self.ids

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The symbols at one end of token while it is made, each with the rank of the merge that takes it up."""
        out, parts = [(token, 1 << 60)], self._parts
        while token in parts:
            death, token = parts[token][2], parts[token][side]
            out.append((token, death))
        return out

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether a + b encodes to just [a, b]: no merge across the boundary comes before those on either side."""
        if not self.proper:
            return self.merged(a + b) == [a, b]
        rank, left = self.rank, self._spine(b, 0)
        for x, x_gone in self._spine(a, 1):
            for y, y_gone in left:
                r = rank.get((x, y))
                if r is not None and r < x_gone and r <= y_gone:
                    return False
        return True

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of data by the definition: the pair of least rank, leftmost first, is merged until none is left."""
        parts, rank, none = [data[i : i + 1] for i in range(len(data))], self.rank, 1 << 60
        ranks = [rank.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = rank.get((parts[at], parts[at + 1]), none)
        return parts

    def sufficient_lookahead(self) -> int:
        """Bytes after which a token boundary can't change.

        Whether a merge (u, v) happens depends on what lies right of it only if an earlier merge takes v's last symbol
        away: one of lower rank whose left side ends v's derivation. The bound is the most bytes that a chain of such
        merges, each of lower rank than the one before, spans to the right.
        """
        best: dict[bytes, int] = {}
        right = {}
        for u, v in self.merges:
            right.setdefault(u + v, v)
        most = 1
        for u, v in self.merges:
            reach, spine = 0, v
            while spine is not None:
                reach = max(reach, best.get(spine, 0))
                spine = right.get(spine)
            reach += len(v)
            best[u] = max(best.get(u, 0), reach)
            most = max(most, reach)
        return most


class Transducer:
    """Bytes of one piece in, token ids out as soon as they are stable."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.lookahead = merges.sufficient_lookahead()
        self._fits: dict[tuple[bytes, bytes], bool] = {}

    def fits(self, pair: tuple[bytes, bytes]) -> bool:
        if len(self._fits) >= MEMO_SIZE:
            self._fits.clear()
        got = self._fits[pair] = self.m.fits(*pair)
        return got

    def run(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of the joined chunks. State: the bytes and last tokens since the last boundary that was emitted, and a chunk."""
        ids, get, fits, known_fits = self.m.ids, self.m.suffixes.get, self.fits, self._fits.get
        data, last, origin = b"", [b""], 0  # last[i]: last token of the prefix data[:i]; up to origin, all is emitted
        before, due = b"", self.lookahead + EMIT_EVERY  # the last token emitted; where tokens are next looked for
        for chunk in chunks:
            data += chunk
            for end in range(len(last), len(data) + 1):
                start = end
                while True:
                    start -= 1
                    token = data[start:end]
                    known = get(token)
                    if known is None:
                        raise ValueError(f"no token of the vocabulary can end in {data[max(origin, end - 16) : end]!r}")
                    if known >= 0:
                        prior = last[start] if start > origin else before
                        if not prior:
                            break
                        pair = prior, token
                        ok = known_fits(pair)
                        if ok or ok is None and fits(pair):
                            break
                last.append(token)
                if end >= due:
                    stable = end
                    while stable > end - self.lookahead:
                        stable -= len(last[stable])
                    done = self._chain(last, stable, origin)
                    if done:
                        yield from map(ids.__getitem__, done)
                        before, origin = done[-1], stable
                    due = end + EMIT_EVERY
            due -= origin
            data, last, origin = data[origin:], [b"", *last[origin + 1 :]], 0
        yield from map(ids.__getitem__, self._chain(last, len(data), 0))

    @staticmethod
    def _chain(last: list[bytes], end: int, origin: int) -> list[bytes]:
        out = []
        while end > origin:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]


class _Memo(dict):
    """Piece of text -> its ids, packed as little-endian unsigned 32-bit integers.

    Of bounded size: when it is full, it becomes the older half, in which pieces are looked up before they are encoded
    anew, and the half before it is forgotten. Frequent pieces so survive.
    """

    def __init__(self, transducer: Transducer):
        self.t, self.older = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode()
            packed = array("I", self.t.run((data,))).tobytes()
        if len(self) >= MEMO_SIZE:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Codec:
    """encode() and decode() of a byte-level BPE tokenizer file."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        import regex

        self.merges = Merges(path)
        self._memo = _Memo(Transducer(self.merges))
        self._pieces = regex.compile(PATTERN)
        #: A space between a character that isn't white and a letter begins a piece, whatever stands around it.
        self._begin = regex.compile(r"(?<=\S) (?=\p{L})")
        special = sorted(self.merges.special, key=len, reverse=True)
        self._split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else lambda s: [s]
        top = max(self.merges.bytes_of) + 1
        self._bytes = [self.merges.bytes_of.get(i, b"") for i in range(top)]

    @classmethod
    def of(cls, path: str) -> Codec:
        """One codec a process and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode_stream(self, text: str) -> Iterator[bytes]:
        """Ids of the text, packed as little-endian unsigned 32-bit integers, as they come out."""
        get = self._memo.__getitem__
        for i, part in enumerate(self._split(text)):
            if i % 2:
                yield self.merges.special[part].to_bytes(4, "little")
                continue
            for short in self._found(part):
                if max(map(len, short)) <= MEMO_CHARS:
                    yield b"".join(map(get, short))
                    continue
                for piece in short:
                    if len(piece) <= MEMO_CHARS:
                        yield get(piece)
                    else:
                        ids = self._memo.t.run(piece[j : j + CHUNK].encode() for j in range(0, len(piece), CHUNK))
                        while packed := array("I", islice(ids, CHUNK)).tobytes():
                            yield packed

    def _found(self, text: str) -> Iterator[list[str]]:
        """The pieces of text, not very many at a time."""
        at, size = 0, len(text)
        while at < size:
            m = self._begin.search(text, at + WINDOW) if size - at > WINDOW else None
            end = m.start() if m else size
            if end - at <= 4 * WINDOW:
                yield self._pieces.findall(text, at, end)
            else:
                some = self._pieces.finditer(text, at, end)
                while short := [x[0] for x in islice(some, CHUNK)]:
                    yield short
            at = end

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_stream(text)), dtype="<u4").tolist()

    def decode_stream(self, packed: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids, piece by piece; the machine's state between pieces is an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get = self._bytes.__getitem__
        for part in packed:
            yield machine.decode(b"".join(map(get, np.frombuffer(part, dtype="<u4").tolist())))
        yield machine.decode(b"", final=True)

    def decode(self, ids: list[int]) -> str:
        whole = np.asarray(ids, dtype="<u4")
        return "".join(self.decode_stream(whole[at : at + CHUNK].tobytes() for at in range(0, len(whole), CHUNK)))


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    path = path or default_path()

    def row(text: str | None) -> tuple[int, str, str]:
        codec = Codec.of(path)
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

        def counted() -> Iterator[bytes]:
            nonlocal n
            for packed in codec.encode_stream(text or ""):
                n += len(packed) // 4
                of_ids.update(packed)
                yield packed

        for decoded in codec.decode_stream(counted()):
            of_text.update(decoded.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    return map_texts(docs, "text", row, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string")
