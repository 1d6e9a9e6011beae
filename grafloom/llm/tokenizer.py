"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece's bytes there is exactly one token that its encoding can end with. Which one, depends only
on the prefix: a token that ends there is it if it may stand after the last token of the prefix before it. So one pass
over the bytes encodes a piece, an append goes on where the text ended, and after an edit only the bytes from the edit
until the old and new last tokens agree again are looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from grafloom.plans.runtime import ship

#: How the public byte-level vocabularies write a byte as a character, and split a text into pieces.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after its end that a match of the pattern can depend on.
LOOKAHEAD = 3
#: Pieces whose ids a worker remembers.
CACHE = 250_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PrefixEncoder:
    """A byte-level BPE vocabulary with merges in order of rank."""

    def __init__(self, spec: bytes) -> None:
        import regex

        model = json.loads(spec)["model"]
        names = dict(zip(map(chr, PRINTED), PRINTED, strict=True)) | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PRINTED))}
        self.split = regex.compile(PATTERN).findall
        self.pattern = regex.compile(PATTERN)
        self.ids = {bytes(names[c] for c in t): i for t, i in model["vocab"].items() if all(c in names for c in t)}
        self.merged, self.parts, self.rank = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = model["vocab"]["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            self.merged[a, b] = whole
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (a, b), rank
        # The prefixes of all tokens, with the id where a prefix is itself a token.
        self.prefixes: dict[bytes, int] = {}
        for t in self.ids:
            for k in range(1, len(t)):
                self.prefixes.setdefault(t[:k], -1)
        self.prefixes |= self.ids
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.longest = max(self.length.values())
        self._follows: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether `b` can stand right after `a`: no merge across their border comes before those that made them."""
        key = a << 20 | b
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > 4 * CACHE:
                self._follows.clear()
            known = self._follows[key] = self._crosses_late(a, b)
        return known

    def _crosses_late(self, a: int, b: int) -> bool:
        # The tokens beside the border, back in time: undo the younger one's merge, until a merge across shows up
        # that would have come before what was undone so far, or both are single bytes.
        undone, by_right = 1 << 40, True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None:
                rank = self.rank[joined]
                # Equal merges go from left to right, so on a tie the merge across is first only if it is the left one.
                if rank < undone or (rank == undone and by_right):
                    return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                undone, by_right, a = ra, False, self.parts[a][1]
            elif rb > ra:
                undone, by_right, b = rb, True, self.parts[b][0]
            else:  # the same token twice: its right copy was made later
                undone, by_right, b = rb, True, self.parts[b][0]

    def last_tokens(self, data: bytes, last: list[int], start: int = 0) -> list[int]:
        """`last`, in which entry k is the last token of the first k bytes (-1: not known yet), filled from `start` on.

        Entries up to `start` must be those of the same bytes; `start` is 0 or any place.
        """
        n, prefixes, follows = len(data), self.prefixes, self.may_follow
        last.extend([-1] * (n + 1 - len(last)))
        for k in range(start + 1, n + 1):
            last[k] = -1
        for j in range(max(0, start - self.longest), n):
            before = last[j]
            if before < 0 and j:
                continue
            for k in range(j + 1, n + 1):
                token = prefixes.get(data[j:k])
                if token is None:
                    break
                if k > start and token >= 0 and last[k] < 0 and (j == 0 or follows(before, token)):
                    last[k] = token
        return last

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        out, k = [], len(data)
        while k:
            out.append(last[k])
            k -= self.length[last[k]]
        return out[::-1]

    def piece(self, piece: str) -> tuple[int, ...]:
        got = self.cache.get(piece)
        if got is None:
            data = piece.encode("utf-8", "surrogatepass")
            # A piece that is an entry of the vocabulary is no exception: only merges decide.
            got = tuple(self.walk(data, self.last_tokens(data, [-1])))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(data) <= 64:
                self.cache[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache, piece = self.cache, self.piece
        for p in self.split(text):
            out += cache.get(p) or piece(p)
        return out

    def count(self, text: str) -> int:
        cache, piece = self.cache, self.piece
        return sum(len(cache.get(p) or piece(p)) for p in self.split(text))


@dataclass
class _Piece:
    size: int  # characters
    data: bytes
    last: list[int]
    ids: list[int]


@dataclass
class _Block:
    """Some neighbouring pieces and their text; nothing in it depends on where in the whole text it is."""

    text: str
    pieces: list[_Piece]


class EncodedText:
    """A text with the last token of every byte prefix of its pieces, for exact appends and edits.

    It is held in blocks of some `BLOCK` pieces. An edit looks at the pieces from shortly before it until old and new pieces
    begin at the same place again, and makes the blocks of these anew; all others stay as they are.
    """

    BLOCK = 64

    def __init__(self, encoder: PrefixEncoder, text: str = "") -> None:
        self.encoder, self.blocks, self.looked_at = encoder, [], 0
        self.replace(0, 0, text)

    @property
    def text(self) -> str:
        return "".join(b.text for b in self.blocks)

    def __len__(self) -> int:
        return sum(len(b.text) for b in self.blocks)

    def ids(self) -> list[int]:
        return [t for b in self.blocks for p in b.pieces for t in p.ids]

    def append(self, more: str) -> None:
        n = len(self)
        self.replace(n, n, more)

    def _place(self, at: int) -> tuple[int, int]:
        """The block that holds a character (the last one, past the end) and where it begins."""
        begin = 0
        for i, b in enumerate(self.blocks):
            if at < begin + len(b.text) or i == len(self.blocks) - 1:
                return i, begin
            begin += len(b.text)
        return 0, 0

    def replace(self, start: int, stop: int, new: str) -> None:
        """Puts `new` in place of the characters `start` to `stop`; only what can change is split and encoded again.
        `looked_at` is the number of pieces that were made."""
        first, begin = self._place(max(0, start - LOOKAHEAD))
        pieces = list(self.blocks[first].pieces) if self.blocks else []
        # Pieces that end well before the edit stay.
        keep, at = 0, begin
        while keep < len(pieces) and at + pieces[keep].size + LOOKAHEAD <= start:
            at += pieces[keep].size
            keep += 1
        before = at - begin  # characters of the block that stay
        old, taken, loaded = pieces[keep:], first + 1, begin + (len(self.blocks[first].text) if self.blocks else 0)
        behind = self.blocks[first].text[before:] if self.blocks else ""

        def load() -> bool:
            """Takes one more block into the part that is looked at."""
            nonlocal taken, loaded, behind
            if taken >= len(self.blocks):
                return False
            old.extend(self.blocks[taken].pieces)
            behind += self.blocks[taken].text
            loaded += len(self.blocks[taken].text)
            taken += 1
            return True

        while loaded < stop and load():
            pass
        build = lambda: behind[: start - at] + new + behind[stop - at :]
        buffer, made, pos, same = build(), [], 0, None
        begins, known, upto = {}, 0, 0  # of the old pieces behind the edit, in places of the buffer
        shift, e = len(new) - (stop - start), self.encoder
        while same is None:
            while known < len(old):
                if at + upto >= stop:
                    begins[upto + shift] = known
                upto += old[known].size
                known += 1
            if pos in begins and pos >= start - at + len(new):
                same = begins[pos]
                break
            m = e.pattern.match(buffer, pos) if pos < len(buffer) else None
            # What a match depends on must be there, or nothing more.
            if (m is None or m.end() + LOOKAHEAD > len(buffer)) and load():
                buffer = build()
                continue
            if m is None:
                same = len(old)
                break
            data = m.group().encode("utf-8", "surrogatepass")
            was = old[len(made)] if len(made) < len(old) else None
            n = _common(was.data, data) if was else 0
            last = e.last_tokens(data, list(was.last[: n + 1]), n) if was else e.last_tokens(data, [-1])
            made.append(_Piece(m.end() - pos, data, last, e.walk(data, last)))
            pos = m.end()
        self.looked_at = len(made)
        whole = pieces[:keep] + made + old[same:]
        text = (self.blocks[first].text[:before] if self.blocks else "") + buffer
        blocks, done = [], 0
        for i in range(0, len(whole), self.BLOCK):
            part = whole[i : i + self.BLOCK]
            size = sum(p.size for p in part)
            blocks.append(_Block(text[done : done + size], part))
            done += size
        self.blocks[first:taken] = blocks


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


_encoders: dict[int, PrefixEncoder] = {}


def encoder_of(spec: bytes) -> PrefixEncoder:
    """The worker's encoder for a vocabulary, made once."""
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = PrefixEncoder(spec)
    return _encoders[key]


def encode_corpus(rows: DataFrame, text: str, ids: str | None = "ids", count: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """`rows` with the token ids of the column `text` (array<int>) and/or their number (bigint).

    No special tokens; their strings are ordinary text. Null and empty text both give an empty list and 0. Texts are
    encoded whole, whatever their length. `tokenizer` is the path of a byte-level BPE file in the driver; its bytes
    (under 2 MB) are broadcast. No shuffle: a map over the rows. The names of the new columns must not be taken.
    """
    taken = {c.lower() for c in rows.columns} & {c.lower() for c in (ids, count) if c}
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist already")
    ship(rows.sparkSession)
    with open(tokenizer or default_path(), "rb") as f:
        spec = rows.sparkSession.sparkContext.broadcast(f.read())
    where = rows.schema.names.index(text)

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        e = encoder_of(spec.value)
        for batch in batches:
            texts = batch.column(where)
            new, names = [], []
            if ids:
                lists = [e.encode(t.as_py() or "") if t.is_valid else [] for t in texts]
                lengths = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(lengths.sum()))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                new.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                names.append(ids)
                if count:
                    new.append(pa.array(lengths))
                    names.append(count)
            elif count:
                new.append(pa.array([e.count(t.as_py()) if t.is_valid else 0 for t in texts], pa.int64()))
                names.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    new = [f"`{ids}` array<int>"] * bool(ids) + [f"`{count}` bigint"] * bool(count)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + new)
    return rows.mapInArrow(encode, schema)
