"""Byte-pair encoding and decoding of whole texts in a stream.

Encoding.  A text is cut where a cut can never change the result: before a space that a non-space follows (no
pre-token contains such a place) and around added tokens.  Every pre-token, of whatever length, is encoded by a transducer that reads it byte
by byte: the last token of the encoding of each prefix is the one that stays apart from the last token of the prefix before it,
so prefixes form a tree, and only the last ``lookahead`` prefixes can still be continued, where ``lookahead``
is the longest token the merge list can build.  Tokens that all of these share are stable; they are emitted and
forgotten.  Whether two tokens stay apart is told by the merges that built their facing sides: none of the pairs that face each
other at some time may merge before one of its sides is merged away.  Results of frequent pre-tokens are kept in a memo of bounded size.

Decoding keeps the bytes of an unfinished character only, and replaces malformed bytes by U+FFFD.

Null texts count as empty and have no tokens.  Repeated rows get equal results; other columns are ignored.
"""
from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame, functions as F

from .common import documents, released, slices, text_of

#: The pre-token pattern of byte-level BPE, and white space as Unicode defines it.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts, found faster: words and numbers, which begin like no other alternative, go first and give nothing back.
CUTS = r" ?\p{L}++| ?\p{N}++|" + PRE_TOKEN
WHITE = "\t-\r \x85\xa0  -     　"
#: Pre-tokens remembered in each of two generations; texts are cut to windows of so many characters.
MEMO, WINDOW = 150_000, 1 << 16
#: Beginnings of words remembered, with their last token and their ids.
BEGUN = 150_000
#: Longer pre-tokens are not remembered.
LONG = 96
NEVER, SHORT = 1 << 60, (2, 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import re

        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        vocab = spec["model"]["vocab"]
        self.ids = {as_bytes(t): i for t, i in vocab.items()}
        self.tokens = {i: b for b, i in self.ids.items()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        #: Sufficient lookahead in bytes: no token that the merge list builds is longer.
        self.lookahead = max(len(self.tokens[i]) for i in [*self.byte_ids, *(new for _, new in self.merges.values())])
        self.find = regex.compile(CUTS).findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.cut = re.compile(f" (?=[^{WHITE}])")
        self.pair = lru_cache(1 << 16)(self._stays)
        self.begun: dict[bytes, tuple[int, bytes]] = {}
        self.packed = {i: array("i", [i]).tobytes() for i in self.tokens}
        # what each token is merged from, and when; of several rules the first
        self.rank, self.parts = {}, {}
        for pair, (rank, new) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            if new not in self.parts:
                self.rank[new], self.parts[new] = rank, pair
        #: Bytes -> the token that they encode to, for those that encode to one token.
        self.whole = {bytes([b]): i for b, i in enumerate(self.byte_ids)}
        for new, (a, b) in self.parts.items():
            if self.whole.get(self.tokens[a]) == a and self.whole.get(self.tokens[b]) == b and self._stays(a, b, self.rank[new]):
                self.whole[self.tokens[new]] = new
        #: Sizes of tokens by their last three bytes, longest first.
        ends: dict[bytes, set[int]] = {}
        for t in self.whole:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        self.sizes = {tail: (*sorted(n, reverse=True), *SHORT) for tail, n in ends.items()}
        self.memo = _Memo(self)

    # -- encoding

    def merge(self, piece: bytes) -> list[int]:
        """Merges of the lowest rank first, the leftmost of equals first."""
        get, ids = self.merges.get, [self.byte_ids[b] for b in piece]
        ranks = [get(p, (NEVER, 0)) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best[0] == NEVER:
                break
            k = ranks.index(best)
            ids[k:k + 2] = [best[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), (NEVER, 0))
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), (NEVER, 0))
        return ids

    def _stays(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether two tokens side by side stay apart, before the merge of rank ``until``."""
        left, right, rank, parts, rule = until, until, self.rank, self.parts, self.merges.get   # when a and b are merged away
        while True:
            met = rule((a, b))
            # of equal rules the leftmost goes first
            if met is not None and met[0] < left and met[0] <= right and met[0] < until:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                left, a = ra, parts[a][1]
            else:
                right, b = rb, parts[b][0]

    def _last(self, data: bytes, n: int, last: dict[int, tuple]) -> tuple:
        """Last token of the encoding of the first ``n`` bytes and the prefix in front of it; ``last`` keeps what was found."""
        found = last.get(n)
        if found is not None:
            return found
        whole, stays = self.whole.get, self.pair
        for size in self.sizes.get(data[n - 3:n], SHORT) if n > 2 else SHORT:
            if size <= n:
                token = whole(data[n - size:n])
                if token is not None:
                    before = n - size
                    previous, at = last.get(before) or self._last(data, before, last)
                    if at >= 0 and (previous is None or stays(previous, token)):
                        found = last[n] = token, before
                        return found
        # only in a stream: a prefix whose last token would reach behind what is stable, and which can't be continued
        found = last[n] = None, -1
        return found

    def _ending(self, data: bytes) -> tuple[int, bytes]:
        """Last token of the encoding of ``data``, which is not among the beginnings remembered, and the packed ids of all its tokens."""
        whole, stays, begun, n = self.whole.get, self.pair, self.begun, len(data)
        for size in self.sizes.get(data[-3:], SHORT):
            if size < n:
                token = whole(data[n - size:])
                if token is not None:
                    head = data[:n - size]
                    before = begun.get(head) or self._ending(head)
                    if stays(before[0], token):
                        found = begun[data] = token, before[1] + self.packed[token]
                        return found
            elif size == n and (token := whole(data)) is not None:
                found = begun[data] = token, self.packed[token]
                return found
        raise ValueError("a byte without a token")

    def _short(self, data: bytes) -> array:
        """Token ids of bytes that are all there is; beginnings that many words share are remembered."""
        if len(self.begun) >= BEGUN:
            self.begun.clear()
        return array("i", (self.begun.get(data) or self._ending(data))[1] if data else b"")

    def _path(self, data: bytes, n: int, last: dict[int, tuple]) -> list[int]:
        out = []
        while n:
            token, n = self._last(data, n, last)
            out.append(token)
        out.reverse()
        return out

    def transduce(self, data: Iterable[int], block: int = 0) -> Iterable[int]:
        """Token ids of a stream of bytes, each as soon as no continuation can change it.

        Keeps the prefixes behind the last stable one: at most ``lookahead`` and a path that hasn't become stable.
        """
        # nothing of so few bytes is stable before their end
        return self._short(data) if isinstance(data, bytes) and len(data) <= self.lookahead else self._stream(data, block)

    def _stream(self, data: Iterable[int], block: int) -> Iterator[int]:
        block, stream = block or 2 * self.lookahead, iter(data)
        held, last = b"", {0: (None, 0)}
        while more := bytes(islice(stream, block)):
            if len(held) >= self.lookahead and (end := self._stable(held, last)):
                out = self._path(held, end, last)
                yield from out
                held = held[end:]
                last = {0: (out[-1], 0)} | {n - end: (t, before - end) for n, (t, before) in last.items() if before >= end}
            held += more
        yield from self._path(held, len(held), last)

    def _stable(self, data: bytes, last: dict[int, tuple]) -> int:
        """The longest prefix on the path of every prefix that can still be continued; 0 if there is none."""
        for n in range(1, len(data) + 1):
            self._last(data, n, last)
        live = set(range(len(data) - self.lookahead + 1, len(data) + 1))
        while len(live) > 1:
            n = max(live)
            live.remove(n)
            live.add(last[n][1])
        return live.pop()

    def piece(self, piece: str) -> bytes:
        """Ids of a pre-token, as 32-bit integers."""
        return array("i", self.transduce(piece.encode())).tobytes()

    def windows(self, text: str) -> Iterator[str]:
        """The text in windows that end at cuts; a longer run without any stays whole."""
        at = 0
        while len(text) - at > WINDOW:
            m = self.cut.search(text, at + WINDOW)
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as 32-bit integers, window by window."""
        get = self.memo.__getitem__
        for part in self.special(text) if self.special else [text]:
            if part in self.added:
                yield array("i", [self.added[part]]).tobytes()
                continue
            for window in self.windows(part):
                yield b"".join(map(get, self.find(window)))

    # -- decoding

    def decode(self, ids: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of blocks of ids; bytes of a character that a block leaves open wait for the next one."""
        state, get = codecs.getincrementaldecoder("utf-8")("replace"), self.tokens.__getitem__
        for block in ids:
            yield state.decode(b"".join(map(get, block)))
        yield state.decode(b"", True)


    def forget(self) -> None:
        """Drops what was remembered: an idle worker keeps the vocabulary alone."""
        self.memo = _Memo(self)
        self.begun.clear()


class _Memo(dict):
    """Two generations of results; the older one is dropped when the younger is full."""

    def __init__(self, owner: ByteBPE):
        self.owner, self.old = owner, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self.owner.piece(piece)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        if len(piece) <= LONG:
            self[piece] = out
        return out


@lru_cache(4)
def load(path: str) -> ByteBPE:
    """One copy per worker."""
    return ByteBPE(path)


def _text(coder: ByteBPE, ids, block: int) -> str:
    """What an array of ids decodes to, ``block`` ids at a time."""
    return "".join(coder.decode(ids[k:k + block].tolist() for k in range(0, len(ids), block)))


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), back: bool = False, block: int = 1 << 16) -> DataFrame:
    """``keep`` and ``ids``, the token ids of every whole text; with ``back`` also ``decoded``, the text that these ids give, from the same worker."""
    def run(b, coder):
        import numpy as np
        import pyarrow as pa
        coded = [b"".join(coder.encode(t)) for t in b.column("_text").to_pylist()]
        ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
        flat = np.frombuffer(b"".join(coded), np.int32)
        rest = b.drop_columns(["_text"])
        made = {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}
        if back:
            made["decoded"] = pa.array([_text(coder, flat[i:j], block) for i, j in zip(ends, ends[1:])], pa.string())
        return pa.RecordBatch.from_arrays([*rest.columns, *made.values()], names=[*rest.schema.names, *made])
    df = docs.select(*keep, text_of(docs, text).alias("_text"))
    new = [F.lit(None).cast("array<int>").alias("ids"), F.lit("").alias("decoded")]
    schema = docs.select(*keep, *new[:1 + back]).schema

    def task(batches):
        coder = load(path)
        for part in slices(batches, "_text"):
            yield run(part, coder)
        coder.forget()
    return df.mapInArrow(released(task), schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", block: int = 1 << 16) -> DataFrame:
    """``coded`` with ``decoded``, the text of its token ids."""
    schema = coded.select("*", F.lit("").alias("decoded")).schema

    def run(batches):
        import numpy as np
        import pyarrow as pa
        coder, none = load(path), np.zeros(0, np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [_text(coder, none if row.values is None else row.values.to_numpy(zero_copy_only=False), block) for row in b.column(ids)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])
    return coded.mapInArrow(released(run), schema)


def vocabulary() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def stage(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids of every text, their number, and digests of the ids and of the text they decode to."""
    path = path or vocabulary()
    return encode(docs, path, back=True).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark, folder):
    return stage(documents(spark, folder))
