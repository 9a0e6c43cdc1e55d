"""Exact byte-level BPE by dynamic programming over prefixes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabularies are; a parameter of every operator.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte_bpe_50k vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a worker keeps of pieces and of token pairs before it starts afresh (memory bound; results don't depend on it).
CACHE = 400_000


def byte_alphabet() -> dict[str, str]:
    """The printable character that stands for each byte in the vocabulary, to that byte (latin-1)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encodes pieces of text with a merge-ranked byte vocabulary.

    For every prefix of a piece there is exactly one last token of its encoding. The
    tokens ending at a position come from an automaton over the whole vocabulary; of
    them the one is right whose predecessor - the last token of the prefix it leaves -
    it may follow. Two tokens may follow each other if merging their bytes gives these
    two tokens again, which shows at their touching edges: no merge of a token of the
    left one's right edge with one of the right one's left edge comes before the merges
    that swallow these two. Back-pointers then give the ids.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        alphabet = byte_alphabet()
        raw = {"".join(alphabet[c] for c in t): i for t, i in vocab.items() if all(c in alphabet for c in t)}
        ids = {t: i for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = ids[a], ids[b]
            self.rank.setdefault(pair, r)
            made.setdefault(ids[a + b], (*pair, r))
        never = len(merges)
        # edges: (token, rank of the merge that swallows it), from the whole token inwards
        self.right: dict[int, tuple[tuple[int, int], ...]] = {}
        self.left: dict[int, tuple[tuple[int, int], ...]] = {}
        for i in raw.values():
            for edges, side in ((self.right, 1), (self.left, 0)):
                edge, at, swallowed = [], i, never
                while True:
                    edge.append((at, swallowed))
                    if at not in made:
                        break
                    swallowed, at = made[at][2], made[at][side]
                edges[i] = tuple(edge)
        self.ids = raw
        self.tokens = ahocorasick.Automaton()
        for t, i in raw.items():
            self.tokens.add_word(t, (len(t), i))
        self.tokens.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    @classmethod
    def load(cls, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> PrefixEncoder:
        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may come right after token a in an encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            rank = self.rank
            known = True
            for x, x_gone in self.right[a]:
                for y, y_gone in self.left[b]:
                    r = rank.get((x, y))
                    # of equal merges the left one goes first
                    if r is not None and r < x_gone and r <= y_gone:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= CACHE * 4:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of text (as cut by PATTERN)."""
        s = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(s)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        pairs, follows = self.pairs, self.follows
        # the automaton gives, at each end, the longest token first
        for end, (size, token) in self.tokens.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            at = end - size
            before = last[at]
            if at == 0 or before >= 0 and (pairs.get((before, token)) if (before, token) in pairs else follows(before, token)):
                last[end], start[end] = token, at
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts."""
        out: list[int] = []
        if not text:
            return out
        pieces = self.pieces
        for p in self.split(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.encode_piece(p)
                if len(p) <= 64:
                    if len(pieces) >= CACHE:
                        pieces.clear()
                    pieces[p] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> PrefixEncoder:
    """The encoder of a vocabulary, built once per Python worker."""
    return PrefixEncoder.load(folder, name)


def encode_texts(df: DataFrame, ident: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """ident and ids (array<int>) of every row, without special tokens.

    Null and empty texts give an empty list; strings of special tokens in a text are
    ordinary text; whole texts of any length are encoded. One map over the rows, without
    shuffle. Extra columns are pruned; repeated rows stay.
    """
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            texts = b.column(1)
            for lo in range(0, b.num_rows, 512):
                part = texts.slice(lo, 512).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 512), pa.array([enc.encode(t) for t in part], pa.list_(pa.int32()))], names=[ident, "ids"])

    return df.select(ident, text).mapInArrow(run, f"{ident} {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, into: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """Adds `into`, the number of ids of each text (0 for null and empty); texts don't travel on."""
    keep = [c for c in df.columns if c != text]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            n = pa.array([len(enc.encode(t)) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, into])

    return df.select(*keep, text).mapInArrow(run, f"{ddl}, {into} bigint")
