"""Token counts under edits: segment trees over a document's pre-tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits text into pre-tokens as the vocabulary's publisher does; every character falls in one.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pre-token can depend on this many characters after its end.
LOOK_AHEAD = 2
LEAF, KEPT = 64, 200_000
EDIT = "struct<pos:int,removed:int,added:string>"


class Counts(dict):
    """Tokens of a pre-token; a bounded memory of those seen before."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n


@lru_cache(maxsize=2)
def _counts(path: str) -> Counts:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Counts(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))


_split = regex.compile(PATTERN)


class TokenTree:
    """A text's pre-tokens in leaves of about LEAF, under a binary tree of (characters, tokens) sums.

    A leaf holds its own text, so that an edit touches the leaves that it reaches and no other text. A
    leaf that has grown is split, one that has shrunk joins its neighbour.
    """

    def __init__(self, leaves: list[Leaf], counts: Counts):
        self.counts, self.encoded = counts, 0
        self.leaves = leaves or [("", np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self._add_up()

    @classmethod
    def of(cls, text: str, counts: Counts) -> TokenTree:
        pieces = _split.findall(text)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return cls(_leaves(text, size, np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces))), counts)

    def _add_up(self) -> None:
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(self.leaves)] = [(len(x), t.sum()) for x, _, t in self.leaves]
        below = self.width
        while below > 1:
            self.sums[below // 2 : below] = self.sums[below : 2 * below].reshape(-1, 2, 2).sum(axis=1)
            below //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(x for x, _, _ in self.leaves)

    def _leaf(self, place: int) -> tuple[int, int]:
        """(leaf that holds the character at ``place``, the last one for the text's end; the characters before that leaf)."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            left = int(self.sums[k, 0])
            if place >= before + left and before + left < self.sums[1, 0]:
                before += left
                k += 1
        return min(k - self.width, len(self.leaves) - 1), before

    def _replace(self, first: int, last: int, new: list[Leaf]) -> None:
        same = len(new) == last - first + 1
        self.leaves[first : last + 1] = new
        if not same:
            self._add_up()
            return
        for leaf in range(first, last + 1):
            k = self.width + leaf
            self.sums[k] = len(self.leaves[leaf][0]), self.leaves[leaf][2].sum()
            while k > 1:
                k //= 2
                self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def edit(self, pos: int, removed: int, added: str) -> None:
        """Replace ``removed`` characters from ``pos`` (both cut to the text) by ``added``.

        Pre-tokens are matched again from the first that the edit can reach until a new one begins where
        an old one began behind the edit. Text behind the edit is taken leaf by leaf, twice as many each
        time, as long as the matches run into its end.
        """
        total = int(self.sums[1, 0])
        pos = min(max(pos, 0), total)
        end = min(pos + max(removed, 0), total)
        shift = len(added) - (end - pos)
        first, before = self._leaf(max(pos - LOOK_AHEAD, 0))
        starts = before + np.concatenate([[0], np.cumsum(self.leaves[first][1])])
        keep = int(np.searchsorted(starts[1:], pos - LOOK_AHEAD, side="right"))
        at, more = int(starts[keep]), 1
        while True:
            last = min(self._leaf(end)[0] + more, len(self.leaves) - 1)
            reach = self.leaves[first : last + 1]
            old = "".join(x for x, _, _ in reach)
            text = old[at - before : pos - before] + added + old[end - before :]
            begins = before + np.concatenate([[0], np.cumsum(np.concatenate([s for _, s, _ in reach]))])
            whole = last == len(self.leaves) - 1
            sizes, met = self._match(text, len(text) if whole else len(text) - LOOK_AHEAD, at, pos + len(added), shift, begins)
            if met is not None or whole:
                break
            more *= 2
        met = len(begins) - 1 if met is None else met
        held = np.cumsum([len(s) for _, s, _ in reach])
        stop = int(np.searchsorted(held, met, side="right"))  # the leaf in which the old pre-tokens go on
        stop = min(stop, len(reach) - 1)
        own = slice(met, int(held[stop]))
        size, tokens = (np.concatenate([leaf[k] for leaf in reach]) for k in (1, 2))
        done = sum(sizes)
        news = np.fromiter((self.counts[p] for p in _cut(text, sizes)), np.int64, len(sizes))
        self.encoded += len(sizes)
        rest = old[int(begins[met]) - before : int(begins[int(held[stop])]) - before]
        new_text = old[: at - before] + text[:done] + rest
        new_size = np.concatenate([size[:keep], np.array(sizes, np.int64), size[own]])
        new_tokens = np.concatenate([tokens[:keep], news, tokens[own]])
        final = first + stop
        if len(new_size) < LEAF // 4 and final + 1 < len(self.leaves):
            final += 1
            x, s, t = self.leaves[final]
            new_text, new_size, new_tokens = new_text + x, np.concatenate([new_size, s]), np.concatenate([new_tokens, t])
        self._replace(first, final, _leaves(new_text, new_size, new_tokens) or [(new_text, new_size, new_tokens)])

    def _match(self, text: str, safe: int, at: int, behind: int, shift: int, begins: np.ndarray) -> tuple[list[int], int | None]:
        """(lengths of the pre-tokens of ``text``, which begins at ``at``; number of the old one that begins where they end behind the edit, if they do so before ``safe``)."""
        sizes: list[int] = []
        for m in _split.finditer(text):
            place = at + m.start()
            if place >= behind:
                k = int(np.searchsorted(begins, place - shift))
                if k < len(begins) and begins[k] == place - shift:
                    return sizes, k
            if m.end() > safe:
                return sizes, None
            sizes.append(m.end() - m.start())
        return sizes, None


Leaf = tuple[str, np.ndarray, np.ndarray]


def _cut(text: str, sizes: list[int]) -> Iterator[str]:
    at = 0
    for n in sizes:
        yield text[at : at + n]
        at += n


def _leaves(text: str, size: np.ndarray, tokens: np.ndarray) -> list[Leaf]:
    """Leaves of LEAF pre-tokens; up to twice as many stay together."""
    if 0 < len(size) <= 2 * LEAF:
        return [(text, size, tokens)]
    ends = np.concatenate([[0], np.cumsum(size)])
    return [(text[int(ends[a]) : int(ends[min(a + LEAF, len(size))])], size[a : a + LEAF], tokens[a : a + LEAF]) for a in range(0, len(size), LEAF)]


TREE = "array<struct<text:string,sizes:array<int>,tokens:array<int>>>"


def _rows(docs: DataFrame, columns: list[str], fields: str, tree_of) -> DataFrame:
    """``docs`` row by row: ``tree_of(row, counts)`` gives the numbers and the tree of one, or None for the tree."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", *(f.split()[0] for f in fields.split(", "))]
    types = {"long": pa.int64(), TREE: pa.list_(pa.struct([("text", pa.string()), ("sizes", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))]))}
    kinds = [types[f.split(" ", 1)[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [tree_of(*(c.as_py() for c in row)) for row in zip(*(batch.column(c) for c in columns), strict=True)]
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[] for _ in kinds], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=names)

    return docs.select("doc_id", *columns).mapInArrow(run, f"doc_id {kind}, {fields}")


def _applied(tree: TokenTree, edits: list[dict] | None) -> TokenTree:
    for e in edits or []:
        if e:
            tree.edit(e["pos"] or 0, e["removed"] or 0, e["added"] or "")
    return tree


def _column(tree: TokenTree) -> list[dict]:
    return [{"text": x, "sizes": s.tolist(), "tokens": t.tolist()} for x, s, t in tree.leaves]


def token_trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, tree) for each row of ``docs(doc_id, text, ...)``: the leaves of its tree, to be written and given to `edit_trees` as often as edits come.

    A null text counts as empty and has one empty leaf. Repeated rows each have a tree. Other columns
    are ignored. ``vocabulary`` is a rank file that every executor can open; without it the tasks fail
    with the path in the error.
    """

    def one(text: str | None) -> tuple:
        tree = TokenTree.of(text or "", _counts(vocabulary))
        return tree.tokens, _column(tree)

    return _rows(docs, ["text"], f"n_tokens long, tree {TREE}", one)


def edit_trees(trees: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, n_encoded, tree) for each row of ``trees(doc_id, tree, edits)``: the trees after the edits, of which only the pre-tokens that edits reach are encoded.

    Edits are as for `count_with_edits`. A null tree counts as that of an empty text. Repeated rows are
    edited each; other columns are ignored.
    """

    def one(tree: list[dict] | None, edits: list[dict] | None) -> tuple:
        leaves = [(v["text"], np.array(v["sizes"], np.int64), np.array(v["tokens"], np.int64)) for v in tree or []]
        new = _applied(TokenTree(leaves, _counts(vocabulary)), edits)
        return new.tokens, new.encoded, _column(new)

    return _rows(trees.withColumn("edits", F.col("edits").cast(f"array<{EDIT}>")), ["tree", "edits"], f"n_tokens long, n_encoded long, tree {TREE}", one)


def count_with_edits(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, n_pre_tokens, n_encoded) for each row of ``docs(doc_id, text, edits, ...)``.

    ``edits`` is an array of (pos, removed, added), applied in order to the whole text; positions are
    code points of the text as it then is. n_encoded counts the pre-tokens that edits made the tree
    encode again. ``vocabulary`` is a rank file that every executor can open; without it the tasks fail
    with the path in the error. A null text counts as empty, null edits as none, an edit's nulls as 0
    and an empty string; positions outside are moved to the nearest end. Rows are independent, repeated
    ones too; an empty table gives an empty one. Other columns are ignored.
    """

    def one(text: str | None, edits: list[dict] | None) -> tuple:
        tree = TokenTree.of(text or "", _counts(vocabulary))
        before, pieces = tree.tokens, sum(len(s) for _, s, _ in tree.leaves)
        _applied(tree, edits)
        return before, tree.tokens, pieces, tree.encoded

    return _rows(docs.withColumn("edits", F.col("edits").cast(f"array<{EDIT}>")), ["text", "edits"], "n_tokens long, n_tokens_edited long, n_pre_tokens long, n_encoded long", one)
