"""Edit-aware token counts: a segment tree of pre-token runs per document; an edit re-encodes only the runs it touches."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from punctual.llm.packing import tokenizer_ids
from punctual.llm.tokens import SegmentIds
from punctual.llm.words import add_columns, sums

LEAF = 16  # segments in a leaf when a tree is built
TREE = StructType([StructField("chars", ArrayType(IntegerType())), StructField("tokens", ArrayType(IntegerType()))])
Edit = tuple[int, int, str]  # start and length in characters of the text before any edit, replacement


class Tree:
    """Characters and tokens of the leaves, and their sums up to the root, as a heap: node i has the children 2 * i and 2 * i + 1.

    Leaves meet where a blank follows something else than white space. No pre-token reaches over such a place whatever stands around
    it, so leaves are encoded by themselves and an edit within a leaf changes that leaf's tokens only.
    """

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens
        self.width = len(chars) // 2

    @classmethod
    def of_leaves(cls, chars: np.ndarray, tokens: np.ndarray) -> Tree:
        width = 1 << max(0, len(chars) - 1).bit_length()
        heap = np.zeros((2, 2 * width), np.int64)
        heap[0, width : width + len(chars)], heap[1, width : width + len(chars)] = chars, tokens
        while width > 1:
            heap[:, width // 2 : width] = heap[:, width : 2 * width].reshape(2, -1, 2).sum(axis=2)
            width //= 2
        return cls(heap[0].tolist(), heap[1].tolist())

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at `at` (the last one that holds any if there is none), and where that leaf begins."""
        node, begin = 1, 0
        at = min(at, self.chars[1] - 1)
        while node < self.width:
            node *= 2
            if at >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.width, begin

    def put(self, leaves: dict[int, tuple[int, int]]) -> None:
        """Replace leaves and sum up the paths above them."""
        level = set()
        for leaf, (chars, tokens) in leaves.items():
            self.chars[leaf + self.width], self.tokens[leaf + self.width] = chars, tokens
            level.add((leaf + self.width) // 2)
        while level - {0}:
            for node in level:
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            level = {node // 2 for node in level if node > 1}


def usable_edits(edits, length: int) -> list[Edit]:
    """In order of their start; those with a null, before the text, past its end or over an earlier one are left out."""
    out: list[Edit] = []
    reach = 0
    for start, size, new in sorted((e for e in edits or [] if e is not None and None not in e), key=lambda e: (e[0], e[1], e[2])):
        if start < reach or size < 0 or start + size > length or (out and start == out[-1][0]):
            continue
        out.append((start, size, new))
        reach = start + size
    return out


def apply_edits(tree: Tree, text: str, edits: list[Edit], count: Callable[[list[str]], list[int]]) -> tuple[str, int]:
    """The edited text; `tree` then holds its counts. Also how many tokens were encoded anew."""
    if not edits:
        return text, 0
    regions: list[list] = []  # first leaf, where it begins, last leaf, where that ends, edits
    for edit in edits:
        start, size, _ = edit
        first, begin = tree.find(start)
        if start == begin and first:  # the place where two leaves meet may change
            first, begin = tree.find(begin - 1)
        last, last_begin = tree.find(max(start, start + size - 1))
        end = last_begin + tree.chars[last + tree.width]
        if start + size >= end and end < tree.chars[1]:
            last, last_begin = tree.find(end)
            end = last_begin + tree.chars[last + tree.width]
        if regions and first <= regions[-1][2]:
            regions[-1][2:4] = [max(last, regions[-1][2]), max(end, regions[-1][3])]
            regions[-1][4].append(edit)
        else:
            regions.append([first, begin, last, end, [edit]])
    news = []
    for _, begin, _, end, some in regions:
        out, at = [], begin
        for start, size, new in some:
            out += [text[at:start], new]
            at = start + size
        news.append("".join(out) + text[at:end])
    tokens = count(news)
    leaves: dict[int, tuple[int, int]] = {}
    pieces, at = [], 0
    for (first, begin, last, end, _), new, n in zip(regions, news, tokens, strict=True):
        pieces += [text[at:begin], new]
        at = end
        leaves |= {leaf: (0, 0) for leaf in range(first + 1, last + 1)}
        leaves[first] = (len(new), n)
    tree.put(leaves)
    return "".join(pieces) + text[at:], sum(tokens)


def _trees(texts: list[str], coder: SegmentIds) -> list[Tree]:
    entry, count, parts = coder.entries(texts)
    size = coder.ids.size[entry]
    chars = np.fromiter((len(s) for p in parts for s in p), np.int64, len(entry)) + 1
    begin = np.cumsum(count) - count
    chars[begin] -= 1  # no blank stands before the first
    n_leaves = -(-count // LEAF)
    first = np.cumsum(n_leaves) - n_leaves
    leaf_begin = np.repeat(begin, n_leaves) + (np.arange(n_leaves.sum()) - np.repeat(first, n_leaves)) * LEAF
    by_leaf = [np.add.reduceat(x, leaf_begin) if len(x) else x for x in (chars, size.astype(np.int64))]
    return [Tree.of_leaves(by_leaf[0][a : a + n], by_leaf[1][a : a + n]) for a, n in zip(first.tolist(), n_leaves.tolist(), strict=True)]


def build_trees(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `tree` and n_tokens (by the `tokenizers` file at `path`, no special tokens). Null and empty texts have a tree of one empty leaf and no
    token. Keep the columns with the text to count again after edits without encoding the text anew."""

    def make():
        coder = tokenizer_ids(path)

        def compute(part: pa.RecordBatch) -> list[pa.Array]:
            trees = _trees([t or "" for t in part.column(text).to_pylist()], coder)
            pair = [pa.array([getattr(t, c) for t in trees], pa.list_(pa.int32())) for c in ("chars", "tokens")]
            return [pa.StructArray.from_arrays(pair, names=["chars", "tokens"]), pa.array([t.total for t in trees], pa.int64())]

        return compute

    return add_columns(docs, text, [StructField("tree", TREE), StructField("n_tokens", LongType())], make, keep)


def edit_trees(docs: DataFrame, path: str, edits: str | Callable[[str], list[Edit]], text: str = "text", tree: str = "tree", keep: list[str] | None = None) -> DataFrame:
    """Apply edits to texts with trees and replace both; add n_edits, n_tokens_after and n_encoded (tokens that were encoded anew).

    edits: a column of arrays of (start, length, replacement), all against the text as it is, or a function of the text that gives them. Edits with a null, out
    of the text, or over an earlier one are left out; a null text counts as empty, and so do null edits; a null tree is built first. Rows are handled one by one.
    """

    def make():
        coder = tokenizer_ids(path)

        def count(texts: list[str]) -> list[int]:
            entry, n, _ = coder.entries(texts)
            return sums(coder.ids.size[entry], np.concatenate([[0], np.cumsum(n)])).tolist()

        def compute(part: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in part.column(text).to_pylist()]
            given = map(edits, texts) if callable(edits) else ([tuple(e.values()) if e else None for e in row or []] for row in part.column(edits).to_pylist())
            out = []
            for value, some, kept in zip(texts, given, part.column(tree).to_pylist(), strict=True):
                t = Tree(kept["chars"], kept["tokens"]) if kept else _trees([value], coder)[0]
                usable = usable_edits(some, len(value))
                new, encoded = apply_edits(t, value, usable, count)
                out.append((t, new, len(usable), encoded))
            pair = [pa.array([getattr(x[0], c) for x in out], pa.list_(pa.int32())) for c in ("chars", "tokens")]
            after = pa.array([x[1] for x in out], pa.string())
            return [pa.StructArray.from_arrays(pair, names=["chars", "tokens"]), after, *(pa.array(x, pa.int64()) for x in ([x[2] for x in out], [x[0].total for x in out], [x[3] for x in out]))]

        return compute

    fields = [StructField(tree, TREE), StructField(text, StringType()), *(StructField(c, LongType()) for c in ("n_edits", "n_tokens_after", "n_encoded"))]
    return add_columns(docs, text, fields, make, keep, also=[tree, *([] if callable(edits) else [edits])])


#: Mail addresses and long numbers, and what takes their place.
PERSONAL = re.compile(r"(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<number>\+?\d[\d ()-]{6,}\d)")


def redactions(text: str) -> list[Edit]:
    """Edits that hide personal data."""
    return [(m.start(), m.end() - m.start(), "<MAIL>" if m.lastgroup == "mail" else "<NUMBER>") for m in PERSONAL.finditer(text)]
