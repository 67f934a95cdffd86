"""Token counts that follow edits: a segment tree over the pre-tokens of a document; an edit re-encodes only the pre-tokens that it can change.

The pre-tokenizer's pattern reads from left to right without looking back, so two readings that ever stand at a boundary at the same text stay together.
After an edit, reading starts at the last boundary that the edit cannot have moved (the pattern looks at most one character beyond a pre-token, and at
three characters from its start for contractions) and stops at the first old boundary behind the edit. Leaves outside keep their counts; the places of
boundaries follow from the tree's sums, so an edit costs what it reads again and one way down the tree for each boundary that it asks for. A document's
tree can be kept as a column, inner sums and all; the next edits start from it and make only the nodes that they come through.
"""

from __future__ import annotations

import os
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_bytes, lean, pack, unpack

#: Characters from a pre-token's start that the contractions of the pattern look at.
LOOKAHEAD = 3
#: Leaves of a node at the bottom and nodes of any other, as they are made; edits leave up to twice as many.
FAN = 64


class Counter:
    """Token counts of pre-tokens under a byte-level BPE vocabulary; counts are kept for at most `most` pre-tokens, then forgotten together."""

    def __init__(self, vocab_path: str, pattern: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.pattern, self.most = Tokenizer.from_file(vocab_path), regex.compile(pattern), most
        self.tok.encode_special_tokens = True
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        if len(self.known) > self.most:
            self.known.clear()
        new = list(set(words).difference(self.known))
        if new:
            self.known.update((w, len(e.ids)) for w, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True))
        return list(map(self.known.__getitem__, words))


class Kept:
    """A stored tree: sums of its nodes, level by level from the root, where the kids of each begin (at the bottom: its leaves), and the leaves."""

    def __init__(self, block: bytes):
        self.lens, self.counts, self.first, self.n, self.chars, self.tokens, bottom = unpack(block, "<u4", "<u4", "<u4", "<u4", "<u8", "<u8", "<u4")
        self.bottom = int(bottom[0])

    def span(self, i: int) -> tuple[int, int]:
        """First and last (not included) kid of node i, or leaf of a node at the bottom: kids of neighbours follow one another."""
        ends = {self.bottom: len(self.first), len(self.first): len(self.lens)}
        return int(self.first[i]), ends[i + 1] if i + 1 in ends else int(self.first[i + 1])

    def node(self, i: int) -> Node:
        out = Node.__new__(Node)
        out.kept, out.place = self, i
        out.n, out.chars, out.tokens = int(self.n[i]), int(self.chars[i]), int(self.tokens[i])
        return out

    def open(self, node: Node) -> None:
        first, last = self.span(node.place)
        inner = node.place < self.bottom
        node.kept = None
        node._kids = [self.node(k) for k in range(first, last)] if inner else None
        node._lens, node._counts = ([], []) if inner else (self.lens[first:last].tolist(), self.counts[first:last].tolist())


class Node:
    """Leaves, characters and tokens of a stretch of pre-tokens; below it are nodes (kids) or, at the bottom, the leaves' lengths and counts.

    What is below a node of a stored tree is made when it is first asked for.
    """

    __slots__ = ("n", "chars", "tokens", "_kids", "_lens", "_counts", "kept", "place")

    def __init__(self, kids: list[Node] | None, lens: list[int] = (), counts: list[int] = ()):
        self.kept, self._kids, self._lens, self._counts = None, kids, lens, counts
        self.sum()

    def opened(self) -> Node:
        if self.kept is not None:
            self.kept.open(self)
        return self

    @property
    def size(self) -> int:
        """Number of kids, or of leaves at the bottom."""
        if self.kept is not None:
            first, last = self.kept.span(self.place)
            return last - first
        return len(self._lens if self._kids is None else self._kids)

    @property
    def kids(self) -> list[Node] | None:
        return self.opened()._kids

    @kids.setter
    def kids(self, kids: list[Node]) -> None:
        self._kids = kids

    @property
    def lens(self) -> list[int]:
        return self.opened()._lens

    @property
    def counts(self) -> list[int]:
        return self.opened()._counts

    def sum(self) -> None:
        if self.kids is None:
            self.n, self.chars, self.tokens = len(self.lens), sum(self.lens), sum(self.counts)
        else:
            self.n, self.chars, self.tokens = (sum(getattr(k, x) for k in self.kids) for x in ("n", "chars", "tokens"))

    def replace(self, first: int, last: int, lens: list[int], counts: list[int]) -> list[Node]:
        """Leaves first to last (not included) become others; the nodes that then stand in this one's place, which all have its height."""
        if self.kids is None:
            self.lens[first:last], self.counts[first:last] = lens, counts
            if len(self.lens) <= 2 * FAN:
                self.sum()
                return [self] if self.lens else []
            return blocks(self.lens, self.counts)
        out, at, waiting = [], 0, bool(lens)
        for k, kid in enumerate(self.kids):
            end = at + kid.n
            takes = waiting and (first < end or k == len(self.kids) - 1)
            if takes or max(first, at) < min(last, end):
                a = min(max(first, at), end) - at
                out += kid.replace(a, max(a, min(last, end) - at), *((lens, counts) if takes else ([], [])))
                waiting = waiting and not takes
            else:
                out.append(kid)
            at = end
        self.kids = _joined(out)
        if len(self.kids) <= 2 * FAN:
            self.sum()
            return [self] if self.kids else []
        return [Node(self.kids[a : a + FAN]) for a in range(0, len(self.kids), FAN)]


def blocks(lens: list[int], counts: list[int]) -> list[Node]:
    return [Node(None, lens[a : a + FAN], counts[a : a + FAN]) for a in range(0, len(lens), FAN)]


def _joined(nodes: list[Node]) -> list[Node]:
    """Neighbours that are small are joined, so that edits leave no chains of nodes with a leaf or two."""
    out: list[Node] = []
    for x in nodes:
        if out and out[-1].size + x.size <= FAN // 2:
            y = out[-1]
            if x.kids is None:
                out[-1] = Node(None, [*y.lens, *x.lens], [*y.counts, *x.counts])
            else:
                out[-1] = Node([*y.kids, *x.kids])
        else:
            out.append(x)
    return out


class Tree:
    """A balanced segment tree over pre-tokens: every node has the sums of its stretch, and an edit renews the nodes above the leaves that it touches."""

    def __init__(self, root: Node):
        self.root = root

    @classmethod
    def of(cls, lens: list[int], counts: list[int]) -> Tree:
        return cls(cls._top(blocks(lens, counts)))

    @staticmethod
    def _top(nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            nodes = [Node(nodes[a : a + FAN]) for a in range(0, len(nodes), FAN)]
        root = nodes[0] if nodes else Node(None, [], [])
        while root.kids is not None and len(root.kids) == 1:
            root = root.kids[0]
        return root

    def replace(self, first: int, last: int, lens: list[int], counts: list[int]) -> None:
        self.root = self._top(self.root.replace(first, last, lens, counts) or [])

    def start(self, leaf: int) -> int:
        """Where a leaf starts; the end of the text for the number of leaves."""
        node, at = self.root, 0
        if leaf >= node.n:
            return node.chars
        while node.kids is not None:
            for kid in node.kids:
                if leaf < kid.n:
                    node = kid
                    break
                leaf, at = leaf - kid.n, at + kid.chars
        return at + sum(node.lens[:leaf])

    def at(self, place: int) -> tuple[int, int]:
        """The leaf that the character at a place is in, and where the leaf starts; the number of leaves and the end of the text beyond it."""
        node, leaf, start = self.root, 0, 0
        if place >= node.chars:
            return node.n, node.chars
        while node.kids is not None:
            for kid in node.kids:
                if place < start + kid.chars:
                    node = kid
                    break
                leaf, start = leaf + kid.n, start + kid.chars
        for n in node.lens:
            if place < start + n:
                break
            leaf, start = leaf + 1, start + n
        return leaf, start

    def leaves(self) -> tuple[list[int], list[int]]:
        """Lengths and counts in order."""
        lens, counts, todo = [], [], [self.root]
        while todo:
            node = todo.pop()
            if node.kids is None:
                lens += node.lens
                counts += node.counts
            else:
                todo += reversed(node.kids)
        return lens, counts

    def stored(self) -> bytes:
        """The tree as one block, for Kept: all sums are written, so that none is made again when it is read."""
        levels = [[self.root]]
        while levels[-1][0].kids is not None:
            levels.append([kid for node in levels[-1] for kid in node.kids])
        nodes = [node for level in levels for node in level]
        bottom = len(nodes) - len(levels[-1])
        below = [x.size for x in nodes]
        first = [*accumulate(below[:bottom], initial=1)][:-1] + [*accumulate(below[bottom:], initial=0)][:-1]
        sums = [np.array([getattr(x, name) for x in nodes], kind) for name, kind in (("n", "<u4"), ("chars", "<u8"), ("tokens", "<u8"))]
        return pack(*(np.array(x, "<u4") for x in (*self.leaves(), first)), *sums, np.array([bottom], "<u4"))


class Document:
    """A text with the tree of its pre-tokens' lengths and token counts, read anew or from a stored tree of this text."""

    def __init__(self, text: str, counter: Counter, stored: bytes | None = None):
        self.text, self.counter = text, counter
        if stored is not None:
            self.tree = Tree(Kept(stored).node(0))
            if self.tree.root.chars != len(text):
                raise ValueError("the stored tree is of another text")
        else:
            words = counter.pattern.findall(text)
            self.tree = Tree.of(list(map(len, words)), counter.counts(words))

    @property
    def tokens(self) -> int:
        return self.tree.root.tokens

    @property
    def pretokens(self) -> int:
        return self.tree.root.n

    @property
    def starts(self) -> list[int]:
        """Where each pre-token starts, and the end of the text."""
        return list(accumulate(self.tree.leaves()[0], initial=0))

    def stored(self) -> bytes:
        return self.tree.stored()

    def edit(self, start: int, end: int, new: str) -> int:
        """Characters start to end (not included) become `new`; returns how many pre-tokens were read again."""
        tree, by = self.tree, len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        n = tree.root.n
        first, at = tree.at(max(start - 1, 0))
        if first == n and n:
            first, at = n - 1, tree.start(n - 1)
        while first > 0 and (at + LOOKAHEAD >= start or tree.start(first + 1) >= start):
            first, at = first - 1, tree.start(first - 1)
        words, last = [], n
        for m in self.counter.pattern.finditer(text, at):
            if m.start() >= start + len(new) and m.start() - by >= end:
                leaf, begins = tree.at(m.start() - by)
                if begins == m.start() - by and leaf < n:
                    last = leaf
                    break
            words.append(m.group())
        self.text = text
        tree.replace(first, last, list(map(len, words)), self.counter.counts(words))
        return len(words)


_counters: dict[tuple[str, str], Counter] = {}


def counter(vocab_path: str, pattern: str) -> Counter:
    """One for each vocabulary and Python worker."""
    if (vocab_path, pattern) not in _counters:
        _counters[vocab_path, pattern] = Counter(vocab_path, pattern)
    return _counters[vocab_path, pattern]


def count_tokens(docs: DataFrame, vocab_path: str, pattern: str, edits_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", tree_col: str | None = None, keep: bool = False) -> DataFrame:
    """Token counts of every document before and after its edits.

    edits_col (none: no edits): array of struct(start, end, new), code points of the text as the edits before have left it; null bounds are 0, bounds beyond the text are
    its end, an end before its start is the start, a null `new` is empty. pattern: the vocabulary's pre-tokenizer. Returns id_col, n_pretokens, n_tokens,
    n_edited_pretokens, n_edited_tokens, n_reencoded (pre-tokens read again by the edits); with keep also edited_text and tree, its tree with all sums, to be
    given as tree_col with that text in a later call: then only what the edits touch is encoded. One row for each row of docs; other columns are ignored.

    Defined results: a null or empty text has no tokens; null edits are none; a null id stays null; a null tree is made anew, one of another text is an
    error; repeated rows count alike; an empty table gives an empty result.
    """
    arrow_bytes(docs.sparkSession, 4 << 20)
    names = ["n_pretokens", "n_tokens", "n_edited_pretokens", "n_edited_tokens", "n_reencoded"]

    def run(batches):
        own = counter(vocab_path, pattern)
        for b in batches:
            out, kept = [], []
            for text, edits, tree in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                d = Document(text, own, tree)
                before = [d.pretokens, d.tokens]
                again = 0
                for e in edits or ():
                    if e is None:
                        continue
                    start = min(max(0, e["start"] or 0), len(d.text))
                    again += d.edit(start, min(max(start, e["end"] or 0), len(d.text)), e["new"] or "")
                out.append((*before, d.pretokens, d.tokens, again))
                if keep:
                    kept.append((d.text, d.stored()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            more = [pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.binary())] if keep else []
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols), *more], ["id", *names, *(["edited_text", "tree"] if keep else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    edits = F.transform(edits_col or F.array().cast("array<struct<start:bigint,end:bigint,new:string>>"), lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["new"].cast("string").alias("new")))
    tree = F.col(tree_col) if tree_col else F.lit(None)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), edits.alias("edits"), tree.cast("binary").alias("tree"))
    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in names) + ", edited_text string, tree binary" * keep
    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
