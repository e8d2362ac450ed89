"""Ranked lexical search by branch-and-bound over a document FP-tree.

Documents are reduced to the terms that the items ask for. Each task builds trees over
its documents: one root per length class (m within a factor of two), below it the terms
of a document in the order of their frequency, rarest first, so that documents share the
paths of their first terms. Rarest first rather than last: the terms that decide a score
are met at the top, and whatever an item's rare terms do not reach is given up there.

A node keeps the greatest tf of its term and the least m in its subtree. For an item, a
node's documents score at most what the terms on the path give with these, plus what the
item's more frequent terms could give with the class's greatest tf and least m. The search
goes depth-first, best bound first, and leaves out subtrees whose bound is below the tenth
best score so far. Scores of the documents reached are exact. A subtree of few documents is a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accesspanel.llm.common import materialize, ship_package, slices, utf8

#: Fixed values of the score.
K_TF, K_M, K_ONE = 1_000, 8, 1_000_000_000
SHARE_N, BASE_M = 75, 25
TOP = 10
#: Term occurrences of items searched in one pass over the documents.
ITEM_TERMS = 200_000
#: Entries (document, term) and documents of one tree.
TREE_ENTRIES = 3_000_000
TREE_DOCS = 100_000
PIECE_BYTES = 1 << 20
#: A node of at most so many documents has no children.
LEAF_DOCS = 32
#: Nodes taken from the stack at once: few at first, so that the bar is soon high.
FIRST_NODES, MOST_NODES = 32, 8_192


def _table() -> bytes:
    """Bytes of terms as they are, A-Z lower-cased; all others become blanks."""
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    out = bytearray(b" " * 256)
    for b in keep:
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    return bytes(out)


TABLE = _table()


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text a piece at a time, so that a long text needs no more memory."""
    start = 0
    while start < len(text):
        end = min(start + PIECE_BYTES, len(text))
        piece = text[start:end].translate(TABLE)
        while end < len(text) and not piece.endswith(b" "):
            blank = piece.rfind(b" ")
            if blank >= 0:
                piece, end = piece[: blank + 1], start + blank + 1
            else:  # a term longer than a piece
                end = min(end + PIECE_BYTES, len(text))
                piece = text[start:end].translate(TABLE)
        yield piece.split()
        start = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def m_of(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - SHARE_N + (SHARE_N * n * n_docs) // max(n_terms, 1)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (K_ONE * tf) // (K_TF * tf + K_M * m)


def restricted(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``n`` (terms, with repeats), and the numbers and counts of the terms that
    are in the vocabulary, of every row with a term."""
    size = max(len(vocabulary), 1)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys = [], []
        get = vocabulary.get
        for i, t in enumerate(utf8(batch.column("text"))):
            total = 0
            for piece in term_pieces(t):
                total += len(piece)
                found = np.array([k for k in map(get, piece) if k is not None], np.int64)
                if len(found):
                    keys.append(found + i * size)
            n.append(total)
        key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
        owner = key // size
        offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
        term = pa.ListArray.from_arrays(offsets, pa.array((key % size).astype(np.int32)))
        tf = pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int64)))
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), term, tf], ["doc_id", "n", "term", "tf"])
        return out.filter(pa.array(np.array(n) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield rows(part)

    given = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id bigint, n bigint, term array<int>, tf array<bigint>")


@dataclass
class Tree:
    """Nodes in level order; the children of a node and its own documents lie together."""

    term: np.ndarray
    top: np.ndarray  # greatest tf of the term in the subtree
    least_m: np.ndarray
    kind: np.ndarray  # length class
    child: np.ndarray  # children of node i: child[i] to child[i + 1]
    docs: np.ndarray  # documents ending at node i: docs[i] to docs[i + 1], in doc_order
    doc_order: np.ndarray
    roots: np.ndarray  # first nodes below the length classes
    top_tf: np.ndarray  # (class, term): greatest tf
    kind_m: np.ndarray  # least m of a class


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def build(start: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int) -> Tree:
    """Tree of documents with entries ``start[i]`` to ``start[i + 1]`` (ranks ascending: rarest
    first). A level is made at once: documents of one node and next term are a child."""
    size = np.diff(start)
    kinds, kind = np.unique(np.floor(np.log2(np.maximum(m, 1))).astype(np.int64), return_inverse=True)
    kind_m = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(kind_m, kind, m)
    top_tf = np.zeros((len(kinds), n_terms), np.int64)
    np.maximum.at(top_tf, (np.repeat(kind, size), rank), tf)
    docs = np.flatnonzero(size > 0)
    above = kind[docs]  # the group a document is in: its class, then its node
    terms_, tops, ms, kind_of, n_children, ends = [], [], [], [], [], []
    done_node, done_doc = [], []
    first, level = 0, 0
    while len(docs):
        key = above * n_terms + rank[start[docs] + level]
        name, node, n = np.unique(key, return_inverse=True, return_counts=True)
        top = np.zeros(len(name), np.int64)
        np.maximum.at(top, node, tf[start[docs] + level])
        low = np.full(len(name), np.iinfo(np.int64).max)
        np.minimum.at(low, node, m[docs])
        which = np.zeros(len(name), np.int64)
        which[node] = kind[docs]
        terms_.append(name % n_terms)
        tops.append(top)
        ms.append(low)
        kind_of.append(which)
        if level:
            n_children.append(np.bincount(name // n_terms - (first - len(terms_[-2])), minlength=len(terms_[-2])))
        ended = (n[node] <= LEAF_DOCS) | (size[docs] == level + 1)
        done_node.append(first + node[ended])
        done_doc.append(docs[ended])
        above, docs = first + node[~ended], docs[~ended]
        first += len(name)
        level += 1
    if terms_:
        n_children.append(np.zeros(len(terms_[-1]), np.int64))
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms_, tops, ms, kind_of, n_children, done_node, done_doc)]
    term, top, low, which, children, node, doc = flat
    n_roots = len(terms_[0]) if terms_ else 0
    order = np.argsort(node, kind="stable")
    ends = np.r_[0, np.cumsum(np.bincount(node, minlength=len(term)))].astype(np.int64)
    return Tree(
        term, top, low, which, np.r_[n_roots, n_roots + np.cumsum(children)].astype(np.int64), ends, doc[order],
        np.arange(n_roots), top_tf, kind_m,
    )


class Best:
    """The best documents of an item so far: highest score, then least id."""

    def __init__(self) -> None:
        self.score = np.zeros(0, np.int64)
        self.doc_id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.bar = 1

    def add(self, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        score, doc_id, null = np.r_[self.score, score], np.r_[self.doc_id, doc_id], np.r_[self.null, null]
        first = np.lexsort((doc_id, null, -score))[:TOP]
        self.score, self.doc_id, self.null = score[first], doc_id[first], null[first]
        if len(first) == TOP:
            self.bar = max(1, int(self.score[-1]))


def search(tree: Tree, start, rank, tf, m, doc_id, null, value: np.ndarray, best: Best) -> None:
    """Adds to ``best`` what the tree holds for an item; ``value`` is the weight of each term,
    repeats counted, 0 for those it does not have."""
    asked = np.flatnonzero(value)
    if not len(asked) or not len(tree.roots):
        return
    # what the terms from each rank on can give in a class
    most = np.zeros((len(tree.kind_m), len(asked) + 1), np.int64)
    possible = value[asked] * gain(tree.top_tf[:, asked], tree.kind_m[:, None])
    most[:, :-1] = np.cumsum(possible[:, ::-1], axis=1)[:, ::-1]

    def bounded(nodes: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that may hold a document above the bar, best first, what their paths give
        and their bounds."""
        term = tree.term[nodes]
        path = above + value[term] * gain(tree.top[nodes], tree.least_m[nodes])
        bound = path + most[tree.kind[nodes], np.searchsorted(asked, term, "right")]
        keep = np.flatnonzero(bound >= best.bar)
        keep = keep[np.argsort(-bound[keep], kind="stable")]
        return nodes[keep], path[keep], bound[keep]

    stack = [bounded(tree.roots, np.zeros(len(tree.roots), np.int64))]
    take = FIRST_NODES
    while stack:
        nodes, path, bound = stack.pop()
        if len(nodes) > take:
            stack.append((nodes[take:], path[take:], bound[take:]))
            nodes, path, bound = nodes[:take], path[:take], bound[:take]
        take = min(take * 2, MOST_NODES)
        good = bound >= best.bar
        nodes, path = nodes[good], path[good]
        if not len(nodes):
            if stack and stack[-1][2].size and stack[-1][2][0] < best.bar:
                stack.pop()
            continue
        n = tree.docs[nodes + 1] - tree.docs[nodes]
        if n.any():
            docs = tree.doc_order[np.repeat(tree.docs[nodes], n) + runs(n)]
            score = scores(start, rank, tf, m, docs, value)
            hit = score >= best.bar
            if hit.any():
                best.add(score[hit], doc_id[docs[hit]], null[docs[hit]])
        n = tree.child[nodes + 1] - tree.child[nodes]
        if n.any():
            found = bounded(np.repeat(tree.child[nodes], n) + runs(n), np.repeat(path, n))
            if len(found[0]):
                stack.append(found)


def scores(start, rank, tf, m, docs: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Exact scores of some documents (each has an entry)."""
    n = start[docs + 1] - start[docs]
    entry = np.repeat(start[docs], n) + runs(n)
    owner = np.repeat(np.arange(len(docs)), n)
    worth = value[rank[entry]]
    some = np.flatnonzero(worth)
    entry, owner, worth = entry[some], owner[some], worth[some]
    out = np.zeros(len(docs), np.int64)
    np.add.at(out, owner, worth * gain(tf[entry], m[docs[owner]]))
    return out


def _search_rows(n_docs: int, n_terms: int, rank_of: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray]], entries: int, most_docs: int):
    """Best documents of each item (term ranks and values) among the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best() for _ in asked]
        held: list[pa.RecordBatch] = []
        held_entries = held_docs = 0

        def settle() -> None:
            nonlocal held, held_entries, held_docs
            table = pa.Table.from_batches(held).combine_chunks()
            held, held_entries, held_docs = [], 0, 0
            lists = table.column("term").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            rank = rank_of[lists.flatten().to_numpy()]
            tf = table.column("tf").combine_chunks().flatten().to_numpy()
            start = np.r_[0, np.cumsum(size)].astype(np.int64)
            order = np.lexsort((rank, np.repeat(np.arange(len(size)), size)))
            rank, tf = rank[order], tf[order]
            m = m_of(table.column("n").to_numpy(), n_docs, n_terms)
            ids = table.column("doc_id").combine_chunks()
            null, doc_id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            tree = build(start, rank, tf, m, len(rank_of))
            value = np.zeros(len(rank_of), np.int64)
            for (terms_, worth), best in zip(asked, bests, strict=True):
                value[terms_] = worth
                search(tree, start, rank, tf, m, doc_id, null, value, best)
                value[terms_] = 0

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                held.append(part)
                held_entries += len(part.column("term").flatten())
                held_docs += part.num_rows
                if held_entries >= entries or held_docs >= most_docs:
                    settle()
        if held:
            settle()
        n = [len(b.score) for b in bests]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(bests)), n).astype(np.int32)),
                pa.array(np.concatenate([b.doc_id for b in bests]), pa.int64(), mask=np.concatenate([b.null for b in bests])),
                pa.array(np.concatenate([b.score for b in bests]), pa.int64()),
            ],
            ["item", "doc_id", "score"],
        )

    return run


def _item_blocks(items: DataFrame, item_id: str, text: str, block_terms: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their terms, in blocks of about ``block_terms`` occurrences; a block is what
    the driver holds. Rows of one id are one item with the terms of its distinct texts."""
    rows = (
        items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
        .where(F.col("text").isNotNull())
        .distinct()
    )
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (4 * block_terms)))
    for b in range(blocks):
        block: dict[int | None, list[bytes]] = {}
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else rows
        for r in part.orderBy("item_id", "text").collect():
            block.setdefault(r["item_id"], []).extend(terms(r["text"].encode()))
        found = [(i, t) for i, t in block.items() if t]
        if found:
            yield found


def search_documents(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_terms: int = ITEM_TERMS,
    tree_entries: int = TREE_ENTRIES,
    tree_docs: int = TREE_DOCS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ten best documents with a
    score above 0.

    A NULL or empty text has no terms. Rows of equal ``doc_id`` are documents of their own; a
    NULL ``doc_id`` comes after all others of its score. Rows of one ``item_id`` are one item
    with the terms of its distinct texts; an item without terms has no rows. No documents: no rows."""
    spark = docs.sparkSession
    ship_package(spark)
    out = None
    for block in _item_blocks(items, item_id, item_text, block_terms):
        names = sorted({t for _, found in block for t in found})
        vocabulary = {t: i for i, t in enumerate(names)}
        reduced = materialize(restricted(docs, vocabulary, doc_id, text), "restricted")
        n_docs, n_terms = reduced.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(names), np.int64)
        for r in reduced.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator():
            df[r["t"]] = r["n"]
        order = np.lexsort((np.arange(len(names)), df))
        rank_of = np.empty(len(names), np.int64)
        rank_of[order] = np.arange(len(names))
        asked = []
        for _, found in block:
            number, times = np.unique([vocabulary[t] for t in found], return_counts=True)
            worth = np.array([weight(n_docs, int(df[k])) if df[k] else 0 for k in number], np.int64) * times
            asked.append((rank_of[number], worth))
        best = reduced.where(F.size("term") > 0).mapInArrow(
            _search_rows(n_docs, n_terms, rank_of, asked, tree_entries, tree_docs), "item int, doc_id bigint, score bigint"
        )
        ids = F.array(*[F.lit(i).cast("bigint") for i, _ in block])
        named = best.select(F.get(ids, F.col("item")).alias("item_id"), "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    first = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= TOP)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: The same rows in SQL.
ORACLE_SQL = r"""
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, r, t, len(t) AS n FROM terms WHERE len(t) > 0),
total AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM docs),
counts AS (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, n, unnest(t) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, r, sum(times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS score
  FROM asked JOIN df USING (term) JOIN counts USING (term), total GROUP BY ALL)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score::BIGINT AS score FROM scored WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER o <= 10
"""
