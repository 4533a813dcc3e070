"""Ranked lexical search over sparse ball trees: exact top documents for a set of queries.

A document is the sparse vector of its terms' saturated frequencies, all 64-bit integers; a query holds integer weights of its
terms; a score is their inner product. Only terms of the queries are held, so a document's vector is bounded by the query set.

Statistics (documents, terms, documents per query term) are one aggregate over all documents. Then each task cuts its documents
into blocks and puts a block's vectors into a ball tree: a node is halved between two far vectors, and knows its centroid and
the largest distance from it. A query's inner product with any vector below a node is at most q.c + |q| r; that bound is
computed in doubles and widened by far more than they can be wrong. Nodes are visited best bound first and dropped with all
below them once the bound is under the query's tenth best score of the task so far; leaves are scored in exact integers. A
task keeps its best documents of each query from block to block and gives out only these, which one ranking then merges.

Queries are worked off in blocks of bounded size, each with a pass over the documents, so what is broadcast has a bound.

Defined cases: null or empty texts have no terms and are no documents of the collection; a query without terms, or whose terms
no document has, gives no rows; every row of the queries is a query of its own, repeated rows too; repeated document rows are
documents of their own; equal scores are ordered by document id, null last. An empty table gives no rows. Extra columns never
reach the operator.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.common import in_batches, key_and_text

TOP = 10
#: Vectors of a ball tree and of one of its leaves.
BLOCK = 2048
LEAF = 16
#: Queries, and distinct terms of queries, that share a pass (one query alone may have more terms).
QUERIES = 512
TERMS = 40_000
#: Share and amount by which bounds are widened; doubles are wrong by less than 1e-12 of what is added here.
WIDER, MORE = 1e-9, 1e-3

#: Bytes that part terms become spaces, A-Z lower case.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(BYTES).split()


@dataclass(frozen=True)
class Queries:
    """Queries of one pass: ids, and per query the numbers of its distinct terms among ``terms``."""

    ids: list
    members: list[np.ndarray]
    terms: list[bytes]


def query_blocks(queries: DataFrame, most: int = QUERIES, most_terms: int = TERMS) -> Iterator[Queries]:
    """The queries (item_id, text) in blocks of bounded size; only one block is held at a time."""
    ids, own, known = [], [], {}
    for row in queries.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        found = list(dict.fromkeys(terms_of(row["text"])))
        if ids and (len(ids) >= most or len(known) + len(found) > most_terms):
            yield Queries(ids, own, list(known))
            ids, own, known = [], [], {}
        ids.append(row["item_id"])
        own.append(np.array([known.setdefault(t, len(known)) for t in found], np.int64))
    if known:
        yield Queries(ids, own, list(known))


def statistics(documents: DataFrame, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """N (documents with a term), L (terms with repeats) and the documents per given term, over all documents."""
    places = {t: i for i, t in enumerate(terms)}
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(places) + 2, np.int64)
        for _, texts in in_batches(batches):
            found = []
            for text in texts:
                words = terms_of(text)
                counts[-1] += len(words)
                counts[-2] += bool(words)
                found += set(map(places.get, words)) - {None}
            counts[: len(places)] += np.bincount(np.array(found, np.int64), minlength=len(places))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], schema=schema)

    summed = key_and_text(documents).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(places) + 2, np.int64)
    for row in summed.collect():  # at most one row per query term
        counts[row["term"]] = row["n"]
    return int(counts[-2]), int(counts[-1]), counts[:-2]


class Tree:
    """A ball tree over sparse vectors: columns and values of each vector, one after the other."""

    def __init__(self, ids: list, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, n_terms: int, leaf: int = LEAF) -> None:
        self.n_terms, self.leaf = n_terms, leaf
        self.ids, self.starts, self.columns, self.values = ids, starts, columns, values
        self.norms = np.add.reduceat(values.astype(float) ** 2, starts[:-1])
        nodes: list[tuple[np.ndarray, float]] = []
        self.children: list[tuple[int, int] | None] = []
        self.leaf_of: list[int] = []
        todo = [np.arange(len(ids))]
        leaves: list[np.ndarray] = []
        while todo:
            rows = todo.pop()
            halves = self._halves(rows) if len(rows) > leaf else None
            nodes.append(self._ball(rows))
            # Children are numbered when they are taken from the stack; a leaf has its place among the leaves.
            self.children.append((-1, -1) if halves else None)
            self.leaf_of.append(-1 if halves else len(leaves))
            if halves:
                todo += halves
            else:
                leaves.append(rows)
        self._number()
        self.centroids = np.stack([c for c, _ in nodes])
        self.radii = np.array([r for _, r in nodes])
        self._by_leaf(leaves)

    def _by_leaf(self, leaves: list[np.ndarray]) -> None:
        """Puts the vectors into the order of the leaves, so that a leaf is one range of entries."""
        order = np.concatenate(leaves)
        places, begins = self._entries(order)
        self.columns, self.values = self.columns[places].astype(np.int32), self.values[places]
        self.ids = [self.ids[i] for i in order.tolist()]
        self.starts = np.append(begins, len(places))
        self.firsts = np.cumsum([0] + [len(rows) for rows in leaves])

    def _number(self) -> None:
        """Numbers of children: nodes are stored before those below them, the second child first."""
        open_: list[list[int]] = []
        for at in range(len(self.children)):
            if open_:
                open_[-1].append(at)
            if self.children[at] is not None:
                open_.append([at])
            while open_ and len(open_[-1]) == 3:
                parent, one, two = open_.pop()
                self.children[parent] = (one, two)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some vectors, and where each vector begins among them."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        begins = np.cumsum(sizes) - sizes
        return np.arange(int(sizes.sum())) + np.repeat(self.starts[rows] - begins, sizes), begins

    def _distances(self, rows: np.ndarray, centre: np.ndarray, square: float) -> np.ndarray:
        """Squared distances of vectors to a centre."""
        places, begins = self._entries(rows)
        dots = np.add.reduceat(self.values[places] * centre[self.columns[places]], begins)
        return self.norms[rows] - 2 * dots + square

    def _ball(self, rows: np.ndarray) -> tuple[np.ndarray, float]:
        places, _ = self._entries(rows)
        centre = np.bincount(self.columns[places], weights=self.values[places], minlength=self.n_terms) / len(rows)
        square = float(centre @ centre)
        far = float(self._distances(rows, centre, square).max())
        # The difference of large squares is where doubles lose most; widened by what they can lose.
        return centre, math.sqrt(max(far, 0.0) + WIDER * (float(self.norms[rows].max()) + square))

    def _vector(self, row: int) -> np.ndarray:
        own = slice(self.starts[row], self.starts[row + 1])
        return np.bincount(self.columns[own], weights=self.values[own], minlength=self.n_terms)

    def _halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two halves by nearness to two far vectors; equal vectors are halved as they stand."""
        first = self._vector(int(rows[0]))
        one = int(rows[np.argmax(self._distances(rows, first, float(first @ first)))])
        a = self._vector(one)
        from_a = self._distances(rows, a, float(a @ a))
        b = self._vector(int(rows[np.argmax(from_a)]))
        lean = from_a - self._distances(rows, b, float(b @ b))
        order = rows[np.argsort(lean, kind="stable")]
        return order[: len(order) // 2], order[len(order) // 2 :]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list, top: int, dense: np.ndarray) -> int:
        """Puts the tree's vectors among ``best``, a heap of (score, order of id, id), worst first; gives the leaves visited.

        ``dense`` has the query's weights at its terms, zeros elsewhere.
        """
        size = math.sqrt(float((weights.astype(float) ** 2).sum()))
        bounds = self.centroids[:, terms] @ weights.astype(float) + size * self.radii
        bounds = (bounds * (1 + WIDER) + MORE).tolist()
        queue = [(-bounds[0], 0)]
        visited, together = 0, 1
        while queue:
            # A vector with the score of the last one may still stand before it, by its id.
            least = best[0][0] if len(best) == top else 1
            leaves: list[int] = []
            while queue and len(leaves) < together and -queue[0][0] >= least:
                bound, at = heapq.heappop(queue)
                if self.children[at] is None:
                    leaves.append(self.leaf_of[at])
                else:
                    for child in self.children[at]:
                        heapq.heappush(queue, (max(bound, -bounds[child]), child))
            if not leaves:
                break
            visited += len(leaves)
            # Twice as many leaves at a time from round to round: few calls where bounds spare nothing, few leaves where they do.
            together *= 2
            self._score(leaves, best, top, dense)
        return visited

    def _score(self, leaves: list[int], best: list, top: int, dense: np.ndarray) -> None:
        """Exact scores of the vectors of some leaves, the best of them put among ``best``."""
        runs: list[list[int]] = []
        for i in sorted(leaves):
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        rows = [(int(self.firsts[a]), int(self.firsts[b])) for a, b in runs]
        parts = [slice(int(self.starts[a]), int(self.starts[b])) for a, b in rows]
        products = np.concatenate([dense[self.columns[p]] * self.values[p] for p in parts])
        sizes = np.concatenate([np.diff(self.starts[a : b + 1]) for a, b in rows])
        scores = np.add.reduceat(products, np.cumsum(sizes) - sizes)
        numbers = np.concatenate([np.arange(a, b) for a, b in rows])
        least = best[0][0] if len(best) == top else 1
        if len(scores) > top:
            least = max(least, int(np.partition(scores, -top)[-top]))
        for i in np.flatnonzero(scores >= max(least, 1)).tolist():
            own = self.ids[numbers[i]]
            entry = (int(scores[i]), (own is not None, -own if own is not None else 0), own)
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry[:2] > best[0][:2]:
                heapq.heapreplace(best, entry)


def vectors(texts: list[str], places: dict[bytes, int], n_documents: int, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Columns and saturated frequencies of each text, none for a text without a query term."""
    for text in texts:
        words = terms_of(text)
        found = Counter(map(places.get, words))
        found.pop(None, None)
        if not found:
            yield None
            continue
        m = 10 + (90 * len(words) * n_documents) // n_terms
        columns = np.fromiter(found.keys(), np.int64, len(found))
        tf = np.fromiter(found.values(), np.int64, len(found))
        order = np.argsort(columns)
        yield columns[order], ((1_000_000_000 * tf) // (1000 * tf + 8 * m))[order]


def term_weights(n_documents: int, frequencies: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)


def best_of_tasks(documents: DataFrame, queries: Queries, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(query, doc_id, score): the best documents of each task for each query of a block."""
    n_documents, n_terms, frequencies = statistics(documents, queries.terms)
    weights = term_weights(n_documents, frequencies) if n_documents else np.zeros(len(queries.terms), np.int64)
    places = {t: i for i, t in enumerate(queries.terms)}
    members = queries.members
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in members]
        dense = np.zeros(len(places), np.int64)

        def work(ids: list, held: list) -> None:
            starts = np.concatenate([[0], np.cumsum([len(c) for c, _ in held])])
            tree = Tree(ids, starts, np.concatenate([c for c, _ in held]), np.concatenate([v for _, v in held]), len(places))
            for own, heap in zip(members, best, strict=True):
                if len(own):
                    dense[own] = weights[own]
                    tree.search(own, weights[own], heap, top, dense)
                    dense[own] = 0

        ids, held = [], []
        for keys, texts in in_batches(batches):
            for key, vector in zip(keys, vectors(texts, places, n_documents, n_terms), strict=True):
                if vector is not None:
                    ids.append(key)
                    held.append(vector)
                if len(held) >= block:
                    work(ids, held)
                    ids, held = [], []
        if held:
            work(ids, held)
        rows = [(i, own, score) for i, heap in enumerate(best) for score, _, own in heap]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return key_and_text(documents).mapInArrow(run, "query int, doc_id long, score long")


def search(documents: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each query with a score above 0."""
    spark = documents.sparkSession
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in query_blocks(queries):
        ranked = best_of_tasks(documents, block, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), "query int, item_id long")  # at most QUERIES rows
        found = found.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return found
