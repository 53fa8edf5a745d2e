"""Benchmark decontamination by latent semantic retrieval.

* Terms are white-space words in lower case, letters and digits only. Words of the benchmark have numbers of their own, all
  others share HASHED numbers. Passages are 2 * BLOCK words, one at every BLOCK words, of every whole text.
* One pass writes the numbers of all texts' terms, and all others read those. One counts in how many passages of the corpus
  each term occurs, over all documents: the IDF. Terms in more than MAX_DF of the passages carry no weight in the latent space (items that live by such terms are found by all their words, see below).
* A randomised SVD (random projection, POWER power iterations, each a distributed pass of A^T (A Q), and a last pass of (A Q)^T (A Q), which turns Q) of TF-IDF
  passages gives the latent dimensions: as many as there are items, RANK at least and MOST_RANK at most. It is fitted on all benchmark items and on
  every passage of the corpus. An item weighs ITEM_WEIGHT, and the passages the same each, CORPUS_WEIGHT all together (squared; 1 each at most), so
  that the dimensions go to the items however large the corpus is. A task's sums are a number for each term and dimension, of single precision and held once;
  after ADDED additions they are sent on. Q goes to the tasks, and the sums come back, as files of the shared folder, a part at a time: they don't pass through
  the driver's JVM, and are deleted when a pass ends. The search's tasks read the vectors from such a file too, which stays.
* Every passage that can hold a leak is projected: a leak has at least half of an item's words, so it has FLAGGED of the rarest words that
  make up somewhat over half of the item. Passages that haven't as many within two blocks can't be one, and are skipped.
* A passage is a candidate for each item with cosine and coverage (p.q / q.q) above thresholds; there is no top-k. The benchmark is
  the stated query set: it is visited in blocks of ITEMS_AT_ONCE, and only a block's vectors and words are broadcast, whose size doesn't depend on the corpus.
* An item of whose squared TF-IDF norm the dimensions keep less than KEPT, and one longer than a passage, which
  no passage can cover, have a second way to the same check: every window, by an exact count of its words with weight, that has as many as a leak needs.
* A candidate is checked on the words around it: the longest common subsequence of words that carry weight, as a share of the item's.
  COPY of it is a leak; from PARAPHRASE on it is one if the item's answer is there too: at least ANSWER of the words with weight
  in its last third. Items with fewer than FEW such words are compared by all words, and only as copies.
* Copies of a benchmark passage make its own words common. An item whose words with weight hold less than HELD of its IDF is looked for
  by all its words besides: each stretch of 1 + SPREAD times its length that has enough of them (an exact count over postings, no
  latent space) is compared by the common subsequence weighted by IDF, COMMON at least for each word, with the same limits. Below SHORT
  words, where common words alone come near, only COPY of the words within 1 + 1 / 4 of its length counts, and below FEW only the item itself.

A null or empty text has no passage. Null or repeated doc_ids are rows like any other. An empty corpus or benchmark gives an empty result.
Columns other than doc_id and text, item_id and text, are not read. drop_leaks drops rows by their text, so a clean row stays even if
another row of its doc_id goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import column_hashes, give_back, in_arrow, keep_keys, key_of, new_path, slices, staged

BLOCK = 32
HASHED = 1 << 15
MAX_DF = 0.02
RANK = 64
MOST_RANK = 256
EXTRA = 16
POWER = 2
CORPUS_WEIGHT = 400
ITEM_WEIGHT = 4.0
COSINE = 0.25
COVERAGE = 0.3
COPY = 0.8
PARAPHRASE = 0.5
ANSWER = 0.5
FEW = 4
KEPT = 0.5
HELD = 0.7
SPREAD = 0.5
COMMON = 0.05
SHORT = 16
#: Flagged words that a passage and the two blocks on either side of it must have to be projected.
FLAGGED = 3
#: Passages that a fit's task multiplies at once, and terms in a part of its sums.
FITTED = 16_384
PART = 256
#: Times that a task adds to its sums, of single precision, before it sends them on and begins anew: rounding doesn't grow with the corpus.
ADDED = 1 << 10
#: Parts that a batch holds, and rows of a matrix that the driver works on at once.
PARTS_AT_ONCE = 16
ROWS_AT_ONCE = 4096
#: Bytes of vectors that are added up at once: they stay in a core's cache. Longer runs than LONG are added up one by one.
ADDED_AT_ONCE = 1 << 19
LONG = 64
#: Spark deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of words that are searched at once; several arrays hold 8 bytes for each word, or a vector for each block.
SEARCHED = 1 << 20
#: Windows times items that are counted at once.
COUNTED = 1 << 17
#: Benchmark items searched in one pass, and compared at once.
ITEMS_AT_ONCE = 20_000
ITEMS_COMPARED = 4096


_ODD = re.compile(r"[^\x00-\x7f\w]").sub
_TABLE = bytes(32 if 28 <= k < 32 else k for k in range(256))
_DELETE = bytes(k for k in range(128) if not chr(k).isalnum() and not chr(k).isspace())


def clean(text: str | None) -> bytes:
    """A text's terms, between white space."""
    low = (text or "").casefold()
    if not low.isascii():
        low = _ODD(lambda m: " " if m[0].isspace() else "", low)
    return low.encode().translate(_TABLE, _DELETE)


class Terms:
    """Numbers of terms: own ones of the benchmark's, HASHED for all others."""

    def __init__(self, own: list[bytes]):
        h = column_hashes(pa.array(own, pa.binary()))[0]
        self.number, self.count = np.argsort(h), len(own)
        self.sorted = h[self.number]
        self.some = np.zeros(1 << 16, bool)
        self.some[h >> np.uint64(48)] = True

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, one text after the other, and where each text's begin (with the end of all)."""
        h, first = column_hashes(pa.array(list(map(clean, texts)), pa.large_binary()))
        out = (self.count + h % np.uint64(HASHED)).astype(np.int32)
        if self.count:
            maybe = np.flatnonzero(self.some[h >> np.uint64(48)])
            at = np.minimum(np.searchsorted(self.sorted, h[maybe]), self.count - 1)
            hit = self.sorted[at] == h[maybe]
            out[maybe[hit]] = self.number[at[hit]]
        return out, first


def numbered(terms: Terms, carried: list[str]):
    """(text, carried ...) -> (words, carried ...): the numbers of each text's terms, 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            t, first = terms.of(b.column(0).to_pylist())
            words = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((4 * first).astype(np.int32)), pa.py_buffer(t)])
            yield pa.record_batch([words, *b.columns[1:]], ["words", *carried])

    return run


def numbers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What Terms.of gave, from a column of numbered()."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.int32, count=(at[-1] - at[0]) // 4, offset=at[0]), (at - at[0]) // 4


def passages(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The terms of each text's passages that don't overlap, a sorted row each, with -1 where a passage is shorter."""
    rows = -(-np.diff(first) // (2 * BLOCK))
    shift = (np.cumsum(rows) - rows) * 2 * BLOCK - first[:-1]
    grid = np.full(int(rows.sum()) * 2 * BLOCK, -1, np.int32)
    grid[np.arange(len(t)) + np.repeat(shift, np.diff(first))] = t
    return np.sort(grid.reshape(-1, 2 * BLOCK), axis=1)


def counter(columns: int):
    """(words) -> (term, passages with it) of a task, and (-1, passages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(columns, np.int64)
        for b in slices(batches, "words"):
            grid = passages(*numbers(b.column(0)))
            grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = -1
            df += np.bincount(grid.ravel() + 1, minlength=len(df) + 1)[1:]
            total += len(grid)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([[-1], some]).astype(np.int64)), pa.array(np.concatenate([[total], df[some]]).astype(np.int64))], ["term", "n"])

    return run


def some_sums(vectors: np.ndarray, index: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sum of vectors[index[k : k + m]] for each k of first and m of n, 1 at least: (places in n, their sums), some at once, valid until the next. The j-th
    vectors of all runs are added up together, the longest runs first, as numpy's reduceat takes ten times as long for rows.
    """
    step = max(1, ADDED_AT_ONCE // (vectors.itemsize * max(1, vectors.shape[1])))
    order = np.argsort(-n, kind="stable")
    long = int(np.count_nonzero(n > LONG))
    for k in range(long):
        lo, hi = first[order[k]], first[order[k]] + n[order[k]]
        yield order[k : k + 1], sum(vectors[index[at : min(at + step, hi)]].sum(axis=0) for at in range(lo, hi, step))[None]
    total, more = np.empty((2, min(step, len(n) - long), vectors.shape[1]), vectors.dtype)
    for k in range(long, len(n), step):
        rows = order[k : k + step]
        at, size = first[rows], n[rows]
        np.take(vectors, index[at], axis=0, out=total[: len(rows)], mode="clip")
        for j, upto in enumerate(np.searchsorted(-size, -np.arange(1, size[0])).tolist(), 1):
            np.take(vectors, index[at[:upto] + j], axis=0, out=more[:upto], mode="clip")
            total[:upto] += more[:upto]
        yield rows, total[: len(rows)]


def sums_of(vectors: np.ndarray, index: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of some_sums()."""
    out = np.empty((len(n), vectors.shape[1]), vectors.dtype)
    for rows, total in some_sums(vectors, index, first, n):
        out[rows] = total
    return out


def projected(t: np.ndarray, n: np.ndarray, weight: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of turned over rows given by n terms each that carry weight, sorted; each row's squared norm, and the row of each term. turned is q times the weights."""
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    once = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (row[1:] != row[:-1])]))
    square = np.bincount(row[once], (np.diff(np.append(once, len(t))) * weight[t[once]]) ** 2, len(n)).astype(np.float32)
    return sums_of(turned, t, np.cumsum(n) - n, n), square, row


def add_squares(t: np.ndarray, n: np.ndarray, weight: np.ndarray, turned: np.ndarray, sums: np.ndarray) -> None:
    """Adds A^T (A q), but for the weight of its rows' terms, to sums. A's rows have norm 1; they are given as to projected()."""
    n = n[n > 0]
    if not len(n):
        return
    p, square, row = projected(t, n, weight, turned)
    p /= square[:, None]
    order = np.argsort(t.astype(np.uint16) if len(weight) <= 1 << 16 else t, kind="stable")  # numpy sorts 16 bits by radix
    term = t[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    terms = term[first]
    for rows, total in some_sums(p, row[order], first, np.diff(np.append(first, len(term)))):
        sums[terms[rows]] += total  # a copy of all these terms' sums would be as large as the sums


def add_inner(t: np.ndarray, n: np.ndarray, weight: np.ndarray, turned: np.ndarray, sums: np.ndarray) -> None:
    """Adds (A q)^T (A q) to sums."""
    n = n[n > 0]
    if not len(n):
        return
    p, square, _ = projected(t, n, weight, turned)
    p /= np.sqrt(square)[:, None]
    sums += p.T @ p


def write_matrix(at: str, blocks: Iterator[np.ndarray]) -> None:
    files, path = pafs.FileSystem.from_uri(at)
    with files.open_output_stream(path) as f:
        for rows in blocks:
            f.write(rows.astype(np.float32).tobytes())


def read_matrix(at: str, columns: int) -> np.ndarray:
    """The matrix in the file at. A machine's tasks share the pages of a local file."""
    files, path = pafs.FileSystem.from_uri(at)
    if isinstance(files, pafs.LocalFileSystem):
        files = pafs.LocalFileSystem(use_mmap=True)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), np.float32).reshape(-1, columns)


def gram(at: str, columns: int, weight: np.ndarray, inner: bool = False):
    """(words) -> A^T (A q), or (A q)^T (A q), of a task's passages, by part of rows. The file at holds q times the weights."""

    def sent(sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(sums), PART * PARTS_AT_ONCE):
            parts = range(lo, min(lo + PART * PARTS_AT_ONCE, len(sums)), PART)
            blocks = [sums[k : k + PART] if inner else sums[k : k + PART] * weight[k : k + PART, None] for k in parts]
            yield pa.record_batch([pa.array(list(parts), pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in blocks], pa.binary())], ["part", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = read_matrix(at, columns)
        sums = np.zeros((columns, columns)) if inner else np.zeros((len(weight), columns), np.float32)
        some, added = np.append(weight > 0, False), 0  # -1 is the last
        for b in slices(batches, "words"):
            grid = passages(*numbers(b.column(0)))
            for k in range(0, len(grid), FITTED):
                rows = grid[k : k + FITTED]
                heavy = some[rows]
                (add_inner if inner else add_squares)(rows[heavy], heavy.sum(axis=1), weight, turned, sums)
                added += 1
                if added % ADDED == 0:
                    yield from sent(sums)
                    sums[:] = 0
        yield from sent(sums)

    return run


def add_up(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("sums"))
    return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


class Fit:
    """The matrix of the fit: a row for every passage of the corpus (staged words) and for each item."""

    def __init__(self, corpus: DataFrame, total: int, items: list[np.ndarray], weight: np.ndarray):
        spark = corpus.sparkSession
        self.corpus = corpus.select("words").coalesce(max(1, spark.sparkContext.defaultParallelism))  # a task's sums are of one size, so no more tasks than cores
        self.share, self.weight = min(1.0, CORPUS_WEIGHT / total), weight
        kept = [np.sort(w[weight[w] > 0]) for w in items]
        self.items, self.sizes = np.concatenate(kept), np.array([len(w) for w in kept])

    def squared(self, q: np.ndarray) -> np.ndarray:
        """A^T (A q), by one distributed job."""
        turned, sums = q[: int(self.items.max()) + 1] * self.weight[: int(self.items.max()) + 1, None], np.zeros((int(self.items.max()) + 1, q.shape[1]))
        add_squares(self.items, self.sizes, self.weight, turned, sums)
        out = np.zeros_like(q)
        out[: len(sums)] = ITEM_WEIGHT**2 * self.weight[: len(sums), None] * sums
        return self.gathered(q, False, out)

    def inner(self, q: np.ndarray) -> np.ndarray:
        """(A q)^T (A q), by one distributed job."""
        turned, out = q[: int(self.items.max()) + 1] * self.weight[: int(self.items.max()) + 1, None], np.zeros((q.shape[1], q.shape[1]))
        add_inner(self.items, self.sizes, self.weight, turned, out)
        out *= ITEM_WEIGHT**2
        return self.gathered(q, True, out)

    def gathered(self, q: np.ndarray, inner: bool, out: np.ndarray) -> np.ndarray:
        """out with the passages' share of it added. What it writes and shuffles, some bytes for each term, dimension and core, is deleted when it ends."""
        spark = self.corpus.sparkSession
        sent, got = new_path(spark, "fit"), new_path(spark, "sums")
        (files, path), (_, folder) = pafs.FileSystem.from_uri(sent), pafs.FileSystem.from_uri(got)
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            write_matrix(sent, (q[k : k + ROWS_AT_ONCE] * self.weight[k : k + ROWS_AT_ONCE, None] for k in range(0, len(q), ROWS_AT_ONCE)))
            parts = in_arrow(self.corpus, gram(sent, q.shape[1], self.weight, inner), "part bigint, sums binary").groupBy("part").applyInArrow(add_up, "part bigint, sums binary")
            parts.write.option("compression", "none").parquet(got)
            for info in files.get_file_info(pafs.FileSelector(folder)):
                if info.path.endswith(".parquet"):
                    with files.open_input_file(info.path) as f:
                        for b in pq.ParquetFile(f).iter_batches(PARTS_AT_ONCE):
                            for part, sums in zip(b.column("part").to_pylist(), b.column("sums")):
                                out[part : part + PART] += self.share * np.frombuffer(sums.as_buffer(), np.float32).reshape(-1, q.shape[1])
        finally:
            spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
            for info in files.get_file_info([path, folder]):
                if info.type == pafs.FileType.Directory:
                    files.delete_dir(info.path)
                elif info.type == pafs.FileType.File:
                    files.delete_file(info.path)
            give_back()
        return out


def orthonormal(q: np.ndarray) -> np.ndarray:
    """q, overwritten by the Q of its QR decomposition. Blocks of rows are decomposed, and then what is left of all of them: numpy's takes several copies in double precision."""
    step, left = max(ROWS_AT_ONCE, q.shape[1]), []
    for k in range(0, len(q), step):
        a, r = np.linalg.qr(q[k : k + step])
        q[k : k + step, : len(r)] = a
        left.append(r)
    turn, at = np.linalg.qr(np.concatenate(left))[0], 0
    for k, r in zip(range(0, len(q), step), left):
        q[k : k + step] = q[k : k + step, : len(r)] @ turn[at : at + len(r)]
        at += len(r)
    return q


def randomised_svd(rows: Fit, columns: int, rank: int) -> np.ndarray:
    """Leading right singular vectors (columns x rank) of the rows. Each pass is one distributed job."""
    random = np.random.default_rng(3)
    q = np.empty((columns, min(rank + EXTRA, columns)), np.float32)
    for k in range(0, columns, ROWS_AT_ONCE):
        q[k : k + ROWS_AT_ONCE] = random.normal(size=q[k : k + ROWS_AT_ONCE].shape)
    for _ in range(POWER):
        q = rows.squared(orthonormal(q))
    q = orthonormal(q)
    turn = np.linalg.eigh(rows.inner(q))[1]
    return q @ turn[:, : -1 - rank : -1].astype(np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def weighted_lcs(a: list[int], worth: np.ndarray, b: np.ndarray) -> float:
    """Largest worth of a common subsequence; worth is of a's words."""
    best = np.zeros(len(b) + 1)
    for x, w in zip(a, worth):
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + w * (b == x)))
    return float(best[-1])


class Items:
    """The benchmark as searched for: numbers of terms, latent vectors, and what checks need."""

    def __init__(self, ids: list, words: list[np.ndarray], weight: np.ndarray, vectors: np.ndarray, idf: np.ndarray):
        self.ids, self.words, self.weight = ids, [w.tolist() for w in words], weight
        self.heavy = [[t for t in w if weight[t] > 0] for w in self.words]
        self.answers = [{t for t in w[-max(1, len(w) // 3) :] if weight[t] > 0} for w in self.words]
        self.active = (vectors**2).sum(axis=1) > 1e-14  # only these terms' vectors go to the tasks
        self.vectors, self.place = vectors[self.active], (np.cumsum(self.active) - 1).astype(np.int32)
        self.latent = np.array([self.vectors[self.place[w[self.active[w]]]].sum(axis=0) for w in words], np.float32).reshape(len(words), -1)
        self.square = np.maximum((self.latent**2).sum(axis=1), 1e-9)
        self.idf = np.maximum(idf, COMMON)
        self.worth = [float(self.idf[w].sum()) for w in self.words]
        self.thinned = {k for k, w in enumerate(self.words) if len(w) >= FEW and weight[w].sum() < HELD * self.worth[k]}
        self.weak = {k for k in range(len(words)) if len(self.heavy[k]) >= FEW and self.square[k] < KEPT * self.norm(k)}
        self.long = {k for k, w in enumerate(self.words) if len(w) > 2 * BLOCK and len(self.heavy[k]) >= FEW}
        self.index_exact()
        self.flag_words()

    def to_file(self, at: str) -> None:
        """Puts the terms' vectors, by far the largest part, into a file, from which a task reads them; else each worker has its own copy, and one that comes with the task."""
        write_matrix(at, (self.vectors[k : k + ROWS_AT_ONCE] for k in range(0, len(self.vectors), ROWS_AT_ONCE)))
        self.vectors, self.at = None, (at, self.vectors.shape)

    def from_file(self) -> None:
        if self.vectors is None:
            at, shape = self.at
            self.vectors = read_matrix(at, shape[1]) if shape[0] else np.empty(shape, np.float32)

    def norm(self, item: int) -> float:
        """Squared TF-IDF norm."""
        terms, n = np.unique(self.words[item], return_counts=True)
        return float(((n * self.weight[terms]) ** 2).sum())

    def index_exact(self) -> None:
        """Postings of the items that are counted exactly: item, what a word of it is worth, what it needs, blocks before and after."""
        self.exact_ids, need, before, after, posts = [], [], [], [], []
        for k, words in enumerate(self.words):
            if k in self.thinned and len(words) < SHORT:
                worth, least, reach = np.ones(len(words)), COPY, (0, 1)
            elif k in self.thinned:
                worth, least, reach = self.idf[words], PARAPHRASE, (0, -(-self.room(k) // BLOCK))
            elif k in self.weak or k in self.long:
                words = self.heavy[k]
                worth, least, reach = np.ones(len(words)), PARAPHRASE, (1, 2 + -(-len(self.words[k]) // BLOCK))
            else:
                continue
            terms, place = np.unique(words, return_inverse=True)
            posts.append((terms, np.full(len(terms), len(self.exact_ids)), np.bincount(place, worth)))
            self.exact_ids.append(k)
            need.append(least * float(worth.sum()) - 1e-6)
            before.append(reach[0])
            after.append(reach[1])
        self.need, self.before, self.after = np.array(need), np.array(before, np.int64), np.array(after, np.int64)
        term, item, worth = (np.concatenate([p[k] for p in posts]) if posts else np.empty(0, np.int64) for k in range(3))
        order = np.argsort(term, kind="stable")
        self.post_item, self.post_worth = item[order], worth[order]
        self.posts = np.bincount(term.astype(np.int64), minlength=len(self.idf))
        self.post_start = np.cumsum(self.posts) - self.posts

    def flag_words(self) -> None:
        """Of each way to a check, the words of which a leak has FLAGGED (or one that counts for as many): an item's rarest, as a leak can't do with the others alone."""
        self.flags = {way: np.zeros(len(self.idf), np.int8) for way in ("latent", "exact", "few")}
        for k, words in enumerate(self.words):
            heavy = self.heavy[k]
            if len(heavy) >= FEW:
                self.flag("latent", heavy, np.ones(len(heavy)), PARAPHRASE)
            elif words:
                self.flags["few"][words[int(np.argmax(self.idf[words]))]] = FLAGGED
            if k in self.thinned and len(words) < SHORT:
                self.flag("exact", words, np.ones(len(words)), COPY)
            elif k in self.thinned:
                self.flag("exact", words, self.idf[words], PARAPHRASE)
            elif k in self.weak or k in self.long:
                self.flag("exact", heavy, np.ones(len(heavy)), PARAPHRASE)

    def flag(self, way: str, words: list[int], worth: np.ndarray, least: float) -> None:
        terms, place = np.unique(words, return_inverse=True)
        times, worth = np.bincount(place), np.bincount(place, worth)
        order = np.argsort(-self.idf[terms], kind="stable")
        need, got = least * worth.sum() - 1e-6, np.cumsum(worth[order])
        one = int(np.argmax(worth.sum() - got < need))
        most = np.sort(worth / times)[::-1][: FLAGGED - 1].sum()  # what fewer than FLAGGED words are worth at most
        several = np.flatnonzero(worth.sum() - got + most < need)
        if len(several):
            self.flags[way][terms[order[: several[0] + 1]]] |= 1
        else:
            self.flags[way][terms[order[: one + 1]]] = FLAGGED

    def room(self, item: int) -> int:
        """Words in which a thinned item is looked for, from its first on."""
        n = len(self.words[item])
        return n + max(1, n // 4) if n < SHORT else n + int(np.ceil(SPREAD * n))

    def exact(self, t: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word, item) of each window of texts, one for every block, that has the words which a leak needs; a word counts once in a window."""
        texts = np.unique(np.searchsorted(first, np.flatnonzero(self.flags["exact"][t]), "right") - 1)
        if not len(texts):
            return
        items = len(self.exact_ids)
        most_before, most_after = int(self.before.max()), int(self.after.max())
        blocks = -(-np.diff(first)[texts] // BLOCK)
        apart = blocks + max(most_before, most_after)  # no window reaches another text
        base = np.cumsum(apart) - apart
        used = np.flatnonzero(self.posts[t])
        text = np.searchsorted(first, used, "right") - 1
        slot = np.minimum(np.searchsorted(texts, text), len(texts) - 1)
        used, slot = used[texts[slot] == text], slot[texts[slot] == text]
        at = base[slot] + (used - first[texts[slot]]) // BLOCK
        total, part = int(base[-1] + blocks[-1]), max(64, COUNTED // items)
        for k in range(0, total, part):
            windows = min(part, total - k)
            lo, hi = np.searchsorted(at, [k - most_before, k + windows + most_after])
            if lo == hi:
                continue
            span = windows + most_before + most_after
            both = np.unique(t[used[lo:hi]].astype(np.int64) * span + at[lo:hi] - k + most_before)
            term, block = both // span, both % span - most_before
            last = np.concatenate([[-most_before - 1], np.where(term[1:] == term[:-1], block[:-1], -most_before - 1)])
            n = self.posts[term]
            row = np.repeat(np.arange(len(term)), n)
            post = np.arange(len(row)) + np.repeat(self.post_start[term] - (np.cumsum(n) - n), n)
            item, worth = self.post_item[post], self.post_worth[post]
            start = np.maximum(np.maximum(block[row] - self.after[item], last[row] + self.before[item] + 1), 0)
            stop = np.minimum(block[row] + self.before[item] + 1, windows)
            new = start < stop
            start, stop, item, worth = start[new], stop[new], item[new], worth[new]
            size = (windows + 1) * items
            sums = np.bincount(start * items + item, worth, size) - np.bincount(stop * items + item, worth, size)
            sums = sums.reshape(windows + 1, items).cumsum(axis=0)[:windows]
            i, j = np.nonzero(sums >= self.need)
            slots = np.searchsorted(base, k + i, "right") - 1
            inside = k + i - base[slots]
            real = inside < blocks[slots]
            yield from zip(texts[slots[real]].tolist(), (inside[real] * BLOCK).tolist(), [self.exact_ids[x] for x in j[real]])

    def check_all(self, t: np.ndarray, at: int, item: int) -> tuple[float, float, bool]:
        """check() of a thinned item, by all its words."""
        words, room = self.words[item], self.room(item)
        near = t[at : at + BLOCK + room]
        if len(words) < SHORT:
            starts = np.flatnonzero(np.isin(near[:BLOCK], words))
            share = max((lcs(words, near[k : k + room].tolist()) for k in starts), default=0) / len(words)
            return share, share, share >= COPY
        share = weighted_lcs(words, self.idf[words], near) / self.worth[item]
        answer = np.unique(words[-max(1, len(words) // 3) :])
        there = float(self.idf[answer[np.isin(answer, near)]].sum() / self.idf[answer].sum())
        return share, there, share >= COPY or (share >= PARAPHRASE and there >= ANSWER)

    def cosine(self, t: np.ndarray, at: int, item: int) -> float:
        """Of the item and the words from there on, as many as a passage or the item has, by IDF."""
        terms, n = np.unique(t[at : at + max(2 * BLOCK, len(self.words[item]))], return_counts=True)
        own, m = np.unique(self.words[item], return_counts=True)
        p, q = n * self.idf[terms], m * self.idf[own]
        _, i, j = np.intersect1d(terms, own, return_indices=True)
        return float(p[i] @ q[j] / np.sqrt((p @ p) * (q @ q)))

    def candidates(self, t: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word, item, cosine) of the passages of texts, whose words lie one after the other."""
        hit = np.flatnonzero(self.flags["latent"][t])
        if not len(hit):
            return
        n = np.diff(first)
        blocks = -(-n // BLOCK)
        base = np.cumsum(blocks + 1) - (blocks + 1)  # an empty block lies between two texts
        of = np.repeat(base, n) + (np.arange(len(t)) - np.repeat(first[:-1], n)) // BLOCK
        total = int(base[-1] + blocks[-1]) + 2
        near = np.cumsum(np.pad(np.bincount(of[hit], self.flags["latent"][t[hit]], total), (3, 3)))
        inside = np.bincount(of, minlength=total) > 0
        windows = np.flatnonzero((near[6:] - near[:-6] >= FLAGGED - 0.5) & inside)  # flagged words from two blocks before a passage to two behind it
        if not len(windows):
            return
        needed = np.zeros(total, bool)
        needed[windows] = needed[windows + 1] = True
        used = np.flatnonzero(needed[of] & self.active[t])
        if not len(used):
            return
        start = np.flatnonzero(np.concatenate([[True], of[used][1:] != of[used][:-1]]))
        compact = np.full(len(needed), len(start), np.int64)  # the last row stays empty
        compact[of[used[start]]] = np.arange(len(start))
        sums = np.zeros((len(start) + 1, self.vectors.shape[1]), np.float32)
        sums[:-1] = sums_of(self.vectors, self.place[t[used]], start, np.diff(np.append(start, len(used))))
        for lo in range(0, len(windows), 4096):
            some = windows[lo : lo + 4096]
            p = sums[compact[some]] + sums[compact[some + 1]]
            size = np.maximum((p**2).sum(axis=1), 1e-12)
            for k in range(0, len(self.ids), ITEMS_COMPARED):
                square = self.square[k : k + ITEMS_COMPARED]
                dot = p @ self.latent[k : k + ITEMS_COMPARED].T
                i, j = np.nonzero(dot > COVERAGE * square)
                cosine = dot[i, j] / np.sqrt(size[i] * square[j])
                i, j, cosine = i[cosine > COSINE], j[cosine > COSINE], cosine[cosine > COSINE]
                text = np.searchsorted(base, some[i], "right") - 1
                yield from zip(text.tolist(), ((some[i] - base[text]) * BLOCK).tolist(), (k + j).tolist(), cosine.tolist())

    def check(self, t: np.ndarray, at: int, item: int) -> tuple[float, float, bool]:
        """Shares of the item's words and of its answer found around a passage, and whether that is a leak."""
        near = t[max(0, at - BLOCK) : at + 3 * BLOCK + len(self.words[item])].tolist()
        heavy = self.heavy[item]
        if len(heavy) < FEW:
            share = lcs(self.words[item], near) / max(1, len(self.words[item]))
            return share, share, share >= COPY
        share = lcs(heavy, [x for x in near if self.weight[x] > 0]) / len(heavy)
        answer = self.answers[item]
        there = len(answer & set(near)) / len(answer) if answer else 1.0
        return share, there, share >= COPY or (share >= PARAPHRASE and there >= ANSWER)


def searcher(items: Items, id_type: pa.DataType, carried: list[str]):
    """(words, carried ...) -> (carried ..., item_id, cosine, common, answer) of each leak: a row and an item occur once."""
    few = [k for k, h in enumerate(items.heavy) if len(h) < FEW and items.words[k]]

    def texts_with(t: np.ndarray, first: np.ndarray) -> list[int]:
        return np.unique(np.searchsorted(first, np.flatnonzero(items.flags["few"][t]), "right") - 1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items.from_file()
        for b in slices(batches, "words", SEARCHED):
            t, first = numbers(b.column(0))
            best: dict[tuple[int, int], tuple] = {}

            def keep(i: int, item: int, found: tuple[float, float, bool], cosine) -> None:
                share, there, leak = found
                if leak and share > best.get((i, item), (0,))[0]:
                    best[i, item] = (share, there, cosine())

            for i, at, item, cosine in items.candidates(t, first):
                if best.get((i, item), (0,))[0] < 0.999:
                    keep(i, item, items.check(t[first[i] : first[i + 1]], at, item), lambda: cosine)  # noqa: B023
            for i, at, item in items.exact(t, first):
                if best.get((i, item), (0,))[0] < 0.999:
                    own = t[first[i] : first[i + 1]]
                    keep(i, item, (items.check_all if item in items.thinned else items.check)(own, at, item), lambda: items.cosine(own, at, item))  # noqa: B023
            for i in texts_with(t, first) if few else ():  # words without weight have no latent vector
                own = t[first[i] : first[i + 1]]
                for item in few:
                    words = items.words[item]
                    if (i, item) not in best and any(own[k : k + len(words)].tolist() == words for k in np.flatnonzero(own == words[0])):
                        best[i, item] = (1.0, 1.0, 1.0)
            pairs = sorted(best)
            rows = pa.array([i for i, _ in pairs], pa.int32())
            share, there, cosine = (pa.array([best[p][k] for p in pairs], pa.float64()) for k in range(3))
            yield pa.record_batch([*(c.take(rows) for c in b.columns[1:]), pa.array([items.ids[k] for _, k in pairs], id_type), cosine, share, there], [*carried, "item_id", "cosine", "common", "answer"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common, answer: a row for each document and benchmark item of which it has a passage."""
    return search(docs.select("text", "doc_id"), benchmark)


def search(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """find_leaks for rows of any columns after text. The benchmark is searched for in blocks of about ITEMS_AT_ONCE items, one pass each."""
    rows = benchmark.select("item_id", "text").where("text is not null").distinct()
    blocks = -(-rows.count() // ITEMS_AT_ONCE)
    if blocks < 2:
        return search_block(texts, rows)
    found = [staged(search_block(texts, rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)), "leaks") for k in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def search_block(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    kept = [f for f in texts.schema.fields if f.name != "text"]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*kept, benchmark.schema["item_id"]]) + ", cosine double, common double, answer double"
    asked = [(r.item_id, r.text) for r in benchmark.orderBy("item_id", "text").collect()]
    own = sorted({w for _, text in asked for w in clean(text).split()})
    if not own:
        return spark.createDataFrame([], shape)
    terms, columns = Terms(own), len(own) + HASHED
    t, first = terms.of([text for _, text in asked])
    asked = [(i, t[lo:hi]) for (i, _), lo, hi in zip(asked, first[:-1], first[1:]) if hi > lo]
    names = [f.name for f in kept]
    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    words = staged(in_arrow(texts.select("text", *names), numbered(terms, names), f"words binary{carried}"), "words")
    df = np.zeros(columns)
    total = 1
    for r in in_arrow(words.select("words"), counter(columns), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # a row for each number, whatever the corpus
        if r.term < 0:
            total = max(1, r.n)
        else:
            df[r.term] = r.n
    idf = np.log((1 + total) / (1 + df)).astype(np.float32)
    weight = np.where(df <= max(MAX_DF * total, 3), idf, 0).astype(np.float32)
    vectors = np.zeros((columns, 1), np.float32)
    if any(weight[w].any() for _, w in asked):
        fit = Fit(words, total, [w for _, w in asked], weight)
        vectors = randomised_svd(fit, columns, min(max(RANK, len(asked)), MOST_RANK))
        vectors *= weight[:, None]
    items = Items([i for i, _ in asked], [w for _, w in asked], weight, vectors, idf)
    del vectors
    items.to_file(new_path(spark, "vectors"))
    give_back()
    return in_arrow(words, searcher(items, to_arrow_type(benchmark.schema["item_id"].dataType), names), shape)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text has a passage of the benchmark; same columns."""
    found = search(docs.select("text", *key_of("text")), benchmark)
    return keep_keys(docs, staged(found.select("k1", "k2", F.lit(False).alias("stays")), "leaks"), "text")
