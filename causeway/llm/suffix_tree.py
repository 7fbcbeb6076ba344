"""Language-model scores from a probabilistic suffix tree over words (operator 7).

A state of the tree is a context of up to ``depth`` words that stands
``least`` times or more in the training texts and whose next-token
distribution diverges from that of its suffix: coding each of its occurrences
by its own distribution, with that occurrence left out, saves ``divergence``
nats a token or more.  A state takes ``discount`` off the count of each of its
next tokens and deals what that makes by the distribution of its suffix; the
root's are add-0.1 word probabilities.  A token is scored by the longest state
that ends before it.

Both thresholds are absolute, so the tree grows with the corpus.  No task and
no driver holds it: texts are kept as blocks of hashed words (files in the
shared folder), and for each length in turn a block asks for the counts of its
distinct contexts and next tokens.  Requests are dealt by the hash of the
context (in pieces, if it stands very often) to tasks that add them up, test
the divergence and answer each block.  A request or an answer is one packed
row for a block and a part, in place of a row for each n-gram.  What a block is
told at a level it keeps beside its texts, so no answer is sent twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from causeway.llm.common import drop_path, get_file, id_column, map_rows, put_file, scratch_path, text_column, written

#: Stands for the end of a text among the words; no word holds a blank.
END = b"\n"
#: Tokens of a block (whole texts), and of a part of the requests.
BLOCK, PART = 1 << 21, 1 << 21
#: Occurrences of a context whose continuations go to one part; those of a more frequent one are dealt to several.
HOT = 1 << 23
#: Bits by which a part knows a continuation within its context, of which the pieces of a frequent context share none:
#: two of a context's next tokens in one part are taken for one with a probability of 2 ** -40.
LOW = np.uint64((1 << 40) - 1)
#: Next tokens of frequent contexts in one row.
SENT = 1 << 18
ANSWER = "block long, part int, totals binary, states binary"

_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of 64-bit numbers."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack(numbers: np.ndarray, width: int = 0) -> bytes:
    """Numbers as byte planes, compressed; ``width`` bytes of each, or as many as the largest needs."""
    raw = np.ascontiguousarray(numbers).astype("<u8")
    width = width or max(1, -(-int(raw.max(initial=0)).bit_length() // 8))
    return bytes([width]) + _squeeze.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _bundle(parts: list[bytes]) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], "<u8").tobytes(), *parts])


def _unbundle(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data[:8], "<u8")[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data[8 : 8 * (n + 1)], "<u8")).astype(np.int64)
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def _stable(parts: np.ndarray) -> np.ndarray:
    """An order by small numbers; those under 2**16 are sorted in linear time."""
    return np.argsort(parts.astype(np.uint16) if parts.max(initial=0) < 1 << 16 else parts, kind="stable")


class _Writer:
    """Collects texts and writes a block of them whenever it is full."""

    def __init__(self, folder: str, task: int) -> None:
        self.folder, self.task, self.seq = folder, task, 0
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.docs, self.known, self.training, self.tokens, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, text: str | None, training: bool) -> list[tuple]:
        words = (text or "").encode("utf-8").lower().split()
        words.append(END)
        known = self.words
        for w in set(words).difference(known):
            known[w] = len(known)
        self.tokens.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
        self.docs.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.training.append(training)
        self.size += len(words)
        return self.close() if self.size >= BLOCK else []

    def close(self) -> list[tuple]:
        if not self.docs:
            return []
        block, lengths, tokens = self.task << 24 | self.seq, np.array(list(map(len, self.tokens)), np.uint64), np.concatenate(self.tokens)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        put_file(self.folder, str(block), _bundle([_pack(np.array(self.docs, "<i8").view("<u8"), 8), _pack(np.array(self.known)), _pack(np.array(self.training)), _pack(lengths), _pack(hashes[order], 8), _pack(place[tokens])]))
        row = (block, self.size, int(lengths[np.array(self.training)].sum()))
        self.seq += 1
        self._clear()
        return [row]


class _Block:
    """A block of texts, and what is known of its tokens so far."""

    def __init__(self, data: bytes, parts: int, least: int, discount: float, frequent: int = HOT) -> None:
        docs, known, training, lengths, self.words, tokens = map(_unpack, _unbundle(data))
        self.parts, self.least, self.discount, self.frequent = parts, least, discount, frequent
        self.docs = [d if k else None for d, k in zip(docs.view("<i8").tolist(), known.tolist())]
        self.training, self.lengths, self.tokens = training.astype(bool), lengths.astype(np.int64), tokens.astype(np.int64)
        self.ends = np.cumsum(self.lengths) - 1  # places of the ends of texts
        self.inner = np.ones(len(self.tokens), bool)
        self.inner[self.ends] = False
        self.train = np.repeat(self.training, self.lengths)
        self.level = 0

    def grams(self) -> np.ndarray:
        """Hashes of (context, next token) at the active places."""
        return _mixed(self.context, self.words[self.tokens[self.active]])

    def sort(self) -> None:
        """Put in order, by parts, what the next level asks for: one entry for each distinct token or, below the root, for each distinct (context, next token) at the active places."""
        if self.level == 0:
            part, self.entry = _mixed(self.words, np.uint64(self.parts)) % np.uint64(self.parts), self.tokens
            order = _stable(part)
        else:
            gram = self.gram = self.grams()
            _, self.first, self.entry = np.unique(gram, return_index=True, return_inverse=True)
            context = self.context[self.first]
            pieces = -(-self.n[self.first] // self.frequent)
            piece = gram[self.first] % pieces.astype(np.uint64) if pieces.max(initial=1) > 1 else np.uint64(0)
            part = _mixed(context, piece) % np.uint64(self.parts)
            order = np.argsort(context, kind="stable")
            order = order[_stable(part[order])]
            c, p = context[order], part[order]
            self.new = np.ones(len(c), bool)
            self.new[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1])
            self.head = np.cumsum(self.new) - 1
        self.order, self.back = order, np.empty(len(order), np.int64)
        self.back[order] = np.arange(len(order))
        self.bounds = np.searchsorted(part[order], np.arange(self.parts + 1, dtype=np.uint64))

    def ask(self) -> Iterator[tuple[int, bytes]]:
        """``(part, request)`` of the next level."""
        self.sort()
        if self.level == 0:
            counts = np.bincount(self.tokens[self.train], minlength=len(self.words))
        else:
            counts = np.bincount(self.entry, self.train[self.active], minlength=len(self.first)).astype(np.int64)
            context, low, n = self.context[self.first], self.gram[self.first] & LOW, self.n[self.first]
            parent = np.rint(-1000 * np.log10(self.p[self.active[self.first]])).astype(np.int64)
        for p in np.flatnonzero(np.diff(self.bounds)).tolist():
            start, end = self.bounds[p], self.bounds[p + 1]
            mine = self.order[start:end]
            if self.level == 0:
                yield p, _bundle([_pack(self.words[mine], 8), _pack(counts[mine])])
            else:
                new = np.flatnonzero(self.new[start:end])
                heads = mine[new]
                yield p, _bundle([_pack(context[heads], 8), _pack(np.diff(np.append(new, len(mine)))), _pack(n[heads]), _pack(low[mine], 5), _pack(counts[mine]), _pack(parent[mine])])

    def told(self, answers: list[tuple[bytes, bytes]], hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The answers of a level, in order of their parts, as counts of words or, below the root, of the active places, and as numbers of next tokens of those places' contexts (0 if no state); ``hot``: the states among the contexts that were dealt to several parts, and their numbers of next tokens."""
        self.sort()
        none = np.zeros(0, np.int64)
        counts = np.concatenate([_unpack(t) for t, _ in answers]).astype(np.int64)[self.back] if answers else none
        if self.level == 0:
            return counts, none
        nexts = np.concatenate([_unpack(k) for _, k in answers]).astype(np.int64)[self.head][self.back][self.entry] if answers else none
        if len(hot[0]):
            place = np.minimum(np.searchsorted(hot[0], self.context), len(hot[0]) - 1)
            nexts = np.where((hot[0][place] == self.context) & (self.n > self.frequent), hot[1][place], nexts)
        return counts[self.entry], nexts

    def take(self, counts: np.ndarray, nexts: np.ndarray, tokens: int, distinct: int) -> None:
        """Go on to the next level with what ``told`` gave."""
        if self.level == 0:
            self.total = counts[self.tokens]
            self.p = (self.total + 0.1) / (tokens + 0.1 * (distinct + 1))
            self.base = np.log10(self.p)
            self.seen = self.total > 0
            before, counts, hashes, on = np.arange(len(self.tokens)), self.total, self.words[self.tokens], self.inner
        else:
            before, hashes, kept = self.active, self.grams(), nexts > 0
            at = self.active[kept]
            self.p[at] = (np.maximum(counts[kept] - self.discount, 0) + self.discount * nexts[kept] * self.p[at]) / self.n[kept]
            on = self.inner[before]
        # What stands often enough is a context of the token after it.
        on = on & (counts >= self.least)
        self.active, self.context, self.n = before[on] + 1, hashes[on], counts[on]
        self.level += 1

    def rows(self, tokens: int) -> list[tuple]:
        """Figures of each text."""
        start = self.ends + 1 - self.lengths
        total = lambda x: np.add.reduceat(x, start)
        return list(zip(self.docs, self.training.tolist(), self.lengths.tolist(), total(self.seen.astype(np.int64)).tolist(), [tokens] * len(start), total(self.base).tolist(), total(np.log10(self.p)).tolist()))


def _saved(total, every, n, q, discount: float):
    """What coding a next token's occurrences by its context saves, each left out in turn: nats, for arrays.  ``every``: the context's distinct next tokens."""
    left = np.maximum(total - 1 - discount, 0) + discount * (every - (total == 1)) * q
    return np.where(total > 0, total * np.log(np.maximum(left, 1e-300) / (np.maximum(n - 1, 1) * q)), 0.0)


def _add_up(blocks: list[int], requests: list[bytes], level: int, discount: float, divergence: float, frequent: int = HOT) -> tuple[list[tuple[int, bytes, bytes]], int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Answers to the requests of one part, its number of distinct tokens (level 0), and the next tokens of frequent contexts here: context, its occurrences, the token's occurrences and its probability before."""
    held = [list(map(_unpack, _unbundle(r))) for r in requests]
    if level == 0:
        keys, counts = (np.concatenate([h[k] for h in held]) for k in range(2))
        distinct, entry = np.unique(keys, return_inverse=True)
        total = np.bincount(entry, counts).astype(np.int64)
        ends = np.cumsum([len(h[0]) for h in held])
        return [(b, _pack(total[entry[e - len(h[0]) : e]]), b"") for b, h, e in zip(blocks, held, ends.tolist())], int((total > 0).sum()), (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    sizes = [h[1].astype(np.int64) for h in held]
    context = np.concatenate([np.repeat(h[0], s) for h, s in zip(held, sizes)])
    n_of = np.concatenate([np.repeat(h[2], s) for h, s in zip(held, sizes)]).astype(np.int64)
    low, counts, parent = (np.concatenate([h[k] for h in held]) for k in (3, 4, 5))
    _, first, entry = np.unique(_mixed(context, low), return_index=True, return_inverse=True)
    total = np.bincount(entry, counts)
    q, n = 10.0 ** (-parent[first].astype(float) / 1000), n_of[first]
    contexts, one, owner = np.unique(context[first], return_index=True, return_inverse=True)
    nexts = np.bincount(owner, total > 0)
    # The next tokens of a frequent context lie in several parts; whether it is a state is found from all of them.
    often = n[one] > frequent
    saved = np.bincount(owner, _saved(total, nexts[owner], n, q, discount))
    states = np.where(~often & (saved >= divergence * n[one]), nexts, 0)
    hot = often[owner] & (total > 0)
    out, at = [], 0
    for b, h, s in zip(blocks, held, sizes):
        size = int(s.sum())
        out.append((b, _pack(total[entry[at : at + size]]), _pack(states[np.searchsorted(contexts, h[0])])))
        at += size
    return out, 0, (contexts[owner[hot]], n[hot], total[hot].astype(np.int64), q[hot])


class _Levels:
    """Runs the exchange of requests and answers level by level."""

    def __init__(self, spark: SparkSession, folder: str, manifest: DataFrame, depth: int, least: int, discount: float, divergence: float, frequent: int) -> None:
        self.spark, self.folder, self.depth, self.least, self.discount, self.divergence, self.frequent = spark, folder, depth, max(2, least), discount, divergence, frequent
        self.manifest = manifest
        size, self.tokens, self.blocks = (int(x or 0) for x in manifest.agg(F.sum("size"), F.sum("training"), F.count("*")).first())
        self.tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.blocks)
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
        self.level, self.distinct, self.hot, self.answers = 0, 0, None, None

    def _opened(self, block: int, answers: pa.Table, level: int, hot: tuple[np.ndarray, np.ndarray] | None, tokens: int, distinct: int) -> _Block:
        """A block at ``level``: what earlier levels told it is read from its files, the last level's answers are added to them."""
        out = _Block(get_file(self.folder, str(block)), self.parts, self.least, self.discount, self.frequent)
        for at in range(level - 1):
            out.take(*(_unpack(x).astype(np.int64) for x in _unbundle(get_file(self.folder, f"{block}-{at}"))), tokens, distinct)
        if level:
            rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "totals", "states"))), key=lambda r: r[0])
            told = out.told([(t, k) for part, t, k in rows if part >= 0], hot)
            if level <= self.depth:
                put_file(self.folder, f"{block}-{level - 1}", _bundle([_pack(x) for x in told]))
            out.take(*told, tokens, distinct)
        return out

    def _by_block(self, step, schema: str) -> DataFrame:
        """``step`` of each block with the answers of the last level."""
        rows = self.manifest.select("block", F.lit(-1).alias("part"), F.lit(b"").alias("totals"), F.lit(b"").alias("states"))
        if self.answers is not None:
            rows = rows.union(self.answers.filter("block >= 0"))
        level, hot, tokens, distinct, opened = self.level, self.hot, self.tokens, self.distinct, self._opened_with()
        arrow = _arrow_schema(self.spark, schema)

        def run(table: pa.Table) -> pa.Table:
            block = table.column("block")[0].as_py()
            return _table(list(step(block, opened(block, table, level, hot, tokens, distinct))), arrow)

        # A fixed number of tasks: rows are few, but each block is much work.
        return rows.repartition(self.tasks, "block").groupBy("block").applyInArrow(run, schema)

    def _opened_with(self):
        light = _Levels.__new__(_Levels)
        light.folder, light.parts, light.least, light.discount, light.depth, light.frequent = self.folder, self.parts, self.least, self.discount, self.depth, self.frequent
        return light._opened

    def exchange(self) -> None:
        """Requests of all blocks for contexts of the level's number of words, and the answers."""
        level = self.level
        requests = self._by_block(lambda b, block: ((b, p, r) for p, r in block.ask()), "block long, part int, request binary")
        discount, divergence, frequent, arrow = self.discount, self.divergence, self.frequent, _arrow_schema(self.spark, ANSWER)

        def run(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            out, distinct, (often, n, total, q) = _add_up(table.column("block").to_pylist(), table.column("request").to_pylist(), level, discount, divergence, frequent)
            # The part's own rows: its number of distinct tokens, and the next tokens of frequent contexts.
            own = [(-1, part, _pack(np.array([distinct, len(often)])), b"")]
            own += [(-2, part, _bundle([_pack(x[i : i + SENT], w) for x, w in ((often, 8), (n, 0), (total, 0), (q.view(np.uint64), 8))]), b"") for i in range(0, len(often), SENT)]
            return _table([(b, part, t, k) for b, t, k in out] + own, arrow)

        answers = written(requests.repartition(self.parts, "part").groupBy("part").applyInArrow(run, ANSWER), "answers")
        said = [_unpack(bytes(r.totals)).tolist() for r in answers.filter("block = -1").select("totals").toLocalIterator()]
        if self.answers is not None:
            drop_path(self.spark, self.answers._scratch_path)
        self.answers, self.level = answers, level + 1
        if level == 0:
            self.distinct = sum(s[0] for s in said)
        self.hot = self._frequent_states() if sum(s[1] for s in said) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _frequent_states(self) -> tuple[np.ndarray, np.ndarray]:
        """States among the frequent contexts and their numbers of next tokens: first all next tokens are counted, then what each saves is summed."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    context, n, total, q = map(_unpack, _unbundle(x))
                    yield list(zip(context.view("<i8").tolist(), n.astype(np.int64).tolist(), total.astype(np.int64).tolist(), q.view("<f8").tolist()))

        tokens = map_rows(self.answers.filter("block = -2").select("totals"), rows, "context long, n long, total long, q double")
        # A row for each frequent context: one for every ``frequent`` tokens of the corpus and length at most.
        every = tokens.groupBy("context").agg(F.count("*").alias("every"))
        d, total, q = self.discount, F.col("total"), F.col("q")
        left = F.greatest(total - 1 - d, F.lit(0)) + d * (F.col("every") - (total == 1).cast("int")) * q
        saved = F.sum(total * F.log(F.greatest(left, F.lit(1e-300)) / (F.greatest(F.col("n") - 1, F.lit(1)) * q)))
        found = tokens.join(every, "context").groupBy("context").agg(saved.alias("saved"), F.max("n").alias("n"), F.max("every").alias("every")).filter(F.col("saved") >= self.divergence * F.col("n")).select("context", "every").collect()
        contexts = np.array([r.context for r in found], "<i8").view(np.uint64)
        order = np.argsort(contexts)
        return contexts[order], np.array([r.every for r in found], np.int64)[order]

    def scores(self) -> DataFrame:
        tokens = self.tokens
        return self._by_block(lambda _, block: block.rows(tokens), SCORES)


SCORES = "doc_id long, in_training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def score(docs: DataFrame, in_training: Column, text: str = "text", doc_id: str = "doc_id", depth: int = 3, least: int = 2, divergence: float = 0.02, discount: float = 0.75, frequent: int = HOT) -> DataFrame:
    """Scores of all whole texts under a tree that is fitted to those where ``in_training`` holds.

    Returns doc_id, in_training, n_tokens, n_known, train_tokens, base_score
    (add-0.1 word probabilities) and score, one row per row of ``docs``.
    Words are lower-cased (A-Z); a text's end is a token.  Null and empty
    texts consist of the end alone; a very long text is a block of its own and
    must fit in a task's memory, some hundred bytes a word; repeated rows count
    and are scored each; a table without training rows gives every token the
    probability of an unknown one; an empty table gives an empty result; null
    ``in_training`` counts as false; ids are whole numbers or null; other
    columns are not read.

    ``depth``: words of the longest context; ``least`` (2 at least),
    ``divergence`` and ``discount`` (between 0 and 1): see above.  Contexts of
    more than ``frequent`` occurrences are dealt to several tasks, which
    changes no result.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "suffix-tree")
    narrow = docs.select(id_column(docs, doc_id).alias("doc_id"), text_column(docs, text).alias("text"), F.coalesce(in_training, F.lit(False)).alias("in_training"))

    # A block's name depends on its place alone, so a task that is tried again writes the same files.
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        from pyspark import TaskContext

        writer = _Writer(folder, TaskContext.get().partitionId())
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                for row in zip(*(piece.column(c).to_pylist() for c in range(3))):
                    yield writer.add(*row)
        yield writer.close()

    manifest = written(map_rows(narrow, blocks, "block long, size long, training long"), "suffix-tree-blocks")
    levels = _Levels(spark, folder, manifest, depth, least, discount, divergence, frequent)
    for _ in range(depth + 1):
        levels.exchange()
    out = written(levels.scores(), "suffix-tree-scores")
    for path in [folder, manifest._scratch_path, levels.answers._scratch_path]:
        drop_path(spark, path)
    return out
