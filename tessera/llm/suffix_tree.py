"""LM scoring with a probabilistic suffix tree over words.

Tokens are the words of the lower-cased text (A-Z only) and one end. A state is a context, the last 1 to ``DEPTH``
tokens; the root is the add-one unigram model. A state s, seen c times in training, gives the next token w the chance
(c(s,w) + a P(w)) / (c + a) with a = c ** ``PRIOR``, where P is the distribution of its parent, the longest kept
proper suffix of s; so every state is smoothed into its parent and sums to one over the vocabulary and one unknown.
A context seen ``MIN_COUNT`` times or more is kept if its divergence from the parent pays: the log-likelihood ratio
of its own training tokens, each predicted with itself left out, is ``GAIN`` nats or more. A token is scored by the
longest kept state that its history ends with.

The model grows with the corpus, so nothing of it is broadcast. Texts are packed in blocks of about ``BLOCK_TOKENS``
tokens, numbered within the block, and written once. A block asks for its distinct runs of tokens by 64-bit key,
in one sorted list for each key range (``bucket``) with its own counts; the task of a bucket adds up the lists of
all blocks and answers each list in its own order, marking the block that holds a key first as its owner. Level by
level the blocks ask for counts of longer runs (only below contexts that are frequent enough), and the owners of a
state's runs add up its gain the same way. In the end each block scores its documents from the answers to it. A hot
word is one key of a list, so no key gathers rows; lists are cut by key range, so no bucket gathers a table.

Keys of single words have 64 bits; those of longer runs ``KEY_BITS`` bits within their bucket, which bounds the lists
that travel. Runs of equal keys are counted as one: of the about 10^6 runs of a bucket one in 10^6, whatever the size
of the corpus.

Defined cases: a null or empty text is one end; a row without an id is scored, never learned from and not held out;
repeated rows are scored one by one; long texts are cut at a block's edge and carry their context over; without
training texts every token has chance 1; an empty table gives an empty result.
"""
from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import prepare, read, slices, stage
from tessera.llm.registry import query

DEPTH = 2
MIN_COUNT = 8
GAIN = 8.0
PRIOR = 0.85

BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 2_000_000       # tokens of the corpus to a bucket
KEY_BITS = 41                   # of a run's key within its bucket
PIECE_BYTES = 1 << 20           # of a long text that are split into words at a time
# A-Z in lower case, white space as a space
_LOWER = bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b""                      # no word is empty


def pack(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, piece by piece."""
    text, at = text.translate(_LOWER), 0
    while at < len(text):
        end = at + PIECE_BYTES
        end = len(text) if end >= len(text) else text.find(b" ", end)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Numbering(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


class _Builder:
    """Tokens of documents, cut into blocks."""

    def __init__(self, depth: int, most: int):
        self.depth, self.most = depth, most
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.tokens, self.size = _Numbering(), [], 0
        self.rows, self.ids, self.held, self.learn, self.lens, self.skips = [], [], [], [], [], []

    def add(self, row: int, doc_id, held: bool, learn: bool, text: bytes) -> Iterator[dict]:
        tail: list[bytes] = []
        self._open(row, doc_id, held, learn, tail)
        for words in (*word_lists(text), [_END]):
            while words:
                if self.size >= self.most:      # full inside a document: go on in the next block
                    yield self.block()
                    self._open(row, doc_id, held, learn, tail)
                some, words = words[:self.most - self.size], words[self.most - self.size:]
                self._put(some)
                tail = (tail + some)[-self.depth:]
        if self.size >= self.most:
            yield self.block()

    def _open(self, row, doc_id, held, learn, tail: list[bytes]) -> None:
        for values, v in ((self.rows, row), (self.ids, doc_id), (self.held, held), (self.learn, learn),
                          (self.lens, 0), (self.skips, len(tail))):
            values.append(v)
        self._put(tail)
        self.size -= len(tail)

    def _put(self, words: list[bytes]) -> None:
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.lens[-1] += len(words)
        self.size += len(words)

    def block(self) -> dict:
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.numbers), np.uint64, len(self.numbers))
        order = np.argsort(keys)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        out = {"words": pack_sorted(keys[order]), "tokens": pack(place[np.concatenate(self.tokens)]), "rows": self.rows,
               "ids": self.ids, "held": self.held, "learn": self.learn, "lens": self.lens, "skips": self.skips, "n": self.size}
        self._clear()
        return out


def blocks_of(docs: DataFrame, depth: int, most: int) -> DataFrame:
    """``docs`` (row, id, held, learn, text as bytes) in blocks, written once; ``block`` numbers them."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = _Builder(depth, most)

        def out(block: dict) -> pa.RecordBatch:
            columns = [pa.array([block["words"]], pa.binary()), pa.array([block["tokens"]], pa.binary()),
                       pa.array([block["rows"]], pa.list_(pa.int64())), pa.array([block["ids"]], pa.list_(id_type)),
                       pa.array([block["held"]], pa.list_(pa.bool_())), pa.array([block["learn"]], pa.list_(pa.bool_())),
                       pa.array([block["lens"]], pa.list_(pa.int32())), pa.array([block["skips"]], pa.list_(pa.int32())),
                       pa.array([block["n"]], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["words", "tokens", "rows", "ids", "held", "learn", "lens", "skips", "n"])

        id_type = None
        for batch in slices(batches):
            id_type = batch.column(1).type
            for row, doc_id, held, learn, text in zip(*(c.to_pylist() for c in batch.columns)):
                for block in builder.add(row, doc_id, held, learn, text or b""):
                    yield out(block)
        if builder.rows:
            yield out(builder.block())

    schema = (f"words binary, tokens binary, rows array<long>, ids array<{kind}>, held array<boolean>, learn array<boolean>, "
              "lens array<int>, skips array<int>, n long")
    return stage(docs.select("row", "id", "held", "learn", "text").mapInArrow(run, schema)
                 .withColumn("block", F.monotonically_increasing_id()), "pst-blocks")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of a run and the token after it."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + b
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Model:
    """What all workers know: sizes of the corpus and the parameters."""

    def __init__(self, bits: int, depth: int, min_count: int, gain: float, prior: float, tokens: int = 0, words: int = 0):
        self.bits, self.depth, self.min_count, self.gain, self.prior = bits, depth, min_count, gain, prior
        self.tokens, self.words = tokens, words


class Block:
    """A block with the answers to it, worked out level by level.

    ``at[d]`` numbers the distinct runs of d + 1 tokens that end at each position (-1: none, or below a context that is
    too rare), ``keys[d]`` are their keys in order.
    """

    def __init__(self, row: dict, model: Model, answers: dict[int, list[bytes]]):
        self.model, self.answers = model, answers
        self.words, self.tokens = unpack_sorted(row["words"]), unpack(row["tokens"], np.int32)
        lens = np.array(row["lens"], np.int64)
        start = np.cumsum(lens) - lens
        self.doc = np.repeat(np.arange(len(lens)), lens)
        self.place = np.arange(len(self.tokens)) - start[self.doc]
        self.own = self.place >= np.array(row["skips"], np.int64)[self.doc]      # not the context of an earlier block
        self.learn = self.own & np.array(row["learn"], bool)[self.doc]
        self.run_key = self.words[self.tokens]
        self.at, self.keys = [self.tokens.astype(np.int64)], [self.words]

    def counted(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Training count of the run that ends at each position, and whether this block owns the run; 0 where unknown."""
        given, at, count = self.answers.get(2 * level, []), self.at[level], np.zeros(len(self.tokens), np.int64)
        totals = np.concatenate([np.zeros(0, np.int64), *(unpack(t, np.int64) for t, _ in given)])
        owners = np.concatenate([np.zeros(0, np.uint8), *(unpack(o, np.uint8) for _, o in given if o)])
        count[at >= 0] = totals[at[at >= 0]]
        return count, owners

    def extend(self, level: int, context: np.ndarray | None) -> None:
        """Number the runs of ``level`` + 1 tokens whose context (the run before) has a count of ``min_count`` or more;
        all of them if ``context`` is None."""
        able = self.place >= level
        before = np.roll(self.run_key, 1)
        if context is not None:
            able &= np.roll(context, 1) >= self.model.min_count
        short = np.uint64(max(64 - self.model.bits - KEY_BITS, 0))
        self.run_key = _mixed(before, self.words[self.tokens]) >> short << short
        keys, number = np.unique(self.run_key[able], return_inverse=True)
        at = np.full(len(self.tokens), -1, np.int64)
        at[able] = number
        self.at.append(at)
        self.keys.append(keys)

    def asked(self, kind: int, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(kind, bucket, keys, values), one list a bucket; ``keys`` are sorted."""
        bucket = (keys >> np.uint64(64 - self.model.bits)).astype(np.int64) if self.model.bits else np.zeros(len(keys), np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(keys)]):
            yield kind, int(bucket[a]), pack_sorted(keys[a:b]), pack(values[a:b])

    def ask_counts(self, level: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        use = self.learn & (self.at[level] >= 0)
        counts = np.bincount(self.at[level][use], minlength=len(self.keys[level])).astype(np.int64)
        return self.asked(2 * level, self.keys[level], counts)

    def walk(self, depth: int, ask_gain: bool):
        """Score of each position from the states up to ``depth`` tokens. With ``ask_gain`` the states of ``depth`` are
        not decided yet: their parts of the gain are asked for instead."""
        model = self.model
        count, _ = self.counted(0)
        self.known = count
        score = np.log((count + 1.0) / (model.tokens + model.words + 1.0))
        self.base = score
        for level in range(1, depth + 1):
            context = count             # of the run before, by position
            self.extend(level, context if level > 1 else None)
            count, owners = self.counted(level)
            seen = np.where(self.at[level] >= 0, np.roll(context, 1), 0)
            use = np.flatnonzero(seen >= model.min_count)
            before = self.at[level - 1][use - 1]
            # runs are numbered already, so no sort is needed to list the states
            there = np.zeros(len(self.keys[level - 1]), bool)
            there[before] = True
            states, state = np.flatnonzero(there), (np.cumsum(there) - 1)[before]
            c, prior = seen[use].astype(float), seen[use] ** model.prior
            if ask_gain and level == depth:
                # one position of each run that this block owns
                first = np.full(len(self.keys[level]), -1)
                first[self.at[level][use][::-1]] = np.arange(len(use))[::-1]
                runs = np.flatnonzero(first >= 0)
                one = first[runs[(owners[runs] == 1) & (count[use][first[runs]] >= 2)]]
                n, p = count[use][one].astype(float), np.exp(score[use][one])
                ratio = n * (np.log((n - 1 + prior[one] * p) / p) - np.log(prior[one]))
                return self.asked(2 * level + 1, self.keys[level - 1][states],
                                  np.bincount(state[one], weights=ratio, minlength=len(states)))
            gains = np.concatenate([np.zeros(0), *(unpack(t, np.float32) for t, _ in self.answers.get(2 * level + 1, []))])
            gain = gains[state] + c * (np.log(prior) - np.log(c - 1 + prior))
            kept = gain >= model.gain
            use, c, prior = use[kept], c[kept], prior[kept]
            score = score.copy()
            score[use] = np.log((count[use] + prior * np.exp(score[use])) / (c + prior))
        self.score = score
        return iter(())


def tally(asked: DataFrame, name: str) -> DataFrame:
    """Answers (kind, bucket, block, totals, owners, n_keys, n_sum) to lists (kind, bucket, block, keys, values): the
    totals of all blocks in the order of each list, and 1 where the block is the first that holds the key."""
    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        kind = group["kind"][0].as_py()
        dtype = np.float64 if kind % 2 else np.int64
        lists = [unpack_sorted(k) for k in group["keys"].to_pylist()]
        values = [unpack(v, dtype) for v in group["values"].to_pylist()]
        keys, first, number = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
        totals = np.zeros(len(keys), dtype)
        np.add.at(totals, number, np.concatenate(values))
        owner = np.zeros(len(number), np.uint8)
        owner[first] = 1
        ends = np.cumsum([len(x) for x in lists])
        pieces = [(number[e - len(x):e], owner[e - len(x):e]) for x, e in zip(lists, ends)]
        alone = [0] * (len(lists) - 1)
        return pa.table({
            "kind": group["kind"], "bucket": group["bucket"], "block": group["block"],
            # gains are only compared with a bound
            "totals": pa.array([pack(totals[p].astype(np.float32) if kind % 2 else totals[p]) for p, _ in pieces], pa.binary()),
            "owners": pa.array([pack(o) for _, o in pieces], pa.binary()),
            "n_keys": pa.array([int((totals > 0).sum()), *alone], pa.int64()),
            "n_sum": pa.array([int(totals.sum()) if not kind % 2 else 0, *alone], pa.int64())})

    return stage(asked.groupBy("kind", "bucket").applyInArrow(
        merge, "kind int, bucket long, block long, totals binary, owners binary, n_keys long, n_sum long"), name)


def over_blocks(blocks: DataFrame, answers: list[DataFrame], model: Model, fn: Callable, schema: str,
                owned: int | None = None) -> DataFrame:
    """``fn(Block, row)`` -> rows, for each block with all answers to it; owners travel for the kind ``owned`` only."""
    given = blocks
    if answers:
        told = answers[0]
        for more in answers[1:]:
            told = told.unionByName(more)
        owners = F.when(F.col("kind") == owned, F.col("owners")) if owned is not None else F.lit(None).cast("binary")
        told = told.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "totals", owners.alias("owners"))).alias("told"))
        given = blocks.join(told, "block")
    names = given.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = dict(zip(names, (c[0].as_py() for c in batch.columns)))
            told: dict[int, list] = {}
            for a in sorted(row.pop("told", []), key=lambda a: (a["kind"], a["bucket"])):
                told.setdefault(a["kind"], []).append((a["totals"], a["owners"]))
            yield from fn(Block(row, model, told), row)

    return given.mapInArrow(run, schema)


_ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
_ASKED_DDL = "kind int, bucket long, block long, keys binary, values binary"


def _lists(block: int, asked) -> Iterator[pa.RecordBatch]:
    rows = [(kind, bucket, block, keys, values) for kind, bucket, keys, values in asked]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)], schema=_ASKED)


def score_texts(docs: DataFrame, learn: Column, held: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                min_count: int = MIN_COUNT, gain: float = GAIN, prior: float = PRIOR, block_tokens: int = BLOCK_TOKENS,
                bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(id, held, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from the rows that ``learn``."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), learn.alias("learn"),
                       F.col(text_col).cast("string").cast("binary").alias("text")).withColumn("row", F.monotonically_increasing_id())
    kind, id_type = dict(rows.dtypes)["id"], to_arrow_type(rows.schema["id"].dataType)
    blocks = blocks_of(rows, depth, block_tokens)
    size = blocks.agg(F.sum("n")).first()[0] or 0
    model = Model(max(-(-size // bucket_tokens) - 1, 0).bit_length(), depth, min_count, gain, prior)

    def first(block: Block, row: dict) -> Iterator[pa.RecordBatch]:
        yield from _lists(row["block"], block.ask_counts(0))
        if depth:
            block.extend(1, None)
            yield from _lists(row["block"], block.ask_counts(1))

    answers = [tally(over_blocks(blocks, [], model, first, _ASKED_DDL), "pst-counts")]
    whole = answers[0].where("kind = 0").agg(F.sum("n_sum").alias("tokens"), F.sum("n_keys").alias("words")).first()
    model = Model(model.bits, depth, min_count, gain, prior, whole["tokens"] or 0, whole["words"] or 0)

    def next_level(level: int):
        def ask(block: Block, row: dict) -> Iterator[pa.RecordBatch]:
            yield from _lists(row["block"], block.walk(level, True))
            if level < depth:
                block.extend(level + 1, block.counted(level)[0])
                yield from _lists(row["block"], block.ask_counts(level + 1))
        return ask

    for level in range(1, depth + 1):
        answers.append(tally(over_blocks(blocks, answers, model, next_level(level), _ASKED_DDL, 2 * level), f"pst-level-{level}"))

    def scored(block: Block, row: dict) -> Iterator[pa.RecordBatch]:
        block.walk(depth, False)
        n, own = len(row["rows"]), block.own
        doc = block.doc[own]

        def sums(values):
            return np.bincount(doc, weights=values[own], minlength=n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["rows"], pa.int64()), pa.array(row["ids"], id_type), pa.array(row["held"], pa.bool_()),
             *(pa.array(sums(v).astype(np.int64)) for v in (np.ones(len(own)), block.known > 0)),
             *(pa.array(sums(v) / np.log(10)) for v in (block.base, block.score))],
            ["row", "id", "held", "n_tokens", "n_known", "base_score", "score"])

    parts = over_blocks(blocks, answers, model, scored,
                        f"row long, id {kind}, held boolean, n_tokens long, n_known long, base_score double, score double")
    # a text that spans blocks has a row for each
    return parts.groupBy("row").agg(
        F.first("id").alias("id"), F.first("held").alias("held"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"),
        F.sum("score").alias("score")).drop("row")


@query("op12_suffix_tree")
def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text of ``documents`` under the suffix tree and under the unigram base."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    rows = score_texts(read(spark, sf_dir, "documents"), F.coalesce(fold != 2, F.lit(False)), F.coalesce(fold == 2, F.lit(False)))
    return rows.withColumnRenamed("id", "doc_id").withColumnRenamed("held", "held_out")
