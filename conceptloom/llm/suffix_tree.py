"""Language-model scores by a probabilistic suffix tree.

Symbols are bytes.  A text is written as its words, each with a closing blank, and a closing line break (the end
token), so the bytes' probabilities multiply to those of the token sequence.  A context of up to ``DEPTH`` bytes is a
state of the tree if it occurs at least ``SUPPORT`` times, at any size of the input, and its distribution of the next
byte diverges from that of its longest proper suffix: count times Kullback-Leibler divergence reaches half of (number of
different next bytes) * ln(count), the cost of describing it; so are all suffixes of a state.  Next-byte distributions
are smoothed with those of the suffix state (Witten-Bell).  A byte is scored by the state of its longest suffix.

Windows of DEPTH + 1 bytes are counted in each partition and summed by Spark, bucket by bucket; the tree is then learnt by joins and
aggregates of that table, and stays a table that grows with the input.  Only its head is broadcast: states with at least
``LEAST`` of all positions, so at most (DEPTH + 1) / LEAST, each with marks of the bytes by which states outside the head
lengthen it.  Windows whose longest state is in the head are scored where they are; of all others the different
ones are joined with the table's states, and their documents with the results.  Word counts for the base score stay a
table: words with at least 1 / HEAD of all training tokens (so at most HEAD words) are broadcast, all others are joined.

Defined results: null, empty and blank texts are the end token alone; every row is scored, repeated or not; rows with
a null id are training rows; with no training rows, all bytes are equally likely and the base score is 0 per token
(V and N are 0: log10(1 / 1)); further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.llm.common import UPPER, id_remainder, small_batches, whole_text
from conceptloom.scratch import Scratch

DEPTH = 6
#: Occurrences that a state needs.
SUPPORT = 8
#: Share of all positions from which a state is broadcast; no state is left out for it.
LEAST = 1.0 / (1 << 20)
HEAD = 1 << 16
_TABLE = bytes.maketrans(UPPER.encode() + bytes(range(9, 14)), UPPER.lower().encode() + b" " * 5)
_END = "\n"
_PAD = bytes(DEPTH)  # before a text
_AT_ONCE = 1 << 20  # bytes of text
_WORDS_HELD = 1 << 18
_CODES_HELD = 1 << 21
#: Bytes of text whose windows are added up together.
BUCKET = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if w]


def written(words: list[bytes]) -> bytes:
    return b" ".join([*words, b"\n"])


def _codes(texts: list[bytes], backwards: bool = False) -> np.ndarray:
    """The window of DEPTH + 1 bytes that ends at each byte, as a number; backwards: its last byte is the first digit."""
    raw = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8)
    n = len(raw) - DEPTH
    code = np.zeros(n, np.uint64)
    for j in range(DEPTH, -1, -1) if backwards else range(DEPTH + 1):
        code = code << np.uint64(8) | raw[j : j + n]
    keep = np.ones(n, bool)  # not those that end in the padding before the next text
    at = np.cumsum([len(t) + DEPTH for t in texts])[:-1] - DEPTH
    for j in range(DEPTH):
        keep[at + j] = False
    return code[keep]


def _batches(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``_AT_ONCE`` bytes of text."""
    for batch in batches:
        begin, size = 0, 0
        for end, n in enumerate(pc.binary_length(batch.column("text")).to_pylist(), 1):
            size += n
            if size >= _AT_ONCE or end == batch.num_rows:
                yield batch.slice(begin, end - begin)
                begin, size = end, 0


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``values`` and where each value's run begins in it."""
    order = np.argsort(values)
    value = values[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(len(value), 1), bool), value[1:] != value[:-1])))


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    order, first = _runs(code)
    return code[order[first]], np.add.reduceat(count[order], first) if len(code) else count


def _packed(codes: np.ndarray) -> bytes:
    """Codes in order as differences, byte by byte of each, so that their leading zeros lie together and are compressed."""
    return np.diff(codes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _window_counts(buckets: int):
    """A task's windows, added up until ``_CODES_HELD`` are different; a row has the codes of one bucket (of a hash) and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            code, count = codes[0], counts[0]
            bucket = ((code * _MIX >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
            some = [(b, order[x:y]) for b, (x, y) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if y > x]
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in some], pa.int32()), pa.array([_packed(code[x]) for _, x in some], pa.binary()),
                 pa.array([count[x].astype(np.int32).tobytes() for _, x in some], pa.binary())], names=["bucket", "codes", "counts"])

        for texts in _batches(written(words_of(t.as_py())) for b in batches for t in b.column(0)):
            new = np.sort(_codes(texts))
            first = np.flatnonzero(np.concatenate((np.ones(1, bool), new[1:] != new[:-1])))
            codes.append(new[first])
            counts.append(np.diff(first, append=len(new)))
            held += len(first)
            if held > 2 * _CODES_HELD:
                code, count = _added(codes, counts)
                codes, counts, held = [code], [count], len(code)
                if held > _CODES_HELD:
                    yield out()
                    codes, counts, held = [], [], 0
        if held:
            code, count = _added(codes, counts)
            codes, counts = [code], [count]
            yield out()

    return run


def _summed(group: pa.Table) -> pa.Table:
    """(code, n) of a bucket."""
    code, n = _added([_unpacked(x.as_py()) for x in group.column("codes")],
                     [np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in group.column("counts")])
    return pa.table({"code": pa.array(code.astype(np.int64)), "n": pa.array(n)})


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        words = pa.array(list(held), pa.binary())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column(0):
            held.update(words_of(t.as_py()))
            held[_END.encode()] += 1
            if len(held) > _WORDS_HELD:
                yield out()
                held.clear()
    yield out()


def _backwards(code: np.ndarray, size: int) -> np.ndarray:
    return code.byteswap() >> np.uint64(8 * (8 - size)) if size else code


class Tree:
    """The head's states by depth: sorted contexts with counts and marks, and sorted (context, next byte) codes with counts.

    All codes are kept backwards, next byte first, so windows in order are in order at every depth, and each depth
    looks up every different context and next byte once.
    """

    def __init__(self, states: dict[int, tuple], pairs: dict[int, tuple]):
        def turned(key: np.ndarray, size: int, columns: tuple, nothing: tuple) -> tuple:
            key = _backwards(key, size)
            order = np.argsort(key)
            return (key[order], *[np.append(c[order], np.array(x, c.dtype)) for c, x in zip(columns, nothing, strict=True)])

        none = np.zeros(0, np.uint64)
        self.states = {k: turned(key, k, rest, (1, 0, 0, 0, 0, 0)) for k, (key, *rest) in states.items()}
        self.pairs = {k: turned(key, k + 1, rest, (0,)) for k, (key, *rest) in pairs.items()}
        self._no_state = turned(none, 0, (np.zeros(0), np.zeros(0), none, none, none, none), (1, 0, 0, 0, 0, 0))
        self._no_pair = turned(none, 0, (np.zeros(0),), (0,))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted keys; len(keys), where the counts of nothing stand, if there is none."""
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return np.where(keys[at] == wanted, at, len(keys)) if len(keys) else np.zeros(len(wanted), int)

    def resolve(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the last byte of each window, given the bytes before: its probability by the head's states, the depth of
        the longest, and whether a state outside the head lengthens that; the windows are in order, each once."""
        p, depth, open_ = np.full(1, 1 / 256), np.full(1, -1), np.zeros(1, bool)
        alive, run, marks, place = np.ones(1, bool), np.zeros(len(codes), np.int64), None, np.zeros(1, np.int64)
        for k in range(DEPTH + 1):
            if not len(codes):
                break
            pair = codes >> np.uint64(8 * (DEPTH - k))
            new = np.concatenate(([True], pair[1:] != pair[:-1]))
            first, up = np.flatnonzero(new), run[new]
            keys, total, kinds, *own = self.states.get(k, self._no_state)
            pair_keys, n = self.pairs.get(k, self._no_pair)
            pair = pair[first]
            at = self._find(keys, pair & np.uint64((1 << 8 * k) - 1))
            before, alive, open_ = alive[up], alive[up] & (at < len(keys)), open_[up]
            if k:
                byte = pair & np.uint64(255)
                word = np.choose((byte >> np.uint64(6)).astype(np.int64), [m[place[up]] for m in marks])
                open_ = open_ | before & ~alive & ((word >> (byte & np.uint64(63)) & np.uint64(1)) == 1)
            p = np.where(alive, (n[self._find(pair_keys, pair)] + kinds[at] * p[up]) / (total[at] + kinds[at]), p[up])
            depth, marks, place = np.where(alive, k, depth[up]), own, at
            run = np.cumsum(new) - 1
        return p[run], depth[run], open_[run]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return self.resolve(codes)[0]

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each text, the sum over windows that the head decides, and the other windows as numbers."""
        code = _codes(texts, backwards=True)
        order, first = _runs(code)
        place = np.empty(len(code), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(code)))
        code = code[order[first]]
        p, _, open_ = self.resolve(code)
        each = np.where(open_, 0.0, np.log10(p))[place]
        ends = np.cumsum([len(t) for t in texts])
        left = np.flatnonzero(open_[place])
        rest = np.split(_backwards(code[place[left]], DEPTH + 1).astype(np.int64), np.searchsorted(left, ends[:-1]))
        return np.add.reduceat(each, np.concatenate(([0], ends[:-1]))), rest


def learn(scratch: Scratch, texts: DataFrame) -> tuple[Tree, DataFrame]:
    """The head of the tree, and all other states: k, context, total, kinds, next (next byte -> count)."""
    # The windows of a task are mostly different, so they are not rows: buckets of a bounded size are added up as arrays.
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    counted = texts.mapInArrow(_window_counts(size // BUCKET + 1), "bucket int, codes binary, counts binary")
    windows = scratch.save(counted.groupBy("bucket").applyInArrow(_summed, "code bigint, n bigint"), "windows")
    low = lambda k: F.lit((1 << 8 * k) - 1).cast("bigint")
    before = F.shiftright("code", 8)
    levels = F.array(*[F.struct(F.lit(k).alias("k"), before.bitwiseAND(low(k)).alias("context")) for k in range(DEPTH + 1)])
    counted = windows.select(F.explode(levels).alias("_l"), F.col("code").bitwiseAND(low(1)).cast("int").alias("byte"), "n").groupBy(
        "_l.k", "_l.context", "byte").agg(F.sum("n").alias("n"))
    nodes = scratch.save(counted.groupBy("k", "context").agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"), F.map_from_entries(F.collect_list(F.struct("byte", "n"))).alias("next"),
    ).where((F.col("total") >= SUPPORT) | (F.col("k") == 0)), "nodes")
    scratch.drop("windows")
    # The suffix of a context drops its first byte; both are counted from the same windows.
    shorter = F.expr("context & (shiftleft(1L, 8 * (k - 1)) - 1)")
    up = nodes.select((F.col("k") + 1).alias("k"), F.col("context").alias("up"), F.col("total").alias("total_up"), F.col("next").alias("next_up"))
    gain = F.expr("aggregate(map_entries(next), 0D, (a, e) -> a + e.value * ln((e.value / total) / (next_up[e.key] / total_up)))")
    diverging = nodes.where("k > 0").withColumn("up", shorter).join(up, ["k", "up"]).where(
        gain >= 0.5 * F.col("kinds") * F.log("total")).select("k", "context")
    suffixes = F.expr("explode(transform(sequence(0, k), j -> named_struct('k', j, 'context', context & (shiftleft(1L, 8 * j) - 1))))")
    kept = diverging.select(suffixes.alias("_s")).select("_s.*").unionByName(nodes.where("k = 0").select("k", "context")).distinct()
    states = scratch.save(nodes.join(kept, ["k", "context"]), "states")
    scratch.drop("nodes")
    positions = states.where("k = 0").agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    in_head = (F.col("total") >= F.lit(LEAST) * F.lit(positions)) | (F.col("k") == 0)
    head, tail = states.where(in_head), states.where(~in_head)
    longer = F.expr("shiftright(context, 8 * (k - 1))")
    marks = tail.select((F.col("k") - 1).alias("k"), shorter.alias("context"), longer.alias("_b")).groupBy("k", "context").agg(*[
        F.expr(f"bit_or(CASE WHEN _b DIV 64 = {w} THEN shiftleft(1L, CAST(_b % 64 AS INT)) ELSE 0L END) AS m{w}") for w in range(4)])
    words = [F.coalesce(f"m{w}", F.lit(0).cast("bigint")).alias(f"m{w}") for w in range(4)]
    # At most (DEPTH + 1) / LEAST states; Arrow, as rows of Python objects would take many times the memory.
    s = head.join(marks, ["k", "context"], "left").select("k", "context", "total", "kinds", *words).toArrow()
    p = head.select("k", "context", F.explode("next").alias("byte", "n")).select("k", F.expr("shiftleft(context, 8) | byte").alias("pair"), "n").toArrow()

    def by_depth(t: pa.Table, key: str, *columns: tuple[str, type]) -> dict[int, tuple]:
        depth = t["k"].to_numpy()
        return {k: (t[key].to_numpy()[depth == k].astype(np.uint64), *[t[c].to_numpy()[depth == k].astype(kind) for c, kind in columns])
                for k in range(DEPTH + 1) if (depth == k).any()}

    counts = [("total", float), ("kinds", float), *[(f"m{w}", np.uint64) for w in range(4)]]
    return Tree(by_depth(s, "context", *counts), by_depth(p, "pair", ("n", float))), tail


def learn_tree(scratch: Scratch, texts: DataFrame) -> Tree:
    return learn(scratch, texts)[0]


def by_table(windows: DataFrame, tree, tail: DataFrame) -> DataFrame:
    """code, log10 of the probability of each different window (code) that a state of ``tail`` decides."""

    def by_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.sort(_backwards(b.column(0).to_numpy().astype(np.uint64), DEPTH + 1))
            p, depth, _ = tree.value.resolve(code)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_backwards(code, DEPTH + 1).astype(np.int64)), pa.array(p), pa.array(depth.astype(np.int32))], names=["code", "p", "depth"])

    started = windows.select("code").distinct().mapInArrow(by_head, "code bigint, p double, depth int")
    steps = started.select("code", "p", F.expr(f"explode(sequence(depth + 1, {DEPTH}))").alias("k")).withColumn(
        "context", F.expr("shiftright(code, 8) & (shiftleft(1L, 8 * k) - 1)"))
    met = steps.join(tail, ["k", "context"]).select(
        "code", "p", F.expr("struct(k, coalesce(next[CAST(code & 255 AS INT)], 0L) AS n, total, kinds)").alias("_s"))
    return met.groupBy("code").agg(F.first("p").alias("p"), F.array_sort(F.collect_list("_s")).alias("_s")).select(
        "code", F.log10(F.expr("aggregate(_s, p, (q, x) -> (x.n + x.kinds * q) / (x.total + x.kinds))")).alias("log_p"))


def scores(spark: SparkSession, docs: DataFrame, modulus: int = 7, left_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    with small_batches(spark):
        return _scores(spark, docs, modulus, left_out)


def _scores(spark: SparkSession, docs: DataFrame, modulus: int, left_out: int) -> DataFrame:
    scratch = Scratch(spark, "suffix-tree")
    rows = docs.select("doc_id", (id_remainder(modulus) == left_out).alias("held_out"), whole_text().alias("text"))
    training = rows.where(~F.col("held_out")).select("text")
    tree, tail_states = learn(scratch, training)
    tree = spark.sparkContext.broadcast(tree)
    vocabulary = scratch.save(
        training.mapInArrow(_word_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    in_head = F.col("n") * F.lit(HEAD) >= F.lit(n)  # at most HEAD words
    head = spark.sparkContext.broadcast({bytes(r.word): r.n for r in vocabulary.where(in_head).collect()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in _portions(batches):
            words = [[*words_of(t.as_py()), _END.encode()] for t in batch.column("text")]
            texts = [b" ".join(w) for w in words]
            parts = [tree.value.scores(part) for part in _batches(iter(texts))]
            logs = np.concatenate([x for x, _ in parts] or [np.zeros(0)])
            rest = [np.unique(codes, return_counts=True) for _, part in parts for codes in part]
            sums, seen, tails, times = [], [], [], []
            for w in words:
                count = Counter(w)
                common = [(known[x], k) for x, k in count.items() if x in known]
                c, k = np.array(common, float).reshape(-1, 2).T
                sums.append(float(np.dot(np.log10(c + 1), k)))
                seen.append(int(k.sum()))
                rare = [(x, k) for x, k in count.items() if x not in known]
                tails.append([x for x, _ in rare])
                times.append([k for _, k in rare])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([len(w) for w in words], pa.int64()),
                 pa.array(logs, pa.float64()), pa.array(sums, pa.float64()), pa.array(seen, pa.int64()),
                 pa.array(tails, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())),
                 pa.array([c for c, _ in rest], pa.list_(pa.int64())), pa.array([n for _, n in rest], pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "n_tokens", "score", "_sum", "_seen", "_words", "_times", "_codes", "_counts"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    scored = scratch.save(
        rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, score double, _sum double, _seen bigint, "
                        "_words array<binary>, _times array<bigint>, _codes array<bigint>, _counts array<bigint>").withColumn("_row", F.monotonically_increasing_id()), "scored",
    )
    tail = scored.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("_t")).select(
        "_row", F.col("_t._words").alias("word"), F.col("_t._times").alias("_k")
    ).join(vocabulary.where(~in_head), "word").groupBy("_row").agg(
        F.sum(F.log10(F.col("n") + 1) * F.col("_k")).alias("_more"), F.sum("_k").alias("_found")
    )
    if tail_states.isEmpty():
        more = scored.select("_row", F.lit(0.0).alias("_deep")).limit(0)
    else:
        windows = scored.select("_row", F.explode(F.arrays_zip("_codes", "_counts")).alias("_c")).select("_row", "_c._codes", "_c._counts").toDF("_row", "code", "_n")
        more = windows.join(by_table(windows, tree, tail_states), "code").groupBy("_row").agg(F.sum(F.col("log_p") * F.col("_n")).alias("_deep"))
    zero = F.lit(0)
    return scored.join(tail, "_row", "left").join(more, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("_seen") + F.coalesce("_found", zero)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("_sum") + F.coalesce("_more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("_deep", F.lit(0.0))).alias("score"),
    )
