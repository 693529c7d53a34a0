"""A word bigram model by deleted interpolation.

P(w | v) = a[b] c(v w) / c(v) + u[b] c(w) / N + z[b] / (V + 1), where b is the context's frequency bucket (the
bit length of c(v)).  The weights of every bucket come from expectation-maximisation on deleted counts: one
share of the training documents (``DELETED``) is taken out of the counts and predicted from the rest.  The
final model counts all training documents.

All documents are counted, and every distinct word and bigram keeps its count: nothing is pruned or sampled.
Joining every token with its count would shuffle the corpus twice over, so documents are handled in batches:

1. a batch reduces its tokens to sorted distinct 64-bit keys with counts, cut into packets by key range;
2. packets of one range meet, their counts are added, and every packet gets the totals of its keys back in
   the order in which it sent them (a frequent key comes once per batch, not once per occurrence);
3. a batch meets its totals and scores its documents.

A batch is known by partition, role and running number; its documents travel compressed to step 3, where
the keys are made again and have to number as many as the totals.  The input must therefore be read the same
way twice, as stored tables are.  Keys are hashes: two of n different words or bigrams collide with a
probability of n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.base import joined, mix, pieces, remainder, stored, word_hashes

HELD_OUT, DELETED, KEPT = 0, 1, 2
#: Characters of a batch; a longer document is a batch of its own.
BATCH = 6_000_000
END, BEGIN = np.uint64(0xE4D0000000000001), np.uint64(0xB0500000000000B1)
UNIGRAM, BIGRAM = 0, 1
#: Key ranges per shuffle partition: a range's packets from all batches are in memory together.
PARTS = 4
#: Steps per factor of two in which probabilities are told apart for expectation-maximisation only.
STEPS = 8
NONE = -(10**6)
BUCKETS = 64


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words, and how many each text has."""
    out, sizes = [], []
    for start, end in pieces(texts):
        data, begins = joined(texts[start:end])
        places, hashes = word_hashes(data)
        cuts = np.searchsorted(places, begins[1:])
        each = np.diff(np.concatenate([[0], cuts, [len(hashes)]]))
        out.append(np.insert(hashes, np.append(cuts, len(hashes)), END))
        sizes.append(each + 1)
    return np.concatenate(out), np.concatenate(sizes)


def grams(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of every token (the word before or the begin mark) and the key of the pair."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = BEGIN
    with np.errstate(over="ignore"):
        return before, mix(before * np.uint64(0x9E3779B97F4A7C15) + words)


def batches(docs: Iterator[pa.RecordBatch], partition: int) -> Iterator[tuple[int, int, list, list[str]]]:
    """(batch id, role, document ids, texts)."""
    open_: dict[int, tuple[list, list[str], int]] = {}
    number = dict.fromkeys((HELD_OUT, DELETED, KEPT), 0)

    def closed(role: int) -> tuple[int, int, list, list[str]]:
        ids, texts, _ = open_.pop(role)
        number[role] += 1
        return (partition << 24) + (role << 22) + number[role] - 1, role, ids, texts

    for part in docs:
        columns = (part.column(n).to_pylist() for n in ("doc_id", "text", "role"))
        for doc_id, text, role in zip(*columns):
            text = text or ""
            if role in open_ and open_[role][2] + len(text) > BATCH:
                yield closed(role)
            ids, texts, size = open_.get(role, ([], [], 0))
            ids.append(doc_id)
            texts.append(text)
            open_[role] = (ids, texts, size + len(text))
    for role in sorted(open_):
        yield closed(role)


def planes(numbers: np.ndarray) -> bytes:
    """64-bit integers as eight planes of bytes: high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def key_sets(words: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Tokens with the begin mark of every text, and pairs."""
    return [np.concatenate([words, np.full(len(sizes), BEGIN, np.uint64)]), grams(words, sizes)[1]]


PACKETS = "batch long, role int, kind int, part int, keys binary, counts binary"
TOTALS = "batch long, role int, kind int, part int, total binary, deleted binary, n_tokens long, n_types long, n_deleted long, n_texts long"
PAYLOAD = "batch long, role int, ids array<bigint>, sizes array<int>, body binary"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _arrow(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [tuple(f.split(" ", 1)) for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _packets(parts: int):
    def make(docs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        for batch, role, _, texts in batches(docs, TaskContext.get().partitionId()):
            words, sizes = tokens(texts)
            rows = []
            for kind, all_keys in enumerate(key_sets(words, sizes)):
                keys, counts = np.unique(all_keys, return_counts=True)
                cuts = [0, *np.searchsorted(keys, edges), len(keys)]
                for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if b > a:
                        steps = np.diff(keys[a:b], prepend=np.uint64(0))
                        rows.append((batch, role, kind, part, planes(steps), planes(counts[a:b])))
            yield _arrow(PACKETS, rows)

    return make


def _totals(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    rows.sort(key=lambda r: r["batch"])
    keys = [np.cumsum(unplaned(r["keys"]), dtype=np.uint64) for r in rows]
    counts = [unplaned(r["counts"]) for r in rows]
    names, at = np.unique(np.concatenate(keys), return_inverse=True)
    total, deleted = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    ends = np.cumsum([0, *map(len, keys)])
    for r, c, a, b in zip(rows, counts, ends, ends[1:]):
        if r["role"] != HELD_OUT:
            total[at[a:b]] += c.astype(np.int64)
        if r["role"] == DELETED:
            deleted[at[a:b]] += c.astype(np.int64)
    out = []
    for r, a, b in zip(rows, ends, ends[1:]):
        own = planes(deleted[at[a:b]]) if r["role"] == DELETED else b""
        out.append((r["batch"], r["role"], r["kind"], r["part"], planes(total[at[a:b]]), own, 0, 0, 0, 0))
    if rows[0]["kind"] == UNIGRAM:
        word = names != BEGIN
        texts = int(total[~word].sum())
        out.append((-1, KEPT, UNIGRAM, rows[0]["part"], b"", b"", int(total[word].sum()), int((total[word] > 0).sum()), int(deleted[word].sum()), texts))
    return pa.Table.from_batches([_arrow(TOTALS, out)])


def _payload(docs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    squeeze = zstandard.ZstdCompressor(level=1)
    for batch, role, ids, texts in batches(docs, TaskContext.get().partitionId()):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        yield _arrow(PAYLOAD, [(batch, role, ids, [len(r) for r in raw], squeeze.compress(b"".join(raw)))])


@dataclass(frozen=True)
class Counted:
    """The tokens of one batch and, for each, the counts of its pair, its context and itself."""

    ids: list
    sizes: np.ndarray
    pair: np.ndarray
    context: np.ndarray
    word: np.ndarray


def _counted(payload: pa.Table, totals: pa.Table, kept: bool) -> Counted:
    """With kept, counts are those of the kept training documents, else of all."""
    row = payload.to_pylist()[0]
    raw = zstandard.ZstdDecompressor().decompress(row["body"])
    edges = np.cumsum([0, *row["sizes"]])
    words, sizes = tokens([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(edges, edges[1:])])
    before, pairs = grams(words, sizes)
    back: dict[int, np.ndarray] = {}
    for kind in (UNIGRAM, BIGRAM):
        own = sorted((r for r in totals.to_pylist() if r["kind"] == kind), key=lambda r: r["part"])
        counts = [unplaned(r["total"]).astype(np.int64) for r in own]
        if kept:
            counts = [c - unplaned(r["deleted"]).astype(np.int64) for c, r in zip(counts, own)]
        back[kind] = np.concatenate(counts)
    unigrams, bigrams = key_sets(words, sizes)
    names = np.unique(unigrams)
    pair_names, pair_at = np.unique(bigrams, return_inverse=True)
    if len(names) != len(back[UNIGRAM]) or len(pair_names) != len(back[BIGRAM]):
        raise ValueError("the documents were read in another order than before; pass a stored table")
    find = lambda keys: back[UNIGRAM][np.searchsorted(names, keys)]
    return Counted(row["ids"], sizes, back[BIGRAM][pair_at], find(before), find(words))


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else the bit length of its count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(int) + 1, 0)


def _histogram(n_kept: int):
    def make(payload: pa.Table, totals: pa.Table) -> pa.Table:
        schema = "b long, q2 long, q1 long, n long"
        if not payload.num_rows:
            return pa.Table.from_batches([_arrow(schema, [])])
        c = _counted(payload, totals, kept=True)
        level = lambda a, b: np.where(a > 0, np.round(STEPS * np.log2(np.maximum(a, 1) / np.maximum(b, 1))), NONE).astype(np.int64)
        cells = np.stack([bucket(c.context), level(c.pair, c.context), level(c.word, max(n_kept, 1))], axis=1)
        values, n = np.unique(cells, axis=0, return_counts=True)
        return pa.Table.from_batches([_arrow(schema, [(*map(int, v), int(k)) for v, k in zip(values, n)])])

    return make


def maximise(cells: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of every bucket by expectation-maximisation.

    cells has bucket, level of the bigram and of the unigram estimate; n how many deleted tokens fell there.  A
    bucket without any takes the weights of the next lower one.
    """
    weights = np.zeros((BUCKETS, 3))
    p = np.zeros((len(n), 3))
    if len(n):
        for column in (1, 2):
            p[:, column - 1] = np.where(cells[:, column] > NONE, np.exp2(np.maximum(cells[:, column], NONE / 100) / STEPS), 0.0)
        p[:, 2] = uniform
    last = np.array([0.0, 0.5, 0.5])
    for b in range(BUCKETS):
        own = cells[:, 0] == b if len(n) else np.zeros(0, bool)
        if own.any():
            w = np.array([0.4, 0.4, 0.2])
            for _ in range(rounds):
                share = p[own] * w
                share /= share.sum(1, keepdims=True)
                new = (share * n[own, None]).sum(0) / n[own].sum()
                done = np.abs(new - w).max() < 1e-8
                w = new
                if done:
                    break
            w = np.maximum(w, [0.0, 0.0, 1e-6])
            last = w / w.sum()
        weights[b] = last
    return weights


def _scores(weights: np.ndarray, n: int, v: int):
    def make(payload: pa.Table, totals: pa.Table) -> pa.Table:
        if not payload.num_rows:
            return pa.Table.from_batches([_arrow(SCORES, [])])
        c = _counted(payload, totals, kept=False)
        w = weights[bucket(c.context)]
        p = w[:, 0] * c.pair / np.maximum(c.context, 1) + w[:, 1] * c.word / max(n, 1) + w[:, 2] / (v + 1)
        base = np.log10((c.word + 1) / (n + (v + 1)))
        starts = np.concatenate([[0], np.cumsum(c.sizes)[:-1]])
        add = lambda x: np.add.reduceat(x, starts).tolist()
        rows = list(zip(c.ids, c.sizes.tolist(), add((c.word > 0).astype(np.int64)), add(base), add(np.log10(p))))
        return pa.Table.from_batches([_arrow(SCORES, rows)])

    return make


def score_documents(docs: DataFrame, divisor: int = 7, held_out: int = 2, deleted: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document row.

    Documents whose crc32 remainder is ``held_out`` teach nothing; those with ``deleted`` set the weights.  Null
    texts count as empty: their only token is the end.  A null id counts as the empty text for the
    remainder and stays null.  Repeated rows count and are scored as often as they occur.  An empty table
    gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    role = remainder(F.col(doc_id), divisor)
    role = F.when(role == held_out, HELD_OUT).when(role == deleted, DELETED).otherwise(KEPT)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), role.cast("int").alias("role"))
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packets = rows.mapInArrow(_packets(parts), PACKETS)
    totals = stored(packets.groupBy("kind", "part").applyInArrow(_totals, TOTALS), "totals")
    sizes = totals.where("batch = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_types", "n_deleted")]).first()
    n, v = sizes["n_tokens"], sizes["n_types"]
    payload = rows.mapInArrow(_payload, PAYLOAD)
    back = totals.where("batch >= 0").select("batch", "role", "kind", "part", "total", "deleted")

    def together(only: int | None) -> tuple:
        left = rows.where(F.col("role") == only).mapInArrow(_payload, PAYLOAD) if only is not None else payload
        right = back.where(F.col("role") == only) if only is not None else back
        return left.groupBy("batch").cogroup(right.groupBy("batch"))

    cells = together(DELETED).applyInArrow(_histogram(n - sizes["n_deleted"]), "b long, q2 long, q1 long, n long")
    cells = cells.groupBy("b", "q2", "q1").agg(F.sum("n").alias("n")).collect()  # bounded by the levels, not the corpus
    weights = maximise(np.array([(c["b"], c["q2"], c["q1"]) for c in cells]), np.array([c["n"] for c in cells], float), 1 / (v + 1))
    scored = together(None).applyInArrow(_scores(weights, n, v), SCORES)
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
