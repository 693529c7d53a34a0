"""Depth and pre-order of the nodes of many trees inside one task, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

GROUP, NODE, PARENT, ORDER, SIZE = "trace_id", "span_id", "__parent", "__order", "__size"


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    heads = np.ones(len(values), bool)
    heads[1:] = values[1:] != values[:-1]
    return heads


def places(group: np.ndarray, node: np.ndarray, parent: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth and position in the pre-order of its group for every row, and whether it has any.

    ``group`` are ascending numbers from 0, ``node`` and ``parent`` texts ("" is no parent).  Rows of one node are one,
    its least by (order, parent).  A walk enters every node and leaves those with children: a list of steps, which is
    ranked by doubling.  Nodes without a text, and those on or below a cycle, have no place.
    """
    codes, texts = pd.factorize(np.concatenate([node, parent]), sort=True)
    own, above = codes[: len(node)].astype("int64"), codes[len(node) :]
    key = group * (len(texts) + 1) + own
    rows = np.lexsort((above, order, key))
    rows = rows[own[rows] >= 0]
    nodes = rows[_heads(key[rows])]
    keys, n = key[nodes], len(nodes)
    depth, position, known = np.zeros(len(node), "int64"), np.zeros(len(node), "int64"), np.zeros(len(node), bool)
    if not n:
        return depth, position, known
    wanted = group[nodes] * (len(texts) + 1) + above[nodes]
    at = np.minimum(np.searchsorted(keys, wanted), n - 1)
    below = (keys[at] == wanted) & (wanted != keys) & (parent[nodes] != "")
    # Tops are the children of their group.
    family = np.where(below, at, n + group[nodes])
    line = np.lexsort((own[nodes], order[nodes], family))
    heads = _heads(family[line])
    end = 2 * n
    sibling, child = np.full(n, -1), np.full(n, -1)
    sibling[line[:-1][~heads[1:]]] = line[1:][~heads[1:]]
    eldest = line[heads]
    eldest = eldest[below[eldest]]
    child[family[eldest]] = eldest
    onwards = np.where(sibling >= 0, sibling, np.where(below, n + at, end))
    then = np.concatenate([np.where(child >= 0, child, onwards), onwards, [end]])
    entered = np.concatenate([np.ones(n, "int64"), np.zeros(n + 1, "int64")])
    climbed = np.concatenate([np.where(child >= 0, -1, 0), np.ones(n, "int64"), [0]])
    # Every round doubles how far a step looks ahead; steps of a cycle never see the end.
    for _ in range(int(end).bit_length()):
        if (then == end).all():
            break
        entered, climbed, then = entered + entered[then], climbed + climbed[then], then[then]
    done = then[:n] == end
    first = np.flatnonzero(_heads(group[nodes]))
    spans = np.maximum.reduceat(np.where(done, entered[:n], 0), first)
    place = np.repeat(spans, np.diff(np.append(first, n))) - entered[:n]
    of = np.minimum(np.searchsorted(keys, key), n - 1)
    known = (own >= 0) & done[of]
    return np.where(known, climbed[:n][of], 0), np.where(known, place[of], 0), known


def _placed(table: pa.Table) -> pa.Table:
    texts = lambda name: table[name].to_pandas().to_numpy(object)
    group = table[GROUP].combine_chunks().dictionary_encode()
    group = (group.combine_chunks() if isinstance(group, pa.ChunkedArray) else group).indices.to_numpy().astype("int64")
    counted, told = np.bincount(group), table[SIZE].to_numpy()
    if (counted[group] != told).any():
        raise RuntimeError("the rows of a trace are not together")
    depth, position, known = places(group, texts(NODE), texts(PARENT), table[ORDER].to_numpy())
    kept = table.drop_columns([PARENT, ORDER, SIZE])
    for name, values in (("depth", depth), ("position", position)):
        kept = kept.append_column(name, pa.array(values, pa.int64(), mask=~known))
    return kept


def place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows with the groups together: the columns that describe the tree give way to depth and position."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch[GROUP][0] == batch[GROUP][-1] == held[0][GROUP][0]:
            continue
        table = pa.Table.from_batches(held)
        # The last group may go on in the next batch.
        cut = pc.index(table[GROUP], table[GROUP][-1]).as_py()
        yield from _placed(table.slice(0, cut)).to_batches()
        held = table.slice(cut).to_batches()
    if held:
        yield from _placed(pa.Table.from_batches(held)).to_batches()
