"""N-gram Jaccard join with a token-group matrix.

1. Every text becomes its set of shingle hashes; equal sets are one node.
2. Nodes that cannot link are set aside: a node shares three quarters of its tokens with each partner, so one
   with too many tokens of its own has none.  To find them, every node sends its tokens under a fixed share
   of all hashes (short sets send all) to buckets that see each token's nodes together; only tokens that
   several nodes hold are reported back.
3. The others are partitioned into groups.  Nodes that share minimum hashes and link to a common centre get one
   label; large labels are groups, nodes of small ones are put together by minimum hash until a group has
   about ``group_nodes`` of them.
4. The matrix (token, group) is held in buckets of tokens.  For every node and group the cells under the
   node's tokens are counted; with the tokens that were left out this bounds its overlap with any member.
   Left out are tokens in more than ``wide`` groups.  A node that holds so many of them that the bound
   says nothing takes part in another round, with such nodes alone and a larger ``wide``.
5. Groups whose bound allows a link are opened: the node's tokens are held against those of the members.  Large
   groups are kept in chunks, and the questions to a group are dealt to parts, so no task grows with a group.
6. Links join labels into components.

Links are symmetric, so of two groups the smaller one asks.  Inside a label nothing needs to be asked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small, trim
from .components import connected_components
from .shingles import column_sets, mix64


@dataclass(frozen=True)
class JoinParams:
    """Link: ``100 * |intersection| >= percent * |union|``.  ``share``: of all hashes, whose tokens sets of
    more than ``whole`` tokens send to be counted.  ``keys``: minimum hashes, of which ``equal`` must agree
    for two nodes to be tried as one label; the first ``meeting`` of them bring nodes together.
    ``group_nodes``: nodes in a group of the matrix; ``wide``: groups of a token that is left out of the first
    round, so a cell gives at most as many rows.  ``bucket_cells``, ``matrix_cells``, ``chunk_tokens``, ``part_tokens``: what one task holds of the sent tokens, of the matrix, of a group,
    and of the questions to it.  ``broadcast_rows``: most rows of two 16-byte columns that are sent to every
    task (32 MB); above that the planner shuffles.  None of these but ``percent`` changes the links."""

    percent: int = 75
    share: float = 0.4
    whole: int = 64
    keys: int = 16
    meeting: int = 6
    equal: int = 7
    group_nodes: int = 64
    wide: int = 12
    bucket_cells: int = 600_000
    matrix_cells: int = 1_500_000
    chunk_tokens: int = 100_000
    part_tokens: int = 1_000_000
    broadcast_rows: int = 1_000_000


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def short(sig: bytes) -> int:
    """62 bits of a signature: a node's number where rows are packed."""
    return int.from_bytes(sig[:8], "little") >> 2


def _under(tokens: np.ndarray, share: float) -> int:
    return int(np.searchsorted(tokens, np.uint64(int(share * (1 << 64)))))


def _sent(tokens: np.ndarray, p: JoinParams) -> int:
    """How many tokens (the least ones) a set sends.  Partners of a set up to ``whole`` send all of theirs."""
    return len(tokens) if len(tokens) * p.percent <= p.whole * 100 else _under(tokens, p.share)


def _counted(tokens: np.ndarray, p: JoinParams) -> int:
    """Of how many of them it is told whether other sets have them: all its partners send these as well."""
    return len(tokens) if len(tokens) <= p.whole else _under(tokens, p.share)


FACTS = "doc_id long, n long, sig binary, id long, sent long, counted long"


def facts(docs: DataFrame, p: JoinParams) -> DataFrame:
    """One row per document: set size, signature, number, and how many tokens it sends and has counted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trim()
            rows: dict[str, list] = {c: [] for c in ("n", "sig", "id", "sent", "counted")}
            for s in column_sets(b.column(1)):
                sig = signature(s)
                for c, v in zip(rows, (len(s), sig, short(sig), _sent(s, p), _counted(s, p)), strict=True):
                    rows[c].append(v)
            arrays = [pa.array(v, pa.binary() if c == "sig" else pa.int64()) for c, v in rows.items()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *arrays], names=["doc_id", *rows])

    return docs.select("doc_id", "text").mapInArrow(scan, FACTS)


_CELL = np.dtype([("token", "<u4"), ("id", "<u8")])  # a token's low bits in its bucket; the number, times two, plus whether it is counted
_CELLS = pa.schema([("bucket", pa.int64()), ("cells", pa.binary())])


def _dealt(token: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token and the bits that tell it from others there."""
    mixed = mix64(token)
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), mixed.astype(np.uint32)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, the starts of the buckets in it, and which they are."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    ordered = bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, int)
    return order, starts, ordered[starts]


def sent_cells(docs: DataFrame, p: JoinParams, buckets: int) -> DataFrame:
    """(bucket, cells): the tokens that sets send, each set once per batch."""

    def flush(held: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        token, cells = np.concatenate(held), np.empty(sum(map(len, held)), _CELL)
        bucket, cells["token"] = _dealt(token, buckets)
        cells["id"] = np.repeat(np.array(ids, np.uint64), [len(t) for t in held])
        del token
        order, starts, which = _by_bucket(bucket)
        return pa.RecordBatch.from_pydict({"bucket": which, "cells": [x.tobytes() for x in np.split(cells[order], starts[1:])]}, schema=_CELLS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trim()
            seen, held, ids, size = set(), [], [], 0
            for s in column_sets(b.column(0)):
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                counted, sent, number = _counted(s, p), _sent(s, p), short(sig) << 1
                for part, mark in ((s[:counted], 1), (s[counted:sent], 0)):
                    if len(part):
                        held.append(part.copy())
                        ids.append(number | mark)
                        size += len(part)
                if size >= 250_000:
                    yield flush(held, ids)
                    held, ids, size = [], [], 0
            if size:
                yield flush(held, ids)

    return docs.select("text").mapInArrow(scan, "bucket long, cells binary")


def shared_ids(cells: np.ndarray) -> np.ndarray:
    """The number of every counted cell whose token another set sends as well, once per cell.

    Tokens that agree in the bits that are kept here count as one: more is reported as shared, never less."""
    order = np.argsort(cells["token"], kind="stable")
    token = cells["token"][order]
    same = token[1:] == token[:-1]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    token, number = token[several], cells["id"][order[several]]
    order = np.lexsort((number, token))
    token, number = token[order], number[order]
    if not len(token):
        return np.empty(0, np.int64)
    run = np.concatenate(([True], token[1:] != token[:-1]))
    other = run | np.concatenate(([True], number[1:] >> np.uint64(1) != number[:-1] >> np.uint64(1)))
    sets = np.add.reduceat(other.astype(np.int64), np.flatnonzero(run))
    several = sets[np.cumsum(run) - 1] > 1
    return (number[several & (number & np.uint64(1) == 1)] >> np.uint64(1)).astype(np.int64)


def linkable(docs: DataFrame, nodes: DataFrame, p: JoinParams) -> DataFrame:
    """nodes (sig, id, rep, n, sent, counted) -> those that may have a partner."""
    total = int(nodes.agg(F.sum("sent")).first()[0] or 0)
    cells = sent_cells(docs.filter("doc_id is not null"), p, max(1, -(-total // p.bucket_cells)))

    def shared(t: pa.Table) -> pa.Table:
        joined = np.frombuffer(b"".join(x.as_py() for x in t.column("cells")), dtype=_CELL)
        del t
        out = pa.table({"id": pa.array(shared_ids(joined), pa.int64())})
        del joined
        trim()
        return out

    found = cells.groupBy("bucket").applyInArrow(shared, "id long").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    own = F.col("counted") - F.coalesce("shared", F.lit(0))
    return nodes.join(found, "id", "left").filter(own <= F.col("n") - least_shared(F.col("n"), p)).select("sig", "id", "rep", "n")


def least_shared(n: Column, p: JoinParams) -> Column:
    """How many of its n tokens a set shares with a partner at least.  Cells are counted one by one, also where
    two tokens of a set agree in the bits that are kept, so no count falls short of it."""
    return F.ceil(n * p.percent / F.lit(100))


_SETS = pa.schema([("sig", pa.binary()), ("keys", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])


def token_sets(docs: DataFrame, nodes: DataFrame, p: JoinParams) -> DataFrame:
    """nodes (sig, id, rep, n) -> the same with minimum hashes and tokens.

    Rows that repeat a document repeat its node (once per batch at most), which does no harm below."""
    seeds = [np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & (1 << 64) - 1) for r in range(p.keys)]

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in found]))), pa.int32())
        values = pa.array(np.concatenate(found).view(np.int64), pa.int64())
        keys = [[int(mix64(s ^ seed).min().view(np.int64)) for seed in seeds] for s in found]
        return pa.RecordBatch.from_arrays([pa.array([signature(s) for s in found], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.ListArray.from_arrays(offsets, values)], schema=_SETS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[np.ndarray] = []
            seen, held = set(), 0
            for s in column_sets(b.column(0)):
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                found.append(s)
                held += len(s)
                if held >= 250_000:
                    yield batch(found)
                    found, held = [], 0
            if found:
                yield batch(found)

    wanted = materialize(nodes.select(F.col("rep").alias("doc_id")).distinct(), "join-wanted")
    sets = docs.join(small(wanted, p.broadcast_rows), "doc_id", "left_semi").select("text").mapInArrow(scan, "sig binary, keys array<long>, tokens array<long>")
    # A document with another text under a node's id has a signature that no node has, or another node's.
    written = materialize(sets.join(small(nodes, p.broadcast_rows), "sig").select("sig", "id", "rep", "n", "keys", "tokens"), "join-sets")
    release(wanted)
    return written


def linked(a: Column, b: Column, p: JoinParams) -> Column:
    """Whether two token arrays link."""
    both = F.size(F.array_intersect(a, b))
    return F.lit(100) * both >= F.lit(p.percent) * (F.size(a) + F.size(b) - both)


def star_labels(sets: DataFrame, p: JoinParams) -> DataFrame:
    """(sig, label) of the nodes that link to a centre: of the nodes that share a minimum hash, the one whose
    own minimum hashes are the most common."""
    nodes = materialize(sets.groupBy("sig").agg(F.first("keys").alias("keys")), "join-keys")
    keyed = nodes.select("sig", F.explode(F.slice("keys", 1, p.meeting)).alias("key"))
    common = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "join-common-keys")
    shared = materialize(keyed.join(small(common, p.broadcast_rows), "key"), "join-shared-keys")
    weight = materialize(shared.groupBy("sig").agg(F.sum("c").alias("w")), "join-weights")
    centre = shared.join(small(weight, p.broadcast_rows), "sig").groupBy("key").agg(F.max(F.struct("w", "sig")).alias("m"))
    centre = materialize(centre.select("key", F.col("m.sig").alias("first")), "join-centres")
    tried = shared.join(small(centre, p.broadcast_rows), "key").filter("sig <> first").select("sig", "first").distinct()
    tried = materialize(tried, "join-tried")
    tried_keys = tried.join(nodes, "sig").join(nodes.select(F.col("sig").alias("first"), F.col("keys").alias("first_keys")), "first")
    agree = F.size(F.filter(F.zip_with("keys", "first_keys", lambda x, y: x == y), lambda same: same))
    pairs = materialize(tried_keys.filter(agree >= p.equal).select("sig", "first"), "join-pairs")
    leads = materialize(pairs.select("first").distinct(), "join-leads")
    release(nodes, common, shared, weight, centre, tried)
    x = sets.select("sig", F.col("tokens").alias("x")).join(small(pairs, p.broadcast_rows), "sig")
    y = sets.select(F.col("sig").alias("first"), F.col("tokens").alias("y")).join(small(leads, p.broadcast_rows), "first", "left_semi")
    edges = materialize(x.join(y, "first").filter(linked(F.col("x"), F.col("y"), p)).select(F.col("sig").alias("a"), F.col("first").alias("b")), "join-star")
    labels = connected_components(edges).select(F.col("node").alias("sig"), "label")
    release(pairs, leads, edges)
    return labels


def grouping(sets: DataFrame, labels: DataFrame, p: JoinParams) -> DataFrame:
    """(sig, id, n, label, tag, group, members): the partition.  ``tag`` numbers labels; a label of
    ``group_nodes`` or more is a group, smaller ones are put together by their least minimum hash."""
    nodes = materialize(sets.groupBy("sig").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.first(F.get("keys", F.lit(0))).alias("key")), "join-alive")
    joined = nodes.join(small(labels, p.broadcast_rows), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    sizes = materialize(joined.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("home")), "join-label-sizes")
    few = sizes.filter(F.col("size") < p.group_nodes).agg(F.sum("size")).first()[0] or 0
    packed = F.pmod(F.xxhash64("home"), F.lit(max(1, -(-few // p.group_nodes))))
    grouped = sizes.select("label", F.when(F.col("size") < p.group_nodes, packed).otherwise(F.xxhash64("label")).alias("group"))
    grouped = materialize(joined.join(small(materialize(grouped, "join-label-groups"), p.broadcast_rows), "label"), "join-grouped")
    counts = materialize(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")), "join-groups")
    out = grouped.join(small(counts, p.broadcast_rows), "group").select("sig", "id", "n", "label", F.xxhash64("label").alias("tag"), "group", "members", "total")
    out = materialize(out, "join-partition")
    release(nodes, sizes, grouped, counts)
    return out


_HEAD = np.dtype([("id", "<i8"), ("tag", "<i8"), ("group", "<i8"), ("members", "<i8")])
_MATRIX = pa.schema([("bucket", pa.int64()), ("heads", pa.binary()), ("tokens", pa.binary()), ("at", pa.binary())])


def matrix_rows(sets: DataFrame, buckets: int) -> DataFrame:
    """(id, tag, group, members, tokens) -> the matrix, dealt by token: the heads of nodes, and tokens with
    the place of their node among the heads."""

    def flush(held: list[np.ndarray], heads: list[tuple]) -> pa.RecordBatch:
        head = np.array(heads, _HEAD)
        bucket, token = _dealt(np.concatenate(held), buckets)
        node = np.repeat(np.arange(len(held), dtype=np.uint32), [len(t) for t in held])
        order, starts, which = _by_bucket(bucket)
        token, node = token[order], node[order]
        rows: dict[str, list] = {"bucket": which.tolist(), "heads": [], "tokens": [], "at": []}
        for t, x in zip(np.split(token, starts[1:]), np.split(node, starts[1:]), strict=True):
            there, at = np.unique(x, return_inverse=True)
            rows["heads"].append(head[there].tobytes())
            rows["tokens"].append(t.tobytes())
            rows["at"].append(at.astype("<u4").tobytes())
        return pa.RecordBatch.from_pydict(rows, schema=_MATRIX)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heads, size = [], [], 0
        for b in batches:
            whole = zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)
            for head, tokens in zip(whole, b.column(4), strict=True):
                t = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
                held.append(t.copy())
                heads.append(head)
                size += len(t)
                if size >= 250_000:
                    yield flush(held, heads)
                    held, heads, size = [], [], 0
        if size:
            yield flush(held, heads)

    return sets.select("id", "tag", "group", "members", "tokens").mapInArrow(scan, "bucket long, heads binary, tokens binary, at binary")


def matrix_counts(heads: np.ndarray, token: np.ndarray, at: np.ndarray, wide: int) -> dict[str, np.ndarray]:
    """Cells of one bucket -> (id, group, cells, wide): how many of the node's tokens the group has besides it,
    for groups that the node's own one asks; and, with group -1, how many of its tokens are too wide.  A token
    that a node has twice, by the bits that are kept, counts twice."""
    order = np.argsort(token, kind="stable")
    token, at = token[order], at[order]
    same = token[1:] == token[:-1]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    token, at = token[several], at[several]
    # Places of groups by size, then number: of two groups the earlier one asks.
    _, group_of = np.unique(np.rec.fromarrays([heads["members"], heads["group"]]), return_inverse=True)
    _, tag_of = np.unique(heads["tag"], return_inverse=True)
    ids, id_of = np.unique(heads["id"], return_inverse=True)
    groups = np.empty(group_of.max(initial=-1) + 1, np.int64)
    groups[group_of] = heads["group"]
    node, group, tag = id_of[at], group_of[at], tag_of[at]
    order = np.lexsort((node, tag, group, token))
    token, node, group, tag = token[order], node[order], group[order], tag[order]
    if not len(token):
        return {c: np.empty(0, np.int64) for c in ("id", "group", "cells", "wide")}
    change = lambda *columns: np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))
    first = change(token, node, group, tag)
    times = np.diff(np.concatenate((np.flatnonzero(first), [len(token)])))
    token, node, group, tag = token[first], node[first], group[first], tag[first]
    cell_start = change(token, group)  # of the cells (token, group)
    cell = np.cumsum(cell_start) - 1
    label_start = change(token, group, tag)
    labels = np.bincount(cell, weights=label_start).astype(np.int64)
    cell_group, cell_token = group[cell_start], token[cell_start]
    run_start = np.flatnonzero(change(cell_token))
    run = np.repeat(np.arange(len(run_start)), np.diff(np.concatenate((run_start, [len(cell_token)]))))
    cells_in = np.bincount(run)
    run_end = np.cumsum(cells_in)
    too_wide = cells_in[run[cell]] > wide
    out = [np.stack([ids[u], np.full(len(u), -1), np.zeros(len(u), np.int64), c]) for u, c in [np.unique(np.repeat(node[too_wide], times[too_wide]), return_counts=True)]]
    # A cell's own group counts if another label has the token there.
    ask = np.repeat(np.flatnonzero(~too_wide), times[~too_wide])
    reach, end, keys, counts, step, held = cell[ask], run_end[run[cell[ask]]], [], [], 0, 0
    while len(ask):
        hit = (labels[reach] > 1) if step == 0 else np.ones(len(ask), bool)
        keys.append(node[ask[hit]].astype(np.int64) << 32 | cell_group[reach[hit]])
        held += len(keys[-1])
        if held > 1_000_000:
            keys, counts, held = _merged(keys, counts)
        step, reach = step + 1, reach + 1
        more = reach < end
        ask, reach, end = ask[more], reach[more], end[more]
    keys, counts, _ = _merged(keys, counts)
    if len(keys):
        key = keys[0]
        out.append(np.stack([ids[key >> 32], groups[key & 0xFFFFFFFF], counts[0], np.zeros(len(key), np.int64)]))
    found = np.concatenate(out, axis=1)
    return dict(zip(("id", "group", "cells", "wide"), found, strict=True))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list, list, int]:
    """Keys (the first already counted, if there are counts) as one list of distinct ones with counts."""
    if not keys:
        return [], [], 0
    done = len(counts[0]) if counts else 0
    every = np.concatenate(keys)
    weight = np.concatenate([counts[0], np.ones(len(every) - done, np.int64)]) if counts else np.ones(len(every), np.int64)
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    if not len(every):
        return [], [], 0
    at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return [every[at]], [np.add.reduceat(weight, at)], len(at)


def _counting(wide: int) -> Callable[[pa.Table], pa.Table]:
    def count(t: pa.Table) -> pa.Table:
        heads, tokens, at = (b"".join(x.as_py() for x in t.column(c)) for c in ("heads", "tokens", "at"))
        per = np.array([len(x.as_py()) // 4 for x in t.column("at")])
        before = np.cumsum([0] + [len(x.as_py()) // _HEAD.itemsize for x in t.column("heads")])[:-1]
        del t
        place = np.frombuffer(at, "<u4").astype(np.int64) + np.repeat(before, per)
        out = pa.table({k: pa.array(v, pa.int64()) for k, v in matrix_counts(np.frombuffer(heads, _HEAD), np.frombuffer(tokens, "<u4"), place, wide).items()})
        del heads, tokens, at, place
        trim()
        return out

    return count


def open_groups(sets: DataFrame, partition: DataFrame, p: JoinParams) -> DataFrame:
    """(id, group): the groups that each node must look into."""
    found, taking, wide = [], partition, p.wide
    fields = ["id", "tag", "group", "members"]
    while True:
        total = int(taking.agg(F.sum("n")).first()[0] or 0)
        rows = sets.select("sig", "tokens").join(small(materialize(taking.select("sig", *fields), "join-taking"), p.broadcast_rows), "sig")

        counted = matrix_rows(rows, max(1, -(-total // p.matrix_cells))).groupBy("bucket").applyInArrow(_counting(wide), "id long, group long, cells long, wide long")
        counted = materialize(counted.groupBy("id", "group").agg(F.sum("cells").alias("cells"), F.sum("wide").alias("wide")), "join-cells")
        left_out = materialize(counted.filter("group = -1").select("id", "wide"), "join-wide")
        need = materialize(taking.select("id", least_shared(F.col("n"), p).alias("need")), "join-need")
        reached = counted.filter("group <> -1").select("id", "group", "cells").join(small(left_out, p.broadcast_rows), "id", "left").join(small(need, p.broadcast_rows), "id")
        found.append(materialize(reached.filter(F.col("cells") + F.coalesce("wide", F.lit(0)) >= F.col("need")).select("id", "group"), "join-open"))
        rest = materialize(taking.join(small(left_out, p.broadcast_rows), "id").filter(F.col("wide") >= least_shared(F.col("n"), p)).select(partition.columns), "join-rest")
        release(counted, left_out, need)
        if rest.isEmpty():
            break
        taking, wide = rest, 4 * wide
    out = materialize(reduce(DataFrame.unionByName, found).distinct(), "join-opened")
    release(*found)
    return out


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column of token arrays as their sizes and one array of tokens."""
    sizes = [chunk.value_lengths().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    tokens = [chunk.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for chunk in column.chunks]
    return np.concatenate(sizes).astype(np.int64), np.concatenate(tokens)


def group_links(sizes: np.ndarray, tokens: np.ndarray, tags: np.ndarray, asked: np.ndarray, asked_tokens: np.ndarray, asked_tags: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (question, member) of different labels that link; one for each two labels."""
    order = np.argsort(tokens, kind="stable")
    token, owner = tokens[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    ends, found, done = np.concatenate(([0], np.cumsum(asked))), [], set()
    i = 0
    while i < len(asked):
        j, held = i, 0
        spans = []
        while j < len(asked) and (j == i or held < 1_000_000):
            t = asked_tokens[ends[j] : ends[j + 1]]
            lo, hi = np.searchsorted(token, t, "left"), np.searchsorted(token, t, "right")
            spans.append((lo, hi - lo))
            held += int((hi - lo).sum())
            j += 1
        lo, n = (np.concatenate(x) for x in zip(*spans, strict=True))
        question = np.repeat(np.arange(i, j), asked[i:j])
        place = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        pair, both = np.unique(np.repeat(question, n) * len(sizes) + owner[place], return_counts=True)
        q, m = pair // max(len(sizes), 1), pair % max(len(sizes), 1)
        ok = (100 * both >= percent * (asked[q] + sizes[m] - both)) & (asked_tags[q] != tags[m])
        for a, b in zip(q[ok].tolist(), m[ok].tolist(), strict=True):
            if (key := (asked_tags[a], tags[b])) not in done:
                done.add(key)
                found.append((a, b))
        i = j
    return found


def links_between(opened: DataFrame, sets: DataFrame, partition: DataFrame, p: JoinParams) -> DataFrame:
    """(id, group) of opened groups -> pairs (a, b) of labels that link."""
    asking = opened.join(small(materialize(partition.select("id", "n"), "join-asking"), p.broadcast_rows), "id")
    asked = asking.groupBy("group").agg(F.sum("n").alias("__asked"))
    totals = partition.groupBy("group").agg(F.first("total").alias("total"))
    cut = lambda c, most: F.ceil(F.col(c) / F.lit(most)).cast("long")
    plan = materialize(asked.join(totals, "group").select("group", cut("total", p.chunk_tokens).alias("chunks"), cut("__asked", p.part_tokens).alias("parts")), "join-plan")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = partition.select("sig", "label", "tag", "group").join(small(plan, p.broadcast_rows), "group")
    mine = materialize(mine.select("sig", "label", "tag", "group", F.pmod(F.xxhash64("sig"), F.col("chunks")).alias("chunk"), "parts"), "join-members")
    members = sets.select("sig", "tokens").join(small(mine, p.broadcast_rows), "sig").select("group", "chunk", every("parts").alias("part"), "label", "tag", "tokens")
    mine_too = materialize(
        opened.join(small(plan, p.broadcast_rows), "group").select("id", "group", "chunks", F.pmod(F.xxhash64("id", "group"), F.col("parts")).alias("part")), "join-questions"
    )
    tagged = sets.select("id", "sig", "tokens").join(small(materialize(partition.select("sig", "label", "tag"), "join-tags"), p.broadcast_rows), "sig").drop("sig")
    named = {c: F.col(c).alias(f"q_{c}") for c in ("group", "part", "label", "tag", "tokens")}
    questions = tagged.join(small(mine_too, p.broadcast_rows), "id").select(*named.values(), every("chunks").alias("q_chunk"))
    percent = p.percent

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"a": [], "b": []}
        if left.num_rows and right.num_rows:
            (sizes, tokens), (asked, words) = _flat(left.column("tokens")), _flat(right.column("q_tokens"))
            names, askers = left.column("label").to_pylist(), right.column("q_label").to_pylist()
            for q, m in group_links(sizes, tokens, left.column("tag").to_numpy(), asked, words, right.column("q_tag").to_numpy(), percent):
                out["a"].append(askers[q])
                out["b"].append(names[m])
            del tokens, words
            trim()
        return pa.table(out, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    found = members.groupBy("group", "chunk", "part").cogroup(questions.groupBy("q_group", "q_chunk", "q_part")).applyInArrow(search, "a binary, b binary")
    out = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-between")
    release(plan, mine, mine_too)
    return out


def jaccard_components(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, one row per input row.

    Texts are compared by their sets of distinct five-word shingles (a text of fewer words is one shingle),
    words being runs of anything but ASCII white space with A-Z lowered.  Texts without words, null
    ones included, link with nothing and are their own component; so are rows with a null id, whose
    component is null.  Repeated rows repeat; an empty table gives an empty result; columns besides doc_id
    and text are ignored.
    """
    p = params
    docs = docs.select("doc_id", "text")
    sized = materialize(facts(docs, p), "join-facts")
    usable = sized.filter("n > 0 and doc_id is not null")
    whole = materialize(usable.groupBy("sig").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("id", "n", "sent", "counted"))), "join-nodes")
    alive = materialize(linkable(docs, whole, p), "join-linkable")
    nodes = materialize(whole.select("sig", "rep"), "join-reps")
    release(whole)
    if alive.isEmpty():
        named = nodes.select("sig", F.col("rep").alias("component_id"))
    else:
        sets = token_sets(docs, alive, p)
        labels = materialize(star_labels(sets, p), "join-labels")
        partition = grouping(sets, labels, p)
        opened = open_groups(sets, partition, p)
        between = links_between(opened, sets, partition, p)
        joined = labels
        if not between.isEmpty():
            joined = connected_components(labels.select(F.col("sig").alias("a"), F.col("label").alias("b")).unionByName(between)).select(F.col("node").alias("sig"), "label")
        joined = nodes.join(small(materialize(joined, "join-joined"), p.broadcast_rows), "sig")
        least = materialize(joined.groupBy("label").agg(F.min("rep").alias("component_id")), "join-least")
        moved = materialize(joined.join(small(least, p.broadcast_rows), "label").select("sig", "component_id"), "join-moved")
        release(sets, labels, partition, opened, between, least)
        named = nodes.join(small(moved, p.broadcast_rows), "sig", "left").select("sig", F.coalesce("component_id", "rep").alias("component_id"))
    component = materialize(named, "join-components")
    release(alive, nodes)
    out = sized.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("sig")).alias("sig"))
    return out.join(component, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, params: JoinParams = JoinParams(), kept_broadcast: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near copies: of each component the row with the least
    doc_id stays (null ids last, then by a hash of the row), and of equal rows one.  Rows with a null id take
    part; texts without words are no copies of anything, but equal rows without words are.  Texts move only where
    whole rows repeat.  ``kept_broadcast``: most 8-byte keys that are sent to every task; above that the
    planner shuffles."""
    key, check = F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)
    rows = materialize(docs.select(key.alias("__key"), F.col("doc_id").alias("__id")).groupBy("__key").agg(F.min("__id").alias("__id"), F.count(F.lit(1)).alias("__n")), "kept-rows")
    found = jaccard_components(docs.select(key.alias("doc_id"), "text"), params)
    found = materialize(found.select(F.col("doc_id").alias("__key"), "component_id").distinct(), "kept-components")
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__key", "__n")).alias("first")
    chosen = materialize(found.join(rows, "__key").groupBy("component_id").agg(first).select("first.__key", (F.col("first.__n") > 1).alias("__again")), "kept-keys")
    release(rows, found)
    kept = docs.withColumn("__key", key).join(small(chosen, kept_broadcast), "__key")
    again = kept.filter("__again").withColumn("__check", check).dropDuplicates(["__key", "__check"])
    return kept.filter("not __again").select(*docs.columns).unionByName(again.select(*docs.columns))
