"""Exact dedup by Patricia-trie owners.

Rows go to partitions by (byte length, content hash). Each partition inserts whole byte strings into compressed
radix tries, one under each (length, hash); a terminal node holds the row with the smallest identifier, so two
texts share an owner only when all their bytes agree, whatever their hashes do. Copies that one scan batch holds
are folded before the shuffle, so a text with a billion copies sends one row a batch. A partition whose rows
outgrow ``spill_bytes`` writes its largest subtree to the shared folder and resolves it afterwards, alone, split
by the next bits of its hash.

No node keeps the identifiers of all its copies: beyond ``CHUNK`` of them they leave the task under the node's number, and meet
the owner of that number in a join, so neither a row nor a task grows with a text's copies. ``drop_exact`` carries none.

Defined results: a null text equals nothing, not even another null (its row owns itself); the empty text is a
text like any other; a null identifier yields to any other as owner; rows that repeat an identifier and a text
count as copies, of which the one with the least remaining columns stays; an empty table gives no rows. Identifiers are
integers; a column of another type that doesn't cast to one raises.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, filesystem, named, shared_dir, stored

SPILL_BYTES = 96 << 20
FANOUT, CHUNK = 16, 8192


class Node:
    """Edge label from the parent, children by first byte, and the owner if a string ends here."""

    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes, owner=None):
        self.label, self.owner, self.children = label, owner, None


class Trie:
    """Compressed radix trie over byte strings; ``insert`` returns the terminal node."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes) -> Node:
        node, at, end = self.root, 0, len(key)
        while at < end:
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:] if at else key)
                return child
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _shared(label, key, at)
            upper = Node(label[:same])
            upper.children = {label[same]: child}
            child.label = label[same:]
            node.children[key[at]] = upper
            node, at = upper, at + same
        return node


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:], by bisection."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def _before(x, y, row_of) -> bool:
    """Whether (id, place) x owns rather than y: non-null ids first, then the least id, then the other columns."""
    if x[0] != y[0]:
        return y[0] is None or (x[0] is not None and x[0] < y[0])
    return repr(row_of(x[1])) < repr(row_of(y[1]))


def _fold(id_i: int, text_i: int, ids_i: int, with_ids: bool):
    """Folds the copies within each Arrow batch: one row a text, with the identifiers of all where they are wanted."""

    def run(batches):
        for batch in batches:
            ids = batch.column(id_i).to_pylist()
            texts = batch.column(text_i).cast(pa.binary()).to_pylist()
            row_of = lambda i, b=batch: b.slice(i, 1).to_pylist()
            groups: dict[bytes, int] = {}
            first, members = [], []
            for i, t in enumerate(texts):
                g = len(first) if t is None else groups.setdefault(t, len(first))
                if g == len(first):
                    first.append((ids[i], i))
                    members.append([ids[i]])
                else:
                    members[g].append(ids[i])
                    if _before((ids[i], i), first[g], row_of):
                        first[g] = (ids[i], i)
            out = batch if len(first) == len(texts) else batch.take(pa.array([i for _, i in first], pa.int64()))
            if with_ids:
                out = out.set_column(ids_i, batch.schema.field(ids_i), pa.array(members, pa.list_(pa.int64())))
            yield out

    return run


class _Subtree:
    __slots__ = ("batches", "bytes", "file", "tries")

    def __init__(self):
        self.tries, self.batches, self.bytes, self.file = {}, [], 0, None


class _Spill:
    """Arrow streams in the shared folder, one for a spilled subtree; gone when the task is done with them."""

    def __init__(self, folder: str):
        self.fs, base = filesystem(folder)
        self.base = f"{base}/weft-trie-{uuid.uuid4().hex}"
        self.made = False

    def open(self, schema):
        if not self.made:
            self.fs.create_dir(self.base, recursive=True)
            self.made = True
        path = f"{self.base}/{uuid.uuid4().hex}"
        out = self.fs.open_output_stream(path)
        return path, out, pa.ipc.new_stream(out, schema)

    def read(self, path):
        with self.fs.open_input_stream(path) as f, pa.ipc.open_stream(f) as s:
            yield from s
        self.fs.delete_file(path)

    def close(self):
        if self.made:
            self.fs.delete_dir(self.base)


def _finished_rows(out: pa.RecordBatch, at: tuple) -> pa.RecordBatch:
    return out


def _members(ids, lists, terms, closed: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, lists, terms, [closed] * len(lists)), kinds)], names=["owner", "ids", "term", "closed"])


def _finished_members(out: pa.RecordBatch, at: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([out.column(at[0]), out.column(at[3]), out.column(at[4]), pa.array([True] * out.num_rows)], names=["owner", "ids", "term", "closed"])


def _resolve(at: tuple, folder: str, limit: int, with_ids: bool, chunk: int):
    """Owners of a partition's rows: their rows or, with identifiers, (owner, ids, term, closed): a row that isn't closed
    has more copies of the text whose closed row has the same term."""
    id_i, text_i, hash_i, ids_i, term_i = at
    finished = _finished_members if with_ids else _finished_rows

    def level(batches, depth, spill):
        subs: dict[int, _Subtree] = {}
        held = 0
        schema = None
        for batch in batches:
            schema = batch.schema
            texts = batch.column(text_i)
            if texts.null_count:
                yield finished(batch.filter(texts.is_null()), at)
                batch = batch.filter(texts.is_valid())
            hashes = batch.column(hash_i).to_pylist()
            parts: dict[int, list[int]] = {}
            for i, h in enumerate(hashes):
                # past the last bits of the hash a subtree is one hash's: it can't be split further, nor need it be
                parts.setdefault((h >> max(0, 60 - 4 * depth)) % FANOUT, []).append(i)
            for p, rows in parts.items():
                sub = subs.setdefault(p, _Subtree())
                piece = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows, pa.int64()))
                if sub.file:
                    sub.file[2].write_batch(piece)
                    continue
                grown = piece.nbytes
                yield from _insert(sub, piece)
                sub.bytes += grown
                held += grown
            while held > limit and depth < 16:
                big = max((s for s in subs.values() if not s.file), key=lambda s: s.bytes)
                big.file = spill.open(schema)
                for x in _owners(big):
                    big.file[2].write_batch(x)
                held -= big.bytes
                big.tries, big.batches, big.bytes = {}, [], 0
        for sub in subs.values():
            if not sub.file:
                for x in _owners(sub):
                    yield finished(x, at)
                sub.tries, sub.batches = {}, []
        for sub in subs.values():
            if sub.file:
                path, out, stream = sub.file
                stream.close()
                out.close()
                yield from level(spill.read(path), depth + 1, spill)

    def _insert(sub, piece):
        """Nodes hold (identifier, place), the identifiers of copies and the node's number if some have left."""
        b = len(sub.batches)
        sub.batches.append(piece)
        ids, hashes = piece.column(id_i).to_pylist(), piece.column(hash_i).to_pylist()
        texts = piece.column(text_i).cast(pa.binary()).to_pylist()
        copies, terms = piece.column(ids_i).to_pylist(), piece.column(term_i).to_pylist()
        row_of = lambda at: sub.batches[at[0]].slice(at[1], 1).to_pylist()
        for i, t in enumerate(texts):
            node = sub.tries.setdefault((len(t), hashes[i]), Trie()).insert(t)
            mine = (ids[i], (b, i))
            own = node.owner
            if own is None:
                own = node.owner = [mine, [], None]
            elif _before(mine, own[0], row_of):
                own[0] = mine
            if with_ids:
                own[1].extend(copies[i])
                own[2] = terms[i] if own[2] is None else own[2]
                if len(own[1]) > chunk:
                    own[2] = uuid.uuid4().int >> 65 if own[2] is None else own[2]
                    yield _members([None], [own[1]], [own[2]], False)
                    own[1] = []

    def _owners(sub):
        chosen: dict[int, list] = {}
        for trie in sub.tries.values():
            todo = [trie.root]
            while todo:
                node = todo.pop()
                if node.owner:
                    (_, (b, i)), copies, term = node.owner
                    chosen.setdefault(b, []).append((i, copies, term))
                if node.children:
                    todo.extend(node.children.values())
        for b, rows in chosen.items():
            out = sub.batches[b].take(pa.array([r[0] for r in rows], pa.int64()))
            if with_ids:
                out = out.set_column(ids_i, out.schema.field(ids_i), pa.array([r[1] for r in rows], pa.list_(pa.int64())))
                out = out.set_column(term_i, out.schema.field(term_i), pa.array([r[2] for r in rows], pa.int64()))
            yield out

    def run(batches):
        spill = _Spill(folder)
        try:
            yield from level(batches, 0, spill)
        finally:
            spill.close()

    return run


def _owner_rows(df: DataFrame, id_col: str, text_col: str, spill_bytes: int, with_ids: bool, chunk: int = CHUNK, hash_expr=None) -> DataFrame:
    n, h, ids, term = named(df, "bytes", "hash", "ids", "term")
    content = F.xxhash64(col(text_col)) if hash_expr is None else hash_expr
    keyed = df.withColumns(
        {
            n: F.octet_length(col(text_col)),
            # rows without a text meet no other; those without an identifier either are spread by their scan partition
            h: F.when(col(text_col).isNull(), F.xxhash64(col(id_col), F.spark_partition_id())).otherwise(content),
            ids: F.lit(None).cast("array<long>"),
            term: F.when(col(text_col).isNull(), F.lit(None).cast("long")),
        }
    ).withColumn(id_col, col(id_col).cast("long"))
    if with_ids:
        keyed = keyed.withColumn(ids, F.when(col(text_col).isNull(), F.array(col(id_col))))
    names = keyed.columns
    at = tuple(names.index(x) for x in (id_col, text_col, h, ids, term))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in keyed.schema])
    parted = keyed.mapInArrow(_fold(at[0], at[1], at[3], with_ids), schema).repartition(col(n), col(h))
    out = "owner long, ids array<long>, term long, closed boolean" if with_ids else schema
    return parted.mapInArrow(_resolve(at, shared_dir(df.sparkSession), spill_bytes, with_ids, chunk), out)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spill_bytes: int = SPILL_BYTES, chunk: int = CHUNK, hash_expr=None) -> DataFrame:
    """(doc_id, owner_id) for every row of ``df``: the owner is the smallest identifier with the same text.

    See the module for nulls, ties and empty texts; an empty table gives no rows.
    """
    slim = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    rows = stored(_owner_rows(slim, "doc_id", "text", spill_bytes, True, chunk, hash_expr), "owners")
    here = rows.where("closed").select(F.explode("ids").alias("doc_id"), F.col("owner").alias("owner_id"))
    owner = rows.where("closed and term is not null").select("term", F.col("owner").alias("owner_id"))
    left = rows.where("not closed").select("term", F.explode("ids").alias("doc_id")).join(owner, "term").select("doc_id", "owner_id")
    return here.unionByName(left)


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """The owners' rows of ``df``, in its own columns: one row for each distinct text, and every row without a text."""
    kind = df.schema[id_col].dataType
    owners = _owner_rows(df, id_col, text_col, spill_bytes, False)
    return owners.select(*[col(c).cast(kind).alias(c) if c == id_col else col(c) for c in df.columns])
