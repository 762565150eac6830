"""HTML extraction by host suffix arrays: what repeats between pages of a host is boilerplate and goes.

A task concatenates the visible tokens of the pages of whole hosts, numbers them by a dictionary, and sorts the
suffixes to the depth of ``min_tokens`` by prefix doubling: further tokens can't change what is covered. Suffixes that
stand next to each other with ``min_tokens`` common tokens, in one host and distinct pages, are long repeated
substrings; every token under one is boilerplate, the unique runs between stay. Tokens are compared as such, within a
host.

Hosts of more than ``host_bytes`` of pages aren't brought together. Each scan task sorts its own pieces of them, of at
most ``piece_tokens``, and an exchange completes the pieces: each sends a 48-bit rank of each distinct window of
``min_tokens``, salted by host, sorted, as differences - about four bytes a token. Shards of ranks answer the pieces
with the ranks that several have and that one of them hasn't found repeated by itself. The windows so named are
confirmed by a 128-bit digest of host and tokens; those that only chance brought together stay. What is sent and
answered goes by shuffle. The hosts above ``host_bytes`` go to the scans by broadcast, 8 bytes each, so at most
8 / host_bytes of the table: 50 MB for 100 TB.

Defined results: a null or empty page has no tokens and the text ''; a null url's host is ''; every row is a page of
its own, so equal rows repeat each other, whatever their identifiers; a page shorter than ``min_tokens`` is never
boilerplate; what repeats within one page only stays; an empty table gives no rows. Identifiers are integers.
"""

from __future__ import annotations

import html
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, stored

MIN_TOKENS, RANK_BITS = 8, 48
PIECE_TOKENS, HOST_BYTES = 1 << 21, 16 << 20
SHARD_RANKS = 1 << 20
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|small|big|code|font|mark|sub|sup|abbr|s|q|tt)(?:\s[^>]*)?/?>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
_HOST = r"^[a-zA-Z][a-zA-Z0-9_+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
OUT = "page_id long, host string, n_tokens int, n_removed int, text string"
GROUPS = "host string, raw long, blob binary"
PIECES = "piece long, host string, tokens long, raw long, blob binary, hits binary"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def visible_tokens(page: str | None) -> list[str]:
    """Tokens between white space of what a page shows; tags other than inline ones part tokens."""
    if not page:
        return []
    text = _TAG.sub(" ", _INLINE.sub("", _HIDDEN.sub(" ", page)))
    return (html.unescape(text) if "&" in text else text).split()


def _packed(ids: list[int | None], texts: list[bytes]) -> tuple[int, bytes]:
    """Identifiers and texts as one compressed string, and its size before."""
    n = len(ids)
    head = np.array([n, *(i is None for i in ids), *(i or 0 for i in ids), *map(len, texts)], np.int64).tobytes()
    raw = head + b"".join(texts)
    return len(raw), pa.Codec("zstd", compression_level=5).compress(raw, asbytes=True)


def _unpacked(raw: int, blob: bytes) -> tuple[list[int | None], list[bytes]]:
    data = pa.decompress(blob, raw, "zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    null, ids, sizes = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n)
    ends = 8 + 24 * n + np.cumsum(sizes)
    return [None if m else i for m, i in zip(null.tolist(), ids.tolist())], [data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())]


def _batch(rows: list[tuple], names: str, *kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names.split())


def _by_host(batch: pa.RecordBatch) -> dict[str, tuple[list, list]]:
    """Identifiers and token streams of a batch of (page_id, host, html)."""
    groups: dict[str, tuple[list, list]] = {}
    for i, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        at = groups.setdefault(host, ([], []))
        at[0].append(i)
        at[1].append(" ".join(visible_tokens(page.as_py())).encode("utf-8", "replace"))
    return groups


def _send(batches):
    """A compressed group of token streams for each host of a batch."""
    for batch in batches:
        yield _batch([(host, *_packed(*x)) for host, x in _by_host(batch).items()], "host raw blob", pa.string(), pa.int64(), pa.binary())


class Stream:
    """The concatenated tokens of some pages: text bytes and first token of each page, tokens by number and by byte."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        full = [i for i, t in enumerate(texts) if t]
        lists = pc.split_pattern(pa.array([texts[i] for i in full], pa.binary()).cast(pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        sizes = np.zeros(len(texts), np.int64)
        sizes[full] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.page = np.repeat(np.arange(len(texts)), sizes)
        self.bytes = pc.binary_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)[self.ids] if len(self.ids) else np.zeros(0, np.int64)

    def inside(self, k: int) -> np.ndarray:
        """Positions whose window of k tokens ends within its page."""
        n = len(self.ids)
        return np.flatnonzero(np.arange(n) + k <= self.first[1:][self.page]) if n else np.zeros(0, np.int64)

    def unique_runs(self, page: int, cover: np.ndarray) -> str:
        """The page's tokens that aren't covered, a line for each run."""
        a, b = int(self.first[page]), int(self.first[page + 1])
        text, own = self.texts[page], cover[a:b]
        if not own.any():
            return text.decode()
        ends = np.cumsum(self.bytes[a:b] + 1) - 1
        edge = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]]).astype(np.int8)))
        return b"\n".join(text[int(ends[s - 1]) + 1 if s else 0 : int(ends[e - 1])] for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())).decode()


def suffix_classes(ids: np.ndarray, k: int) -> np.ndarray:
    """Order of each suffix by its first k numbers, equal ones alike; prefix doubling, the last step overlapping."""
    rank, m = ids, 1
    while m < k and len(rank):
        step = min(m, k - m)
        if len(rank) <= step:
            return np.zeros(0, np.int64)
        top = int(rank.max()) + 1
        rank, m = np.unique(rank[: len(rank) - step] * top + rank[step:], return_inverse=True)[1], m + step
    return rank


def repeats(stream: Stream, host: np.ndarray, k: int) -> np.ndarray:
    """Where a window starts that another page of its host has too; host: number of the host of each page."""
    hit = np.zeros(len(stream.ids), bool)
    at = stream.inside(k)
    if not len(at):
        return hit
    vocabulary = len(stream.words)
    own = np.unique(host[stream.page] * vocabulary + stream.ids, return_inverse=True)[1] if host[-1] != host[0] else stream.ids
    rank = suffix_classes(own, k)[at]
    order = np.argsort(rank, kind="stable")
    page, rank = stream.page[at][order], rank[order]
    same = rank[1:] == rank[:-1]
    apart = same & (page[1:] != page[:-1])
    # a class with two neighbours from distinct pages is repeated as a whole
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    several = np.logical_or.reduceat(np.concatenate([apart, [False]]), starts)
    hit[at[order]] = np.repeat(several, np.diff(np.concatenate([starts, [len(rank)]])))
    return hit


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (b ^ (b >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return z ^ (z >> np.uint64(31))


def prefix_ranks(ids: np.ndarray, host: str, k: int) -> np.ndarray:
    """RANK_BITS of a hash of the first k of each suffix of 64-bit token hashes, that tasks agree on."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    rank, m = ids, 1
    while m < k:
        step = min(m, k - m)
        rank, m = _mix(rank[: len(rank) - step], rank[step:]), m + step
    salt = np.full(1, xxhash.xxh3_64_intdigest(host), np.uint64)
    return _mix(rank, salt) >> np.uint64(64 - RANK_BITS)


def stream_ranks(stream: Stream, host: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows within pages, and their ranks."""
    at = stream.inside(k)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in stream.words.to_pylist()), np.uint64, len(stream.words))
    return at, prefix_ranks(hashes[stream.ids], host, k)[at] if len(at) else np.zeros(0, np.uint64)


def covered(hit: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n tokens lie in a window of k that starts at a hit."""
    step = np.zeros(n + 1, np.int32)
    step[:-1][: len(hit)] += hit
    ends = np.flatnonzero(hit) + k
    np.subtract.at(step, ends, 1)
    return np.cumsum(step[:-1]) > 0


def _rows(ids, hosts, stream: Stream, hit: np.ndarray, k: int):
    """The result's columns for the pages of a stream."""
    cover = covered(hit, k, len(hit))
    below = np.concatenate([[0], np.cumsum(cover)])
    out = [(ids[p], hosts[p], int(stream.first[p + 1] - stream.first[p]), int(below[stream.first[p + 1]] - below[stream.first[p]]), stream.unique_runs(p, cover)) for p in range(len(ids))]
    return _batch(out, "page_id host n_tokens n_removed text", pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())


def _whole(k: int, piece_tokens: int):
    """Groups sorted by host to finished rows; hosts go together until they are half a piece."""

    def finish(held):
        ids, texts, hosts = [], [], []
        for host, i, t in held:
            ids, texts, hosts = ids + i, texts + t, hosts + [host] * len(i)
        stream = Stream(texts)
        numbers = np.cumsum(np.array([0, *(a != b for a, b in zip(hosts, hosts[1:]))]))
        return _rows(ids, hosts, stream, repeats(stream, numbers, k), k)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for host, raw, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if held and size * 2 > piece_tokens and held[-1][0] != host:
                    yield finish(held)
                    held, size = [], 0
                held.append((host, *_unpacked(raw, blob.as_py())))
                size += sum(t.count(b" ") + 1 for t in held[-1][2])
        if held:
            yield finish(held)

    return run


def _cut(k: int, piece_tokens: int):
    """(page_id, host, html) of large hosts to pieces: token streams and where a piece repeats itself."""

    def piece(host, ids, texts):
        stream = Stream(texts)
        hit = repeats(stream, np.zeros(len(texts), np.int64), k)
        return (uuid.uuid4().int >> 65, host, len(hit), *_packed(ids, texts), np.packbits(hit).tobytes())

    def out(rows):
        return _batch(rows, "piece host tokens raw blob hits", pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(batches):
        held: dict[str, tuple[list, list]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for host, (ids, texts) in _by_host(batch).items():
                mine = held.setdefault(host, ([], []))
                for i, t in zip(ids, texts):
                    n = t.count(b" ") + 1
                    if mine[0] and sizes[host] + n > piece_tokens:
                        yield out([piece(host, *mine)])
                        mine = held[host] = ([], [])
                        sizes[host] = 0
                    mine[0].append(i)
                    mine[1].append(t)
                    sizes[host] = sizes.get(host, 0) + n
            while sum(sizes.values()) > 2 * piece_tokens:
                largest = max(sizes, key=sizes.get)
                yield out([piece(largest, *held.pop(largest))])
                del sizes[largest]
        for host, mine in held.items():
            yield out([piece(host, *mine)])

    return run


def _offer(k: int, shards: int):
    """Of a piece, its distinct ranks by shard: first rank, differences, and whether its own pages repeat it."""

    def run(batches):
        for batch in batches:
            rows = []
            for piece, host, raw, blob, hits in zip(*(c.to_pylist() for c in batch.columns)):
                stream = Stream(_unpacked(raw, blob)[1])
                at, ranks = stream_ranks(stream, host, k)
                if not len(at):
                    continue
                hit = np.unpackbits(np.frombuffer(hits, np.uint8), count=len(stream.ids)).astype(bool)[at]
                once, inverse = np.unique(ranks, return_inverse=True)
                # two windows of the piece that chance gave one rank: asked for if either isn't repeated
                known = np.ones(len(once), bool)
                known[inverse[~hit]] = False
                shard = ((once >> np.uint64(16)) * np.uint64(shards) >> np.uint64(RANK_BITS - 16)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(once)]])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    rows.append((int(shard[a]), piece, *_differences(once[a:b]), np.packbits(known[a:b]).tobytes()))
            yield _batch(rows, "shard piece first steps wide known", pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())

    return run


def _differences(ranks: np.ndarray) -> tuple[int, bytes, bool]:
    steps = np.diff(ranks)
    wide = len(steps) > 0 and int(steps.max()) >> 32 > 0
    return int(ranks[0]), steps.astype(np.uint64 if wide else np.uint32).tobytes(), wide


def _ranks(first: int, steps: bytes, wide: bool) -> np.ndarray:
    return np.cumsum(np.concatenate([np.array([first], np.uint64), np.frombuffer(steps, np.uint64 if wide else np.uint32).astype(np.uint64)]), dtype=np.uint64)


def _answer(table: pa.Table) -> pa.Table:
    """Of a shard, for each piece those of its ranks that several pieces have and one of them doesn't know repeated."""
    rows = table.to_pylist()
    own = [_ranks(r["first"], r["steps"], r["wide"]) for r in rows]
    every = np.sort(np.concatenate(own))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    asked = [ranks[~np.unpackbits(np.frombuffer(r["known"], np.uint8), count=len(ranks)).astype(bool)] for r, ranks in zip(rows, own)]
    # those who know are told too: a digest that only the asking piece has would be taken for chance
    shared = shared[np.isin(shared, np.concatenate(asked))]
    out = []
    for r, ranks in zip(rows, own):
        found = ranks[np.isin(ranks, shared, assume_unique=True)]
        if len(found):
            out.append((r["piece"], *_differences(found)))
    return pa.Table.from_batches([_batch(out, "piece first steps wide", pa.int64(), pa.int64(), pa.binary(), pa.bool_())])


def _named(stream: Stream, host: str, k: int, answers):
    """(position, digest of host and tokens) of the windows that answers name."""
    if not answers:
        return
    at, ranks = stream_ranks(stream, host, k)
    wanted = np.concatenate([_ranks(r["first"], r["steps"], r["wide"]) for r in answers])
    words, salt, known = stream.words.to_pylist(), host + "\n", {}
    for a in at[np.isin(ranks, wanted)].tolist():
        window = stream.ids[a : a + k]
        digest = known.get(key := window.tobytes())
        if digest is None:
            digest = known[key] = xxhash.xxh3_128_digest(salt + " ".join([words[w] for w in window.tolist()]))
        yield a, digest


def _digests(k: int):
    def run(batches):
        for batch in batches:
            for piece, host, raw, blob, answers in zip(*(c.to_pylist() for c in batch.columns)):
                found = {d for _, d in _named(Stream(_unpacked(raw, blob)[1]), host, k, answers)}
                yield pa.RecordBatch.from_arrays([pa.array([piece] * len(found), pa.int64()), pa.array(list(found), pa.binary())], names=["piece", "digest"])

    return run


def _complete(k: int):
    def run(batches):
        for batch in batches:
            for _, host, raw, blob, hits, answers, chance in zip(*(c.to_pylist() for c in batch.columns)):
                ids, texts = _unpacked(raw, blob)
                stream, chance = Stream(texts), set(chance or ())
                hit = np.unpackbits(np.frombuffer(hits, np.uint8), count=len(stream.ids)).astype(bool)
                more = [a for a, d in _named(stream, host, k, answers) if d not in chance]
                hit[more] = True
                yield _rows(ids, [host] * len(ids), stream, hit, k)

    return run


def extract(df: DataFrame, min_tokens: int = MIN_TOKENS, page_id: str = "page_id", url: str = "url", page: str = "html", piece_tokens: int = PIECE_TOKENS, host_bytes: int = HOST_BYTES) -> DataFrame:
    """(page_id, host, n_tokens, n_removed, text) for every page; the unique runs of a text are its lines."""
    k = min_tokens
    pages = df.select(col(page_id).cast("long").alias("page_id"), host_of(col(url)).alias("host"), col(page).alias("html"))
    sizes = pages.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 100).alias("bytes"))
    # 64 bits name a host: one that shares them with a large one is only treated like it
    large = F.broadcast(stored(sizes.where(F.col("bytes") > host_bytes).select(F.xxhash64("host").alias("large")), "hosts"))
    of_large = F.xxhash64("host") == F.col("large")
    groups = pages.join(large, of_large, "left_anti").mapInArrow(_send, GROUPS)
    whole = groups.repartition("host").sortWithinPartitions("host").mapInArrow(_whole(k, piece_tokens), OUT)
    pieces = stored(pages.join(large, of_large, "left_semi").mapInArrow(_cut(k, piece_tokens), PIECES), "pieces")
    shards = max(1, -(-int(pieces.agg(F.sum("tokens")).first()[0] or 0) // SHARD_RANKS))
    offers = pieces.select("piece", "host", "raw", "blob", "hits").mapInArrow(_offer(k, shards), "shard int, piece long, first long, steps binary, wide boolean, known binary")
    answers = stored(offers.groupBy("shard").applyInArrow(_answer, "piece long, first long, steps binary, wide boolean"), "answers")
    told = answers.groupBy("piece").agg(F.collect_list(F.struct("first", "steps", "wide")).alias("answers"))
    asked = pieces.join(told, "piece").select("piece", "host", "raw", "blob", "answers")
    digests = asked.mapInArrow(_digests(k), "piece long, digest binary")
    # a piece has a digest once; one that no other piece has is a chance meeting of ranks
    chance = digests.groupBy("digest").agg(F.count("*").alias("n"), F.min("piece").alias("piece")).where("n = 1").groupBy("piece").agg(F.collect_list("digest").alias("chance"))
    chance = stored(chance, "chance")
    cut = pieces.join(told, "piece", "left").join(chance, "piece", "left").select("piece", "host", "raw", "blob", "hits", "answers", "chance").mapInArrow(_complete(k), OUT)
    return whole.unionByName(cut)
