"""Token-id files compressed by Re-Pair grammars, readable at random.

Per shard, frequent pairs of neighbouring ids are replaced by new symbols, the most frequent first, until no pair inside
a document pays for a rule; no pair crosses a document's end. A file holds the rules, every rule's expansion length,
where each document starts, and the symbols that are left. A document is read from its own range of the symbols, and
expanded by the rules that it uses only.

File format (little-endian): ``b"LRPG"``, a version and the length of a JSON header (unsigned 32 bits each), the header
(counts, bits of a symbol, and the dtype and shape of each array in order), then the arrays: ``rules`` (pairs of
symbols), ``spans`` (ids that a rule expands to), ``doc_ids``, ``doc_null``, ``ends`` (symbols up to each document's
end), ``id_ends`` (ids up to each document's end), ``symbols`` (the low 16 bits of each, then bit 16 of all packed eight
to a byte, and so on up to ``bits`` bits). Symbols below ``base`` are ids; ``base + r`` is rule ``r``.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm.common import arrow_rows, cut, delete_at_exit, fresh_path, read_range, read_shared, release_memory, write_shared
from lodestar.llm.encoding import SLICE, encoder

MAGIC, VERSION = b"LRPG", 2
ARRAYS = ("rules", "spans", "doc_ids", "doc_null", "ends", "id_ends", "symbols")
#: Ids of a shard, so that a task holds no more than a shard; the longest document may be over it.
SHARD_IDS = 1 << 21
#: Replacements that a rule needs: it takes two symbols and a length itself.
LEAST = 4
#: A round replaces the pairs that are at least this share as frequent as the most frequent one.
ROUND_SHARE = 0.05
SLOTS = 1 << 16
#: Pairs that are looked up at a time, so that they stay in a core's cache.
BLOCK = 1 << 15
#: Shards that a task reads, one at a time.
READ_TOGETHER = 4


@dataclass
class Grammar:
    base: int
    rules: np.ndarray
    spans: np.ndarray
    symbols: np.ndarray
    ends: np.ndarray


def slots(keys: np.ndarray) -> np.ndarray:
    """The place of each pair in a table of ``SLOTS``, by multiplication."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def _matches(keys: np.ndarray, pairs: np.ndarray, kind: type, empty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(pairs, places, number of the pair at each place, places of each pair)``.

    One pair for each slot of a table is looked for, the most frequent; the others have their turn later. Of matches
    that overlap, every second counts, from the left.
    """
    rule_of = np.zeros(SLOTS, np.int64)
    slot = slots(pairs).astype(np.int64)
    rule_of[slot[::-1]] = np.arange(len(pairs))[::-1]
    own = rule_of[slot] == np.arange(len(pairs))
    pairs, slot = pairs[own], slot[own]
    table = np.full(SLOTS, empty, kind)
    table[slot], rule_of[slot] = pairs, np.arange(len(pairs))
    found = np.zeros(len(keys), bool)
    for at in range(0, len(keys), BLOCK):
        some = keys[at : at + BLOCK]
        np.equal(table.take(slots(some)), some, out=found[at : at + BLOCK])
    hit = np.flatnonzero(found)
    head = np.r_[True, hit[1:] != hit[:-1] + 1]
    run = np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
    hit = hit[((np.arange(len(hit)) - run) & 1) == 0]
    rule = rule_of[slots(keys[hit])]
    return pairs, hit, rule, np.bincount(rule, minlength=len(pairs))


def _apart(pairs: np.ndarray, shift: int) -> np.ndarray:
    """Pairs of two symbols, the most frequent first, such that no symbol is left in one and right in another."""
    lefts, rights, chosen = set(), set(), []
    mask = (1 << shift) - 1
    for k, pair in enumerate(pairs.tolist()):
        left, right = pair >> shift, pair & mask
        if left != right and left not in rights and right not in lefts:
            lefts.add(left)
            rights.add(right)
            chosen.append(k)
    return pairs[chosen]


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST, round_share: float = ROUND_SHARE) -> Grammar:
    """Re-Pair in rounds: pairs about as frequent as the most frequent one are replaced together, left to right.

    A rule stays if at least ``least`` of its pairs were there to replace after those of the others in its round. The
    rounds go on until no pair has so many left to replace, alone or beside others; there is no limit on rounds, rules,
    or the length that a rule expands to.
    ``ends``: the number of ids up to each document's end.
    """
    symbols = ids.astype(np.int64)
    last = ends[np.r_[True, ends[1:] != ends[:-1]] & (ends > 0)] - 1  # where documents end among the symbols
    rules: list[np.ndarray] = []
    spans = np.ones(base, np.int64)
    count, share = base, round_share
    uses = np.bincount(symbols, minlength=count)
    while len(symbols) > 1:
        # Pairs as numbers of the symbols in use: these mostly fit into 16 bits, so that a pair takes 32.
        used = np.flatnonzero(uses)
        narrow = len(used) < 1 << 16
        kind, shift = (np.uint32, 16) if narrow else (np.uint64, 32)
        across, empty = np.iinfo(kind).max, np.iinfo(kind).max - 1  # neither is a pair of numbers
        number = np.zeros(count, kind)
        number[used] = np.arange(len(used))
        keys = number.take(symbols)
        keys = (keys[:-1] << kind(shift)) | keys[1:]
        keys[last[:-1]] = across
        ordered = np.sort(keys)[: len(keys) - len(last) + 1]
        starts = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1] if len(ordered) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[starts, len(ordered)])
        floor = max(least, int(share * counts.max(initial=0)))
        often = np.flatnonzero(counts >= floor)
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")]
        pairs = ordered[starts[often]]
        pairs, hit, rule, times = _matches(keys, pairs, kind, empty)
        pays = times >= least
        if not pays.any() and floor > least:
            share = 0.0  # what is left is too entangled to be taken by frequency
            continue
        if 2 * pays.sum() < len(pairs):
            # Too entangled with each other: take those of which no symbol is a left one here and a right one there.
            # They keep all their occurrences. A pair of one symbol has fewer in a run of it, so such pairs come last,
            # and those that do not pay make room for others of their slot.
            rest = ordered[starts[often]]
            alone = _apart(rest, shift)
            if len(alone):
                pairs, hit, rule, times = _matches(keys, alone, kind, empty)
                pays = times >= least
            while not pays.any() and len(rest):
                pairs, hit, rule, times = _matches(keys, rest, kind, empty)
                pays = times >= least
                rest = rest[~np.isin(rest, pairs)]
        if not pays.any():
            break
        hit, rule = hit[pays[rule]], (np.cumsum(pays) - 1)[rule[pays[rule]]]
        pairs, times = pairs[pays], times[pays]
        left, right = used[(pairs >> kind(shift)).astype(np.int64)], used[(pairs & kind((1 << shift) - 1)).astype(np.int64)]
        rules.append(np.stack([left, right], axis=1))
        spans = np.r_[spans, spans[left] + spans[right]]
        uses = np.r_[uses, times]
        np.subtract.at(uses, left, times)
        np.subtract.at(uses, right, times)
        symbols[hit] = count + rule
        stay = np.ones(len(symbols), bool)
        stay[hit + 1] = False
        symbols = symbols[stay]
        last = last - np.searchsorted(hit + 1, last, side="right")
        count += len(pairs)
    # Where documents end among the symbols: by the ids that the symbols cover.
    covered = np.cumsum(spans[symbols]) if len(symbols) else np.zeros(0, np.int64)
    symbol_ends = np.searchsorted(covered, ends, side="left") + 1
    symbol_ends[ends == 0] = 0
    all_rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    width, span = (np.uint16 if n <= 1 << 16 else np.uint32 for n in (count, spans.max(initial=0) + 1))
    return Grammar(base, all_rules.astype(width), spans[base:].astype(span), symbols.astype(np.uint32), symbol_ends.astype(np.int64))


def pack_symbols(symbols: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each symbol, then every higher bit of all symbols in turn."""
    return symbols.astype("<u2").tobytes() + b"".join(np.packbits((symbols & np.uint32(1 << b)) != 0).tobytes() for b in range(16, bits))


def expansions(base: int, rules: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(flat, starts, sizes)`` over all symbols: the ids of a symbol are ``sizes`` entries of ``flat`` from ``starts``."""
    sizes = np.concatenate([np.ones(base, np.int64), spans.astype(np.int64)])
    starts = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.uint32)
    flat[:base] = np.arange(base)
    # Rules whose symbols all stand before the first of them are expanded together.
    newest, first = np.maximum.accumulate(rules.max(axis=1).astype(np.int64)) if len(rules) else np.zeros(0, np.int64), 0
    while first < len(rules):
        stop = int(np.searchsorted(newest, base + first))
        ids = expand(rules[first:stop].ravel().astype(np.int64), flat, starts, sizes)
        at = int(starts[base + first])
        flat[at : at + len(ids)] = ids
        first = stop
    return flat, starts, sizes


def expand(symbols: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    own = sizes[symbols]
    ends = np.cumsum(own)
    if not len(ends):
        return np.zeros(0, np.uint32)
    return flat[np.repeat(starts[symbols] - (ends - own), own) + np.arange(int(ends[-1]))]


def expand_few(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The ids of some symbols, by replacing rules by their pairs until none is left: only what they use is looked up."""
    symbols = symbols.astype(np.int64)
    while (ruled := symbols >= base).any():
        at = np.cumsum(1 + ruled) - (1 + ruled)
        out = np.zeros(len(symbols) + int(ruled.sum()), np.int64)
        pairs = rules[symbols[ruled] - base]
        out[at[~ruled]] = symbols[~ruled]
        out[at[ruled]], out[at[ruled] + 1] = pairs[:, 0], pairs[:, 1]
        symbols = out
    return symbols.astype(np.uint32)


def to_bytes(grammar: Grammar, doc_ids: list[int | None], id_ends: np.ndarray) -> bytes:
    null = np.array([x is None for x in doc_ids], bool)
    bits = max(1, int(grammar.base + len(grammar.rules) - 1).bit_length())
    arrays = {
        "rules": grammar.rules, "spans": grammar.spans, "doc_ids": np.array([x or 0 for x in doc_ids], np.int64), "doc_null": np.packbits(null),
        "ends": grammar.ends, "id_ends": id_ends.astype(np.int64), "symbols": np.frombuffer(pack_symbols(grammar.symbols, bits), np.uint8),
    }
    head = json.dumps({"base": grammar.base, "docs": len(doc_ids), "bits": bits, "arrays": [[k, arrays[k].dtype.str, list(arrays[k].shape)] for k in ARRAYS]}).encode()
    return b"".join([MAGIC, struct.pack("<II", VERSION, len(head)), head, *(np.ascontiguousarray(arrays[k]).tobytes() for k in ARRAYS)])


class Shard:
    """A shard file: ``len()``, documents by place, and all of them in turn.

    ``read(offset, size)`` gives bytes of the file. Its tables are read at once; of the symbols, only what is asked for.
    """

    def __init__(self, read: Callable[[int, int], bytes] | bytes) -> None:
        if isinstance(read, bytes):
            whole = read
            read = lambda at, n: whole[at : at + n]
        self.read = read
        start = read(0, 12)
        if start[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        version, size = struct.unpack("<II", start[4:12])
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        head = json.loads(read(12, size))
        at, self.base, self.n, self.bits = 12 + size, head["base"], head["docs"], head["bits"]
        *tables, _ = head["arrays"]
        sizes = [int(np.prod(shape)) * np.dtype(dtype).itemsize for _, dtype, shape in tables]
        data, offset = read(at, sum(sizes)), 0
        for (name, dtype, shape), n in zip(tables, sizes, strict=True):
            setattr(self, name, np.frombuffer(data, dtype, int(np.prod(shape)), offset).reshape(shape))
            offset += n
        self.symbols_at = at + sum(sizes)
        self.null = np.unpackbits(self.doc_null)[: self.n].astype(bool)

    def __len__(self) -> int:
        return self.n

    def doc_id(self, k: int) -> int | None:
        return None if self.null[k] else int(self.doc_ids[k])

    def symbols(self, first: int, stop: int) -> np.ndarray:
        out = np.frombuffer(self.read(self.symbols_at + 2 * first, 2 * (stop - first)), "<u2").astype(np.uint32)
        count = int(self.ends[-1]) if self.n else 0
        for k in range(self.bits - 16):
            plane = self.symbols_at + 2 * count + k * -(-count // 8)
            packed = np.frombuffer(self.read(plane + first // 8, -(-stop // 8) - first // 8), np.uint8)
            out |= np.unpackbits(packed)[first % 8 :][: stop - first].astype(np.uint32) << np.uint32(16 + k)
        return out

    @classmethod
    def open(cls, url: str) -> Shard:
        """A shard in a shared folder, of which only what is asked for is read."""
        return cls(lambda at, size: read_range(url, at, size))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the ``k``-th document; nothing else is read or expanded."""
        return expand_few(self.symbols(int(self.ends[k - 1]) if k else 0, int(self.ends[k])), self.base, self.rules)

    def documents(self, block: int = 1 << 18) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, ids before it in the shard, ids)``, some documents expanded at a time."""
        table = expansions(self.base, self.rules, self.spans)
        k = 0
        while k < self.n:
            first = int(self.ends[k - 1]) if k else 0
            stop = max(k + 1, int(np.searchsorted(self.ends, first + block, side="right")))
            base_id = int(self.id_ends[k - 1]) if k else 0
            ids = expand(self.symbols(first, int(self.ends[stop - 1])), *table)
            for j in range(k, stop):
                a = int(self.id_ends[j - 1]) if j else 0
                yield self.doc_id(j), a, ids[a - base_id : int(self.id_ends[j]) - base_id]
            k = stop


MANIFEST = "task long, shard long, path string, n_docs long, n_ids long, n_symbols long, n_rules long, n_bytes long"


def id_bound(tokenizer: str, end_id: int) -> int:
    """The number above every id of a vocabulary, and above the end id: symbols from there on are rules."""
    return max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, base: int | None = None, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, in ascending order of id, into shard files below ``folder``; return their written manifest.

    The rows are dealt by ranges of the id and sorted within, so the files in order of (task, shard) are in order of
    id. A file has a name of its own for each attempt of a task; only files of the manifest count, so a lost executor
    leaves at most files that nothing reads. A task holds one shard. ``base``: the first number of a rule, by default
    that above the vocabulary's ids; one that an id reaches is an error.
    """
    least = id_bound(tokenizer, end_id)
    base = least if base is None else base
    if base < least:
        raise ValueError(f"{tokenizer} has ids up to {least - 1}: rules cannot begin at {base}")
    end = end_id.to_bytes(4, "little")

    def run(batches):
        task = TaskContext.get().partitionId()
        number = 0
        ids_of: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def flush():
            nonlocal number, ids_of, parts, size
            ends = np.cumsum([len(p) // 4 for p in parts]).astype(np.int64)
            grammar = compress(np.frombuffer(b"".join(parts), "<u4"), ends, base)
            data = to_bytes(grammar, ids_of, ends)
            path = f"{folder}/shard-{task:06d}-{number:06d}-{uuid.uuid4().hex}.lrpg"
            write_shared(path, data)
            row = (task, number, path, len(parts), int(ends[-1]), len(grammar.symbols), len(grammar.rules), len(data))
            number, ids_of, parts, size = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            encode = encoder(tokenizer, spaced=False)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids_of.append(doc_id)
                parts.append(ids + end)
                size += len(parts[-1]) // 4
                if size >= shard_ids:
                    yield flush()
        if parts:
            yield flush()
        release_memory()

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    ordered = source.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    with arrow_rows(docs.sparkSession, SLICE[False]):
        return cut(ordered.mapInArrow(run, MANIFEST), "shard-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, ids)`` from the files of a manifest; ``ids`` as little-endian unsigned 32-bit integers.

    ``start``: the ids of all documents before. The manifest has a row for each shard, which is all that is numbered
    in one task.
    """
    before = Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, at, ids in Shard(read_shared(path)).documents():
                    rows.append((doc_id, start + at, ids.astype("<u4").tobytes()))
                    if len(rows) >= 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return placed.repartition(max(1, min(-(-manifest.count() // READ_TOGETHER), 10_000))).mapInArrow(run, "doc_id long, start long, ids binary")


def grammar_round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write all documents as shards and read them back: ``(doc_id, start, ids)``.

    A null or empty text is its end id alone; rows without an id come first; repeated rows are written each, those of
    one id in order of text; an empty table gives no file and an empty result; other columns are not read.
    """
    own = folder or fresh_path(docs.sparkSession, "shards")
    manifest = write_shards(docs, tokenizer, own, **options)
    if not folder:
        delete_at_exit(docs.sparkSession, own)
    return read_shards(manifest)
