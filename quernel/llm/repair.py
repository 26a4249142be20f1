"""Token ids of a corpus as Re-Pair compressed shards with random access.

Documents are put into ascending order of their ids by a range partitioning, each partition encodes
its texts and cuts them into blocks of about ``block_tokens`` ids, and each block gets a grammar of
its own: frequent pairs of neighbouring symbols are replaced by new symbols (nonterminals), again
and again, until no pair occurs four times any more. A round replaces many pairs at once;
where occurrences overlap, the commoner pair wins. No pair spans two documents.

Layout of a block, all numbers little-endian and each array compressed on its own:

    magic "RPG1", counts of terminals, rules, documents, symbols (u32 each)
    rules        u32 pairs: what nonterminal ``terminals + i`` stands for
    lengths      u32: number of ids that rule i expands to
    ids          i64: document ids          known   u8: 0 where the document id is null
    symbol_ends  u32: where each document's symbols end       token_ends   u32: same for its ids
    symbols      u32: the sequence

``token_ends`` and ``lengths`` lead to any token of any document without expanding the rest.
A block is a file of this format; blocks are kept as the binary column of a Parquet table (shard,
block, counts, payload) rather than as files by themselves, so they can lie in any store that Spark
writes to, and a lost task writes its part again. ``Block(payload)`` reads one, wherever it is from.

Nulls count as empty texts. Strings of a tokenizer's special tokens in a text become those tokens,
as the library does by default. Rows that repeat an id are ordered by a hash of their texts; rows
that are equal in both are dealt out by their place in the input, so no id meets in one task.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.workspace import stage

MAGIC = b"RPG1"
END = 0  #: the id that ends each document


# --- grammar ------------------------------------------------------------------------------------


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, rounds: int | None = None, per_round: int = 4096, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids`` of documents that end at ``ends`` -> (symbols, where documents end in them, rules).

    Rounds go on until no pair occurs ``least`` times, unless ``rounds`` stops them before. A round
    takes the ``per_round`` commonest pairs; the others have their turn in a later one. The commonest
    pair of all always gets its places, so each round makes a rule and the loop ends.
    Symbols below 2^16 make pairs of 32 bits; once there are more, both are twice as wide.
    A pair of old symbols never becomes more frequent, so a place whose pair can't occur ``least``
    times is looked at again only when it comes to lie next to a new symbol. Counts by hash slot tell:
    all places of a pair share a slot, so none has more of them than its slot.
    """
    x = np.ascontiguousarray(ids, dtype=np.uint32)
    filled = np.diff(ends, prepend=0) > 0
    stops = np.asarray(ends, dtype=np.int64)[filled]  # where documents end by now
    rules: list[np.ndarray] = []
    live: np.ndarray | None = None  # the places to look at; None: all
    made, done, guess = terminals, 0, least
    per_round = min(per_round, 32_000)  # ranks are 16-bit numbers
    while len(x) > 1 and (rounds is None or done < rounds):
        symbol, pair, half = (np.uint16, np.uint32, 16) if made + per_round < 1 << 16 else (np.uint32, np.uint64, 32)
        spin = pair(0x9E3779B1 if half == 16 else 0x9E3779B97F4A7C15)
        slot = lambda k, bits, spin=spin, half=half: ((k * spin) >> k.dtype.type(2 * half - bits)).astype(np.intp)
        no_pair = pair((1 << 2 * half) - 1)  # the last symbol is never made, so no pair looks like this
        x = x.astype(symbol, copy=False)
        key = x[:-1].astype(pair)
        key <<= pair(half)
        key |= x[1:]
        key[stops[:-1] - 1] = no_pair
        places = np.arange(len(key)) if live is None else np.flatnonzero(live)
        looked = key if live is None else key[places]
        bits = min(max(len(looked).bit_length(), 8), 19)
        where = slot(looked, bits)
        # No pair occurs more often than its slot; counts past 16 bits needn't be told apart.
        most = np.minimum(np.bincount(where, minlength=1 << bits), 65_535).astype(np.uint16)[where]
        live = np.zeros(len(x), dtype=bool)
        live[places] = most >= min(least, 65_535)
        # The commonest pairs are at least about as common as those of the last round; else all are counted.
        for bound in (guess, least) if guess > least else (least,):
            likely = np.flatnonzero(most >= min(bound, 65_535))
            ordered = np.sort(looked[likely])
            starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
            counts = np.diff(starts, append=len(ordered))
            often = np.flatnonzero(counts >= bound)
            often = often[ordered[starts[often]] != no_pair]
            if len(often) >= per_round:
                break
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")[:per_round]]
        guess = max(least, int(counts[often[-1]]) * 3 // 4)
        pairs, none = ordered[starts[often]], len(often)  # the commonest first
        # One slot per hash holds a pair; of pairs that share a slot the commoner one has its turn now.
        holder = np.full(1 << 18, none, dtype=np.int16)
        holder[slot(pairs[::-1], 18)] = np.arange(none, dtype=np.int16)[::-1]
        places, looked = places[likely], looked[likely]
        held = np.take(holder, slot(looked, 18), mode="clip")
        right = np.take(np.append(pairs, no_pair), held, mode="clip") == looked
        right &= held < none
        places = places[right]
        # Rank of the pair at each place, between two zeros; 0 where there is none to replace.
        value = np.zeros(len(key) + 2, dtype=np.int16)
        own = np.int16(none) - held[right]
        value[places + 1] = own
        before = value[places]
        follows = own >= value[places + 2]
        top = (own > before) & follows
        again = np.flatnonzero(own == before)  # a symbol three times or more
        if len(again):
            at = places[again]
            fresh = np.diff(at, prepend=-2) != 1
            first = (again[fresh] - 1)[np.cumsum(fresh) - 1]  # where the run of equal pairs begins
            top[again] = top[first] & ((at - places[first]) % 2 == 0) & follows[again]
        at = places[top]
        found = none - value[at + 1]
        used = np.bincount(found, minlength=none)
        good = used[found] >= 2
        at, found = at[good], found[good]
        number = np.cumsum(used >= 2) - 1
        chosen = pairs[used >= 2]
        rules.append(np.stack([chosen >> pair(half), chosen & pair((1 << half) - 1)], axis=1).astype("<u4"))
        x = x.copy()
        x[at] = (made + number[found]).astype(symbol)
        stay = np.ones(len(x), dtype=bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        x = x[stay]
        new = x >= symbol(made)
        live = new[:-1] | new[1:] | live[stay[:-1]]
        stops = stops - np.searchsorted(at, stops)  # a pair that begins before an end lies before it
        made += len(chosen)
        done += 1
    symbol_ends = np.zeros(len(ends), dtype=np.int64)
    symbol_ends[filled] = stops
    return x, np.maximum.accumulate(symbol_ends) if len(symbol_ends) else symbol_ends, np.concatenate(rules) if rules else np.zeros((0, 2), dtype="<u4")


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule expands to; a rule refers to earlier rules only."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < terminals else out[a - terminals]) + (1 if b < terminals else out[b - terminals]))
    return np.array(out, dtype=np.int64)


def spread(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``table`` that begin at ``starts`` and have these sizes, one after the other."""
    total = int(sizes.sum())
    kind = np.int32 if max(total, len(table)) < 1 << 31 else np.int64
    ends = np.cumsum(sizes, dtype=kind)
    where = np.repeat(starts.astype(kind) - (ends - sizes.astype(kind)), sizes)
    where += np.arange(total, dtype=kind)
    return table[where]


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that a run of symbols stands for."""
    if len(rules) and len(symbols) > len(rules):  # unroll each rule once, then copy runs
        lengths = rule_lengths(rules, terminals)
        starts = np.cumsum(lengths) - lengths
        unrolled = np.empty(int(lengths.sum()), dtype="<u4")
        left, at = np.arange(len(rules)), starts  # rules yet to be written, and where
        sizes = np.append(lengths, 1)
        while len(left):
            both = rules[left].astype(np.int64) - terminals
            both_at = np.stack([at, at + sizes[np.where(both[:, 0] < 0, -1, both[:, 0])]], axis=1)
            own = both < 0
            unrolled[both_at[own]] = both[own] + terminals
            left, at = both[~own], both_at[~own]
        x = np.asarray(symbols, dtype=np.int64)
        rule = np.maximum(x - terminals, 0)
        own = x < terminals
        first = np.where(own, len(unrolled) + np.cumsum(own) - 1, starts[rule])
        return spread(np.concatenate([unrolled, x[own].astype("<u4")]), first, np.where(own, 1, lengths[rule]))
    x = np.asarray(symbols, dtype=np.int64)
    while True:
        rule = x >= terminals
        if not rule.any():
            return x.astype("<u4")
        place = np.arange(len(x)) + np.cumsum(rule) - rule
        out = np.empty(len(x) + int(rule.sum()), dtype=np.int64)
        out[place[~rule]] = x[~rule]
        pair = rules[x[rule] - terminals]
        out[place[rule]], out[place[rule] + 1] = pair[:, 0], pair[:, 1]
        x = out


# --- blocks -------------------------------------------------------------------------------------


def _array(values: np.ndarray, dtype: str) -> bytes:
    planes = np.ascontiguousarray(np.asarray(values).astype(dtype).reshape(-1).view(np.uint8).reshape(-1, np.dtype(dtype).itemsize).T)
    body = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
    return struct.pack("<I", len(body)) + body


def write_block(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, terminals: int, rounds: int | None = None) -> bytes:
    symbols, symbol_ends, rules = compress(ids, ends, terminals, rounds)
    head = MAGIC + struct.pack("<4I", terminals, len(rules), len(doc_ids), len(symbols))
    known = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    return head + b"".join(
        [_array(rules, "<u4"), _array(rule_lengths(rules, terminals), "<u4"), _array(np.array([i or 0 for i in doc_ids], dtype=np.int64), "<i8"), _array(known, "u1"), _array(symbol_ends, "<u4"), _array(ends, "<u4"), _array(symbols, "<u4")]
    )


class Block:
    """A block read back; documents and token ranges are decoded on demand."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a block")
        self.terminals, self.n_rules, self.n_docs, self.n_symbols = struct.unpack_from("<4I", payload, 4)
        at, arrays = 20, []
        for dtype in ("<u4", "<u4", "<i8", "u1", "<u4", "<u4", "<u4"):
            (size,) = struct.unpack_from("<I", payload, at)
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[at + 4 : at + 4 + size]), dtype=np.uint8)
            arrays.append(np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype))
            at += 4 + size
        flat, self.lengths, ids, known, self.symbol_ends, self.token_ends, self.symbols = arrays
        self.rules = flat.reshape(-1, 2)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]

    def document(self, n: int) -> np.ndarray:
        first = int(self.symbol_ends[n - 1]) if n else 0
        return expand(self.symbols[first : int(self.symbol_ends[n])], self.rules, self.terminals)

    def tokens(self, n: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document n; only the symbols that cover them are expanded."""
        first = int(self.symbol_ends[n - 1]) if n else 0
        own = self.symbols[first : int(self.symbol_ends[n])].astype(np.int64)
        sizes = np.where(own < self.terminals, 1, self.lengths[np.maximum(own - self.terminals, 0)] if self.n_rules else 1)
        ends = np.cumsum(sizes)
        stop = min(stop, int(ends[-1]) if len(ends) else 0)
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop - 1, side="right")) + 1
        before = int(ends[a - 1]) if a else 0
        return expand(own[a:b], self.rules, self.terminals)[start - before : stop - before]


# --- tokens -------------------------------------------------------------------------------------

#: A blank between other white space, or at the end after such: only there is the text not the sum of its blank-led pieces.
_WHITE = r"\s\p{Z}\x0b\x1c-\x1f\x85"
_NOT_APART = rf"[{_WHITE}] (?:[{_WHITE}]|$)"
_PLAIN = rf"^\x00?[^\x00{_WHITE}](?:[^\r]*[^{_WHITE}])?$"
#: Marks after a word, and line feeds between words, are tokens of their own: pieces without a blank,
#: told by a leading NUL. (A text that has a NUL is encoded whole.)
_CUTS = ((rf"(\pL)([.,!?;:%$&*#|]+)([{_WHITE}]|$)", "\\1 \x00\\2\\3"), (rf"([^{_WHITE}])\n([^{_WHITE}])", "\\1 \x00\n \x00\\2"))
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """A byte-level BPE tokenizer that encodes each distinct blank-led piece of the texts once.

    The tokenizer's own pattern never joins a blank with what is before it, unless both sides are
    white space; texts with such places are encoded as they are. Pieces are kept between tasks of a
    worker, up to ``keep`` of them.
    """

    def __init__(self, path: str, keep: int = 1_200_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts with one of these are encoded whole: they are found before a text is cut into words.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep, self.known, self.lengths, self.flat = keep, {}, np.zeros(0, dtype=np.int32), np.zeros(0, dtype="<u4")

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(lengths.sum())), lengths

    def _encode_pieces(self, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, each with a blank before it unless it is marked, the plain ones first.

        Plain ones neither begin nor end with white space and hold no carriage return. They are
        encoded some hundred a text with carriage returns between: one that has no white space
        before it, and none but a single blank after it, is a token of its own and tells them apart.
        """
        mark = self.tokenizer.encode("\r", add_special_tokens=False).ids
        bare = lambda words: [w[1:] if w[:1] == "\0" else " " + w for w in words]
        lines = ["\r".join(bare(plain[i : i + 256])) + "\r" for i in range(0, len(plain), 256)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), dtype="<u4", count=sum(map(len, found)))
        cuts = np.flatnonzero(flat == mark[0])
        if len(mark) != 1 or len(cuts) != len(plain):  # another kind of tokenizer
            return self._encode(bare([*plain, *odd]))
        odd_ids, odd_lengths = self._encode(bare(odd))
        lengths = (np.diff(cuts, prepend=-1) - 1).astype(np.int32)
        return np.concatenate([flat[flat != mark[0]], odd_ids]), np.concatenate([lengths, odd_lengths])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, each text's followed by ``END``; and where each text ends."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        together = pc.or_(pc.match_substring_regex(texts, _NOT_APART), pc.match_substring(texts, "\0"))
        for token in self.special:
            together = pc.or_(together, pc.match_substring(texts, token))
        whole = np.flatnonzero(together.to_numpy(zero_copy_only=False))
        cut = pc.if_else(together, "", texts) if len(whole) else texts
        for pattern, by in _CUTS:
            cut = pc.replace_substring_regex(cut, pattern, by)
        pieces = pc.split_pattern(cut, " ")
        offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        flat = pieces.flatten()
        coded = flat.dictionary_encode()
        names, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) + len(names) > self.keep:
            self.known, self.lengths, self.flat = {}, np.zeros(0, dtype=np.int32), np.zeros(0, dtype="<u4")
        place = np.fromiter(map(self.known.get, names, repeat(-1)), dtype=np.int32, count=len(names))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            is_plain = pc.match_substring_regex(coded.dictionary.take(pa.array(fresh)), _PLAIN).to_numpy(zero_copy_only=False)
            fresh = np.concatenate([fresh[is_plain], fresh[~is_plain]])
            new, n_plain = [names[i] for i in fresh.tolist()], int(is_plain.sum())
            ids, lengths = self._encode_pieces(new[:n_plain], new[n_plain:])
            place[fresh] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, place[fresh].tolist(), strict=True))
            self.flat, self.lengths = np.concatenate([self.flat, ids]), np.concatenate([self.lengths, lengths])
        place = place[index]
        # What comes without a blank before it: the first piece of each text, or the text that is taken whole.
        first = flat.take(pa.array(offsets[:-1])).to_pylist()
        for i in whole:
            first[i] = texts[int(i)].as_py()
        first_ids, first_lengths = self._encode(first)
        table = np.concatenate([self.flat, first_ids, np.array([END], dtype="<u4")])
        sizes = np.concatenate([self.lengths, first_lengths, np.ones(1, dtype=np.int32)])
        place[offsets[:-1]] = len(self.lengths) + np.arange(n)
        order = np.insert(place, offsets[1:], len(sizes) - 1)  # the end id after each text's pieces
        out_sizes = sizes[order]
        done = np.cumsum(out_sizes, dtype=np.int64)[offsets[1:] + np.arange(n)]
        return spread(table, (np.cumsum(sizes) - sizes)[order], out_sizes), done


# --- tables -------------------------------------------------------------------------------------

SHARDS = "shard int, block int, n_docs long, n_tokens long, payload binary"
DOCS = "shard int, block int, place int, doc_id long, before long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 20, rounds: int | None = None) -> DataFrame:
    """Encodes and stores all documents; the table of blocks, read from the stored files.

    Order: ascending id, null first; equal ids by a hash of the text. ``tokenizer_path`` is read by every worker.
    """

    def run(batches):
        shard, block = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(tokenizer_path)
        names: list = []
        held: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal block, names, held, ends, size
            payload = write_block(names, np.concatenate(held), np.concatenate(ends), encoder.vocabulary(), rounds)
            row = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())]
            block, names, held, ends, size = block + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(row, [f.split()[0] for f in SHARDS.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, stops = encoder.encode(part.column(1))
                names_here, done, row = part.column(0).to_pylist(), 0, 0
                while row < len(stops):
                    # as many documents as fit the block, one at least
                    upto = max(row + 1, int(np.searchsorted(stops, done + block_tokens - size, side="right")))
                    held.append(ids[done : stops[upto - 1]])
                    ends.append(stops[row:upto] - done + size)
                    names += names_here[row:upto]
                    size += int(stops[upto - 1] - done)
                    done, row = int(stops[upto - 1]), upto
                    if size >= block_tokens or row < len(stops):
                        yield flush()
        if names:
            yield flush()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hash"), F.monotonically_increasing_id().alias("row"))
    keys = ["doc_id", "hash", "row"]
    ordered = picked.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return stage(ordered.mapInArrow(run, SHARDS), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from the blocks; ``before``: ids before it within its block."""

    def run(batches):
        for batch in batches:
            for shard, number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = Block(payload.as_py())
                ids = expand(block.symbols, block.rules, block.terminals)
                stops = block.token_ends.astype(np.int64)
                starts = np.concatenate([[0], stops[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, stops, strict=True)]
                n = len(stops)
                cols = [pa.array(np.full(n, shard), pa.int32()), pa.array(np.full(n, number), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(block.doc_ids, pa.int64()), pa.array(starts), pa.array(stops - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in DOCS.split(", ")])

    return shards.select("shard", "block", "payload").mapInArrow(run, DOCS)


def corpus_offsets(shards: DataFrame) -> DataFrame:
    """``(shard, block, first)``: ids of the corpus before each block. Two levels, so that no task sees all blocks."""
    within = Window.partitionBy("shard").orderBy("block")
    over = Window.orderBy("shard")
    totals = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", (F.sum("n").over(over) - F.col("n")).alias("shard_first"))  # a row per partition
    blocks = shards.select("shard", "block", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("block_first"))
    return blocks.join(F.broadcast(before), "shard").select("shard", "block", (F.col("shard_first") + F.col("block_first")).alias("first"))


def token_ids(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all documents, from the stored shards."""
    shards = write_shards(docs, tokenizer_path, **options)
    found = read_documents(shards).join(corpus_offsets(shards), ["shard", "block"])
    return found.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
