"""Packing documents into fixed-length sequences, shortest pack first over the length histogram (operator 6).

Each document becomes its token ids and one end id. Whatever exceeds a sequence is cut into pieces of full length and a
rest, so every piece has 1 to ``MAX_TOKENS`` tokens. Only the histogram of piece lengths (at most ``MAX_TOKENS`` numbers)
reaches the driver. Lengths are placed longest first; each group of pieces of one length goes into the open patterns
with the *most* room left (the shortest packs), as long as it fits; what finds no room opens new patterns. A pattern is a
list of lengths with a count of sequences, and is split when only some of its sequences get a further piece.

Patterns are joined back to the pieces by rank: piece number r of its length belongs to the slot whose range of ranks
holds r. Ranks come from a histogram over hash buckets, so a length that a third of all pieces share still spreads over
many tasks; repeated rows differ by their place in the written table. Placing a length adds at most two patterns, so there
are no more than ``2 * MAX_TOKENS`` patterns whatever the corpus: their slots are broadcast, by parts of the ranks.

Null text counts as empty: one end id. Repeated rows and null ids are packed like any other row. Very long texts are
encoded slice by slice at places where the tokenizer splits anyway. An empty table gives an empty result. Extra columns
are not read. ``pieces(..., with_ids=True)`` also carries the ids of every piece.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm.common import arrow_batches, query, table
from topicweave.operators.ranking import rank_in_group
from topicweave.session import staged

MAX_TOKENS = 2048
END_ID = 1
#: entries of the table of cuts; with its ids it takes about 75 bytes an entry
MAX_CUTS = 450_000
CUT_BYTES = 23
SLICE_CHARS = 1 << 19
BATCH_BYTES = 1 << 20
RANK_BUCKETS = 1024
TOKENIZER = "byte_bpe_50k.json"
BORDER = re.compile(r"\S ")
#: how a byte-level vocabulary writes a space and a line break
SPACE_LETTER, BREAK_LETTER = "\u0120", "\u010a"
#: bytes that are a visible ASCII character, an ASCII letter, the last byte of E2 80 .. white space
SEEN = np.isin(np.arange(256), np.arange(33, 127))
ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
ASCII_SIGN = SEEN & ~ASCII_LETTER & ~np.isin(np.arange(256), np.arange(48, 58))
WIDE_SPACE = np.isin(np.arange(256), [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF])
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class CutTable:
    """Token ids of cuts of at most ``CUT_BYTES`` bytes, by the cut's own bytes: three numbers, the last one's top byte is
    the cut's length. Places are found by a hash, with the next free place for a taken one; keys are always compared."""

    def __init__(self, size: int = 1 << 12):
        self.places = np.full(4 * size, -1, np.int32)
        self.keys = np.zeros((size, 3), np.uint64)
        self.begin, self.length = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.ids = np.zeros(4 * size, np.uint32)
        self.n = self.used = 0

    @staticmethod
    def keys_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keys of the cuts in ``data``, which 24 bytes of anything follow."""
        words = np.ndarray(len(data) - 7, "<u8", buffer=data, strides=(1,))
        keys = np.empty((len(starts), 3), np.uint64)
        for k in range(3):
            keys[:, k] = words[starts + 8 * k] & FIRST_BYTES[np.clip(sizes - 8 * k, 0, 8)]
        keys[:, 2] |= sizes.astype(np.uint64) << np.uint64(56)
        return keys

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * MIX[0] ^ keys[:, 1] * MIX[1] ^ keys[:, 2] * MIX[2]
        h = (h ^ (h >> np.uint64(29))) * MIX[0]
        return (h >> np.uint64(32)).astype(np.int64) & (len(self.places) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 for those not there."""
        place = self._home(keys)
        out = self.places.take(place)
        wrong = np.flatnonzero((out >= 0) & ~self._same(out, keys))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & (len(self.places) - 1)
            out[wrong] = self.places[place[wrong]]
            wrong = wrong[(out[wrong] >= 0) & ~self._same(out[wrong], keys[wrong])]
        return out.astype(np.int64)

    def _same(self, entries: np.ndarray, keys: np.ndarray) -> np.ndarray:
        held = self.keys.take(entries, 0, mode="wrap")
        held ^= keys
        return (held[:, 0] | held[:, 1] | held[:, 2]) == 0

    def _enter(self, entries: np.ndarray) -> None:
        place = self._home(self.keys[entries])
        while len(entries):
            free = self.places[place] < 0
            self.places[place[free]] = entries[free]  # of several the last one stays
            left = self.places[place] != entries
            entries, place = entries[left], (place[left] + 1) & (len(self.places) - 1)

    def reserve(self, more: int) -> None:
        """Make room for ids behind those in use."""
        if self.used + more > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + more))

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Enter distinct new keys with their ids, one after the other in ``ids``; returns their entries."""
        n = self.n + len(keys)
        if n > len(self.keys):
            size = max(2 * len(self.keys), n)
            self.keys = np.resize(self.keys, (size, 3))
            self.begin, self.length = np.resize(self.begin, size), np.resize(self.length, size)
        entries = np.arange(self.n, n)
        self.reserve(len(ids))
        self.keys[entries], self.length[entries] = keys, lengths
        self.begin[entries] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = n, self.used + len(ids)
        if 2 * n > len(self.places):
            self.places = np.full(1 << (4 * n).bit_length() - 1, -1, np.int32)
            self._enter(np.arange(n))
        else:
            self._enter(entries)
        return entries


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, the same as encoding the whole text at once.

    A byte-level tokenizer never puts a character that is no white space and the white space after it into one token, nor
    a letter and a sign after it. So a text may be cut before each such space, before a line break between two characters
    that are no white space, and before an ASCII sign after a letter. Cuts are found in the bytes
    of many texts at once, and their ids are remembered in a table bounded by its entries that all tasks of a Python
    worker share. New words of letters go to the tokenizer's model alone; other new cuts go through the whole tokenizer.
    Of both, those that start with a space go as lines, told apart by the tokens that start with one. Cuts too long for the
    table are encoded each time. Any other kind of tokenizer encodes whole texts.
    """

    shared: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.cuts_words = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and kind["normalizer"] is None and kind["model"]["type"] == "BPE"
        )
        self.table = CutTable()
        self.words = Tokenizer(self.tokenizer.model)  # words of letters are one piece for the model
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes a byte-level vocabulary writes as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        vocab = self.tokenizer.get_vocab()
        self.from_space = np.zeros(max(vocab.values()) + 1, bool)
        self.from_space[[i for token, i in vocab.items() if token.startswith(SPACE_LETTER)]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    @staticmethod
    def cuts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where cuts start in the UTF-8 ``data`` of texts that start at ``firsts``; the last byte is a space behind them."""
        first = np.zeros(len(data), bool)
        first[firsts] = True
        first[-1] = True

        def no_space_before(at: np.ndarray) -> np.ndarray:
            """Is the character before white space? Wider ones are told by their last bytes."""
            a, b, c = data[at - 1], data[at - 2], data[at - 3]
            wide = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE2) & (b == 0x81) & (a == 0x9F)
            wide |= (c == 0xE3) & (b == 0x80) & (a == 0x80) | (c == 0xE2) & (b == 0x80) & WIDE_SPACE[a]
            return SEEN[a] | (a > 127) & ~wide

        at = np.flatnonzero((data == 32) & ~first)
        spaces = at[no_space_before(at)]
        at = np.flatnonzero((data == 10) & ~first)
        breaks = at[(SEEN[data[np.minimum(at + 1, len(data) - 1)]]) & ~first[np.minimum(at + 1, len(data) - 1)]]
        breaks = breaks[no_space_before(breaks)]
        # a sign after an ASCII letter or one of C3 80 to C3 BF
        at = np.flatnonzero(ASCII_SIGN[data] & ~first)
        a, b = data[at - 1], data[at - 2]
        marks = at[ASCII_LETTER[a] | (b == 0xC3) & (a > 127) & (a != 0x97) & (a != 0xB7)]
        first[spaces] = first[breaks] = first[marks] = True
        first[-1] = False
        return np.flatnonzero(first)

    @staticmethod
    def segments(text: str) -> Iterator[str]:
        """A text cut at borders into parts of about ``SLICE_CHARS``; later parts start with their border's space."""
        at = 0
        while len(text) - at > SLICE_CHARS:
            border = BORDER.search(text, at + SLICE_CHARS)
            if border is None:
                break
            yield text[at : border.end() - 1]
            at = border.end() - 1
        yield text[at:]

    def _written(self, word: str) -> str:
        """A word of letters as the vocabulary writes it."""
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _lines(self, tokenizer, cuts: list[str], joint: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts that start with their only space and have no white space at their end, and how many each has."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(cuts), 512):
            found = tokenizer.encode_batch_fast([joint.join(cuts[lo : lo + 512])], add_special_tokens=False)[0]
            ids.append(np.asarray(found.ids, np.uint32))
            lengths.append(np.diff(np.flatnonzero(self.from_space[ids[-1]]), append=len(ids[-1])))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuts, one after the other, and how many each has."""
        words, line, rest = [], [], []
        for i, c in enumerate(new):
            if c[0] != " ":
                rest.append(i)
            elif c[1:].isalpha():
                words.append(i)
            else:
                (rest if len(c) == 1 or " " in c[1:] or c[-1].isspace() else line).append(i)
        found = [
            self._lines(self.words, [SPACE_LETTER + self._written(new[i][1:]) for i in words], " "),
            self._lines(self.tokenizer, [new[i] for i in line], ""),
        ]
        model, late = self.tokenizer.model.tokenize, []
        broken = [x.id for x in model(BREAK_LETTER)]
        for i in rest:
            c = new[i]
            if c[c[0] == "\n" :].isalpha():
                late.append(broken * (c[0] == "\n") + [x.id for x in model(self._written(c.lstrip("\n")))])
            else:
                late.append(self.tokenizer.encode_batch_fast([c], add_special_tokens=False)[0].ids)
        found.append((np.asarray([x for ids in late for x in ids], np.uint32), np.asarray([*map(len, late)], np.int64)))
        # back into the order of the cuts
        order = np.asarray([*words, *line, *rest], np.int64)
        lengths, begin = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        lengths[order] = together = np.concatenate([n for _, n in found])
        begin[order] = np.cumsum(together) - together
        return np.concatenate([ids for ids, _ in found])[spread(begin, lengths)], lengths

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuts_words or not texts:
            return self._plain(texts)
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = b"".join([*raw, b" " * 25])
        data = np.frombuffer(whole, np.uint8)
        ends = np.cumsum(size)
        starts = self.cuts(data[: int(ends[-1]) + 1], (ends - size)[size > 0])
        if not len(starts):
            return [b""] * len(texts)
        stops = np.append(starts[1:], ends[-1])
        sizes, table = stops - starts, self.table
        if table.n > MAX_CUTS:
            table = self.table = CutTable()
        short = np.flatnonzero(sizes <= CUT_BYTES)
        keys = table.keys_of(data, starts[short], sizes[short])
        entry = table.find(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            k = keys[missing]
            order = np.lexsort((k[:, 0], k[:, 1], k[:, 2]))
            k = k[order]
            head = np.r_[True, (k[1:] != k[:-1]).any(axis=1)]
            at = short[missing[order[head]]]
            cuts = [whole[a:b].decode() for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
            entry[missing[order]] = table.add(k[head], *self._learn(cuts))[np.cumsum(head) - 1]
        begin, length = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begin[short], length[short] = table.begin.take(entry), table.length.take(entry)
        if len(short) < len(starts):
            long = np.flatnonzero(sizes > CUT_BYTES)
            cuts = [whole[a:b].decode() for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True)]
            number = {c: i for i, c in enumerate(dict.fromkeys(cuts))}
            ids, lengths = self._learn([*number])
            table.reserve(len(ids))  # behind the table's ids for now
            table.ids[table.used : table.used + len(ids)] = ids
            place = np.asarray([number[c] for c in cuts])
            begin[long], length[long] = (table.used + np.cumsum(lengths) - lengths)[place], lengths[place]
        upto = np.r_[0, np.cumsum(length)]
        ids = table.ids.take(spread(begin, length), mode="clip").astype("<u4", copy=False).tobytes()
        at = (upto[np.searchsorted(starts, np.r_[0, ends])] * 4).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def encoded(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of every text; of many short ones at once, of a long one slice by slice."""
        short: list[str] = []
        room = SLICE_CHARS
        for text in texts:
            if len(text) > SLICE_CHARS and self.cuts_words:
                yield from self(short)
                short, room = [], SLICE_CHARS
                yield b"".join(self([part])[0] for part in self.segments(text))
                continue
            short.append(text)
            room -= len(text)
            if room < 0:
                yield from self(short)
                short, room = [], SLICE_CHARS
        yield from self(short)


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of stretches one after the other."""
    upto = np.cumsum(length)
    return np.repeat(begin - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)


def _piece_batches(path: str, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    width = MAX_TOKENS * 4
    end = np.asarray([END_ID], "<u4").tobytes()

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        doc, start, crc, tokens, parts = zip(*rows)
        sizes = np.fromiter(map(len, parts), np.int64) // 4
        cols = [pa.array(doc, kind), *[pa.array(np.asarray(c, np.int64)) for c in (start, sizes, crc, tokens)]]
        if with_ids:  # one flat buffer for all ids
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            cols.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(parts))])))
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(path)
        for batch in batches:
            kind, rows, held = batch.schema.field(0).type, [], 0
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc, data in zip(batch.column(0), encode.encoded(texts), strict=True):
                data, doc = data + end, doc.as_py()
                for at in range(0, len(data), width):
                    part = data[at : at + width]
                    rows.append((doc, at // 4, zlib.crc32(part), len(data) // 4, part))
                    held += len(part)
                if held > BATCH_BYTES:
                    yield made(rows, kind)
                    rows, held = [], 0
            if rows:
                yield made(rows, kind)

    return run


def pieces(docs: DataFrame, tokenizer: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, and on request their ids."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return narrow.mapInArrow(_piece_batches(tokenizer, with_ids), schema)


def chunked(found: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """Slots by parts of their length's ranks: (length, width) and (length, part, slot), so that a rank looks at the few
    slots that reach into its part. There are at most three times as many rows as slots."""
    by_length: dict[int, list[tuple]] = {}
    for slot in found:
        by_length.setdefault(slot[0], []).append(slot)
    widths, rows = [], []
    for length, listed in by_length.items():
        width = -(-max(s[2] for s in listed) // len(listed))
        widths.append((length, width))
        rows += [(length, part, *slot[1:]) for slot in listed for part in range(slot[1] // width, slot[2] // width + 1)]
    return widths, rows


def shortest_pack_first(histogram: dict[int, int], room: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of sequences) for a histogram of lengths, by shortest-pack-first."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left -> patterns with their counts

    def put(pattern: tuple[int, ...], count: int) -> None:
        if count:
            open_by_room.setdefault(room - sum(pattern), []).append((pattern, count))

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        while left:
            spot = max((r for r, found in open_by_room.items() if found and r >= length), default=None)
            if spot is None:
                # a new pack is the one with most room: it takes as many pieces of this length as it holds
                each = room // length
                put((length,) * each, left // each)
                put((length,) * (left % each), min(1, left % each))
                break
            pattern, count = open_by_room[spot].pop()
            take = min(count, left)
            put(pattern, count - take)
            put((*pattern, length), take)
            left -= take
    return [x for found in open_by_room.values() for x in found]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Per slot of each pattern: length, first and last rank (1-based), sequence of the first rank, offset."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, count in patterns:
        offset = 0
        for n in lengths:
            first = rank.get(n, 0) + 1
            rank[n] = first + count - 1
            out.append((n, first, rank[n], sequence, offset))
            offset += n
        sequence += count
    return out


def pack(parts: DataFrame) -> DataFrame:
    """Add sequence_id and offset to pieces that have been written out (``parts`` is read several times)."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    widths, rows = chunked(slots(shortest_pack_first(histogram)))
    width_table = spark.createDataFrame(widths, "width_length bigint, width bigint")
    slot_table = spark.createDataFrame(rows, "slot_length bigint, part bigint, first bigint, last bigint, base bigint, offset bigint")
    names = ["doc_id", "start", "ids_crc32", "doc_tokens", "row_no"]
    bucketed = parts.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(RANK_BUCKETS)))
    ranked = rank_in_group(bucketed, ["length"], "_bucket", [F.col(c) for c in names], "_rank")
    parted = ranked.join(F.broadcast(width_table), F.col("length") == F.col("width_length"))
    parted = parted.withColumn("_part", F.floor(F.col("_rank") / F.col("width")))
    fits = (F.col("length") == F.col("slot_length")) & (F.col("_part") == F.col("part")) & F.col("_rank").between(F.col("first"), F.col("last"))
    placed = parted.join(F.broadcast(slot_table), fits)
    sequence = F.col("base") + F.col("_rank") - F.col("first")
    return placed.select(*[c for c in parts.columns if c != "row_no"], sequence.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    parts = pieces(docs, tokenizer or default_tokenizer(), with_ids)
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        written = staged(parts.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    return pack(written)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
