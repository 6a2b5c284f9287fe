"""Best-fit packing by hierarchical residual packing.

Texts become token sequences (ids of a tokenizers file, then a separator id); sequences longer than the capacity are cut
into pieces. Level 0 packs chunks of each partition by best fit in decreasing order. Bins that are nearly full (at most
SLACK tokens are free) are final; all others are items of the next level, where they meet in fewer nodes, dealt by a
hash, and are packed again. A level has so many nodes that one gets about NODE_ITEMS items: where more bins stay underfull
than a node takes, levels keep several nodes instead of closing bins. The tree ends at a single node, or when a level has
more than half the nodes of the one before; best fit leaves at most one bin of each node half empty or more.

Defined results: a null text is an empty one and gives one piece, the separator; repeated rows give their own pieces; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlode.llm import common
from starlode.llm.merging import LONGEST, Merges

CAPACITY = 2048
SEPARATOR = 0
CHUNK = 65536
NODE_ITEMS = 32768
SLACK = 16
CACHE_WORDS = 500_000
#: Words that are looked up at once.
BLOCK_WORDS = 250_000
#: Bits of a bin's number: level, node, chunk of a partition, place in the node.
LEVEL_BITS, NODE_BITS, CHUNK_BITS, PLACE_BITS = 5, 24, 14, 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: The steps of the tokenizers files that are followed here: how texts are cleaned and taken apart.
CLEANED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
LETTER, NUMBER, MARK, END, OTHER = range(1, 6)
#: Characters from here on, and those that a rule of their own may start with, are left to the library.
BEYOND, RULED = 0x250, "'<"


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of every character below BEYOND and its lower case; all at BEYOND and above count as that one."""
    kind, small = np.full(BEYOND + 1, OTHER, np.int8), np.full(BEYOND + 1, ord("?"), np.uint32)
    for c in map(chr, range(0x21, BEYOND)):
        low = c.lower()
        found = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], MARK if c < "\x7f" and c not in RULED else OTHER)
        if found != OTHER and len(low) == 1 and ord(low) < BEYOND:
            kind[ord(c)], small[ord(c)] = found, ord(low)
    kind[ord("\n")] = END
    return kind, small


class WordIds:
    """Little-endian unsigned 32-bit ids of words between ASCII white space, remembered.

    The tokenizer drops white space and none of its rules reaches over it, so that the ids of a text are those of its
    words one after the other. Words that differ in ASCII case are one. New words of Latin letters, digits and ASCII marks
    are taken apart and merged many at once, as the tokenizer would; all others go through the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.merges = None
        with open(path, encoding="utf-8") as f:
            self.follow(json.load(f))

    def follow(self, rules: dict) -> None:
        """Takes the merges over, if the file's other rules are those that are followed here."""
        model, steps = rules["model"], (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
        plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        cleaned = (rules.get("normalizer") or {}).get("normalizers") == CLEANED
        split = len(steps) == 2 and steps[0] == SPLIT and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True)
        apart = rules.get("post_processor") is None and all("<" in t["content"] for t in rules.get("added_tokens", ()))
        vocab, letters = model["vocab"], byte_letters()
        if plain and cleaned and split and apart and all(x in vocab and x + "</w>" in vocab for x in letters):
            self.inner, self.last = (np.array([vocab[x + end] for x in letters], np.int32) for end in ("", "</w>"))
            pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
            self.merges = Merges(((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), max(vocab.values()) + 1)
            self.kind, self.small = kinds()

    def by_library(self, word: bytes) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def learn(self, words: list[bytes]) -> None:
        """Puts the ids of new words in."""
        most = 4 * LONGEST if self.merges else 0
        self.known.update((w, self.by_library(w)) for w in words if len(w) > most)
        if not (words := [w for w in words if len(w) <= most]):
            return
        points = np.minimum(np.frombuffer((b"\n".join(words) + b"\n").decode().encode("utf-32-le"), np.uint32), BEYOND)
        kind, points = self.kind[points], self.small[points]
        stops = np.flatnonzero(kind == END)
        edge = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)))
        # Where characters begin in UTF-8: those below BEYOND have two bytes at most.
        at = np.append(0, np.cumsum(1 + (points >= 0x80)))
        raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        first, end = at[edge], at[np.append(edge[1:], len(kind))]
        part = kind[edge] != END
        word, first, end, odd = np.searchsorted(stops, edge[part]), first[part], end[part], (kind[edge] == OTHER)[part]
        left_out = np.zeros(len(words), bool)
        left_out[word[odd | (end - first > LONGEST)]] = True
        taken = ~left_out[word]
        word, first, end = word[taken], first[taken], end[taken]
        symbols = self.inner[raw]
        symbols[end - 1] = self.last[raw[end - 1]]
        ids, counts = self.merges.merged(symbols, first, end - first)
        data, stop = ids.astype("<u4").tobytes(), 4 * np.cumsum(np.bincount(word, counts, len(words)).astype(np.int64))
        values = [data[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
        for i in np.flatnonzero(left_out).tolist():
            values[i] = self.by_library(words[i])
        self.known.update(zip(words, values, strict=True))

    def joined(self, rows: list[list[bytes]]) -> list[bytes]:
        """Ids of each row of words."""
        fresh = set().union(*rows).difference(self.known)
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = set().union(*rows)
        self.learn(list(fresh))
        return [b"".join(map(self.known.__getitem__, row)) for row in rows]

    def of_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        rows = [(data if b"<|" in (data := t.encode()) else data.lower()).split() for t in texts]
        if sum(map(len, rows)) <= BLOCK_WORDS:
            return self.joined(rows)
        return [b"".join(self.joined([row[i : i + BLOCK_WORDS]])[0] for i in range(0, len(row), BLOCK_WORDS)) for row in rows]

    def of(self, text: str) -> bytes:
        return self.of_all([text])[0]


def word_ids(path: str) -> WordIds:
    return common.held(f"words of {path}", lambda: WordIds(path))


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Best fit in decreasing order: bin and offset of each item, and the fill of each bin.

    Open bins hang in one list for each free size; a mask of the sizes in use finds the tightest one that fits.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, offsets, fill = [0] * len(lengths), [0] * len(lengths), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order:
        need = lengths[i]
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += need
        if room > need:
            free[room - need].append(b)
            mask |= 1 << (room - need)
    return bins, offsets, fill


def bin_base(level: int, node: int, chunk: int, bins: int) -> int:
    """The number of the first of so many bins; numbers of different levels, nodes or chunks never meet."""
    for value, bits in ((level, LEVEL_BITS), (node, NODE_BITS), (chunk, CHUNK_BITS), (bins - 1, PLACE_BITS)):
        if value >> bits:
            raise ValueError(f"level {level}, node {node}, chunk {chunk} with {bins} bins is beyond what bin numbers hold")
    return ((level << NODE_BITS | node) << CHUNK_BITS | chunk) << PLACE_BITS


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, up boolean"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, chunk: int = CHUNK) -> DataFrame:
    """Level 0: tokens of every whole text, cut and packed within chunks of a partition."""
    docs = docs.select("doc_id", "text")
    common.prepare(docs.sparkSession)
    tail = separator.to_bytes(4, "little")

    def flush(rows: list[tuple], number: int, part: int) -> pa.RecordBatch:
        bins, offsets, fill = best_fit([r[3] for r in rows], capacity)
        first = bin_base(0, part, number, len(fill))
        columns = list(zip(*rows, strict=True))
        return common.batch_of(
            doc_id=pa.array(columns[0], pa.int64()), piece=pa.array(columns[1], pa.int32()), start=pa.array(columns[2], pa.int64()),
            length=pa.array(columns[3], pa.int64()), ids_crc32=pa.array(columns[4], pa.int64()), bin=pa.array([first + b for b in bins], pa.int64()),
            offset=pa.array(offsets, pa.int64()), fill=pa.array([fill[b] for b in bins], pa.int64()), up=pa.array([fill[b] < capacity - SLACK for b in bins], pa.bool_()),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, number = word_ids(tokenizer), [], 0
        part = TaskContext.get().partitionId()
        for batch in common.slices(batches):
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), ids.of_all([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                data += tail
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                if len(rows) >= chunk:
                    yield flush(rows, number, part)
                    rows, number = [], number + 1
        if rows:
            yield flush(rows, number, part)

    return docs.mapInArrow(run, PIECES)


def merged(items: DataFrame, level: int, nodes: int, capacity: int = CAPACITY) -> DataFrame:
    """One level of the tree: items (bin, fill), dealt to so many nodes, packed anew into (bin, to, added, fill, up)."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        bins, offsets, fill = best_fit(table["fill"].to_pylist(), capacity)
        first = bin_base(level, table["node"][0].as_py(), 0, len(fill))
        return pa.table({
            "bin": table["bin"], "to": pa.array([first + b for b in bins], pa.int64()), "added": pa.array(offsets, pa.int64()),
            "fill": pa.array([fill[b] for b in bins], pa.int64()), "up": pa.array([fill[b] < capacity - SLACK for b in bins], pa.bool_()),
        })

    dealt = items.select(F.pmod(F.xxhash64("bin"), F.lit(nodes)).alias("node"), "bin", "fill")
    return dealt.groupBy("node").applyInArrow(pack, "bin long, to long, added long, fill long, up boolean")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, chunk: int = CHUNK, node_items: int = NODE_ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    base = common.written(pieces(docs, tokenizer, capacity, separator, chunk), "pieces")
    items = base.where("up and offset = 0").select("bin", "fill")
    moves, level, before = None, 0, None
    # Every level but the last has at most half the nodes of the one before, so that LEVEL_BITS suffice for any table.
    while moves is None or 1 < nodes <= before / 2:
        before, level = nodes if level else math.inf, level + 1
        nodes = max(1, -(-items.count() // node_items))
        step = common.written(merged(items, level, nodes, capacity), f"level{level}")
        # Each packed bin is one item of the next level: its row with nothing before it stands for it.
        items = step.where("up and added = 0").select(F.col("to").alias("bin"), "fill")
        hop = step.select("bin", "to", "added")
        if moves is None:
            moves = hop
        else:
            later = hop.select(F.col("bin").alias("to"), F.col("to").alias("next"), F.col("added").alias("more"))
            moves = moves.join(later, "to", "left").select("bin", F.coalesce("next", "to").alias("to"), (F.col("added") + F.coalesce("more", F.lit(0))).alias("added"))
    final = base.where("not up").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    carried = base.where("up").join(moves, "bin").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("to").alias("sequence_id"), (F.col("offset") + F.col("added")).alias("offset"))
    return final.unionAll(carried)
