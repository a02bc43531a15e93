"""Packing token sequences by best-fit decreasing: pieces of documents, longest first, each enter the open sequence with the least room that still holds them. A segment tree over remaining capacities finds it in logarithmic time.

Documents are tokenized and end with a token of their own. Only documents longer than a sequence are cut, into full pieces and a last one. Pieces are dealt by a hash into groups of about GROUP pieces, and each group is packed on its own, so that no task sees the whole; a group leaves at most a few sequences partly empty.

Null and empty texts are documents of the end token alone. Repeated rows are packed as often as they occur. Very long texts are tokenized word by word. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut

LENGTH = 4096
END = 1
GROUP = 20_000
#: Words, and parts of words, whose tokens a worker remembers, at most.
REMEMBERED = 500_000


class Words(dict):
    """The token ids of words, as little-endian unsigned 32-bit integers; tokens never span white space, so a text's tokens are those of its words."""

    #: The vocabulary's own pattern of pre-tokens.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Letters on which all versions of Unicode agree; other words are cut by the tokenizer itself.
    PLAIN = re.compile("[!-~\xa1-\u052f]*")
    #: Texts with these go through the tokenizer whole: special tokens, and characters that Python alone takes for white space.
    WHOLE = re.compile(r"<\|(?:startoftext|endoftext)\|>|[\x1c-\x1f]")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.parts = self.tokenizer.model, {}
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if not self.PLAIN.fullmatch(word):
            parts = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]
            self[word] = found = pack_ids([t.id for p in parts for t in self.model.tokenize(p)])
            return found
        parts = self.PATTERN.findall(word)
        self[word] = found = self.part(parts[0]) if len(parts) == 1 else b"".join(map(self.part, parts))
        return found

    def part(self, part: str) -> bytes:
        """The ids of a pre-token. The byte alphabet leaves ASCII as it is."""
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            plain = part if part.isascii() and part.isprintable() else self.bytes.pre_tokenize_str(part)[0][0]
            ids = [t.id for t in self.model.tokenize(plain)]
            self.parts[part] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def ids(self, text: str) -> bytes:
        if self.WHOLE.search(text):
            return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.__getitem__, text.lower().split()))


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_held: dict[str, Words] = {}


def vocabulary(path: str | None) -> Words:
    """One for each worker process. path: a file of the tokenizers library; None for the public word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _held:
        _held[path] = Words(path)
    return _held[path]


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, tokenizer: str | None = None, tokens: bool = False) -> DataFrame:
    """key, piece, start, length and ids_crc32 for each piece of each document; with tokens also the ids, as bytes."""
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    schema = T.StructType([rows.schema["key"], *[T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32")], *[T.StructField("ids", T.BinaryType())] * tokens])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer)
        last = end.to_bytes(4, "little")
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = words.ids(t or "") + last
                for k, start in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[start : start + 4 * length]
                    at.append(i)
                    out.append((k, start // 4, len(part) // 4, zlib.crc32(part), *[part] * tokens))
            columns = list(zip(*out, strict=True)) or [()] * (4 + tokens)
            kinds = [pa.int64()] * 4 + [pa.binary()] * tokens
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    return rows.mapInArrow(cut_up, schema).withColumnRenamed("key", key)


class Rooms:
    """Open sequences by remaining room: a segment tree over rooms 0 to size, whose nodes count the sequences below them."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.counts, self.open = [0] * (2 * self.leaves), [[] for _ in range(self.leaves)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.counts[i] += n
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest room of at least this, and a sequence that has it."""
        i = least + self.leaves
        while not self.counts[i]:
            while i & 1:  # a right child: what lies further right is beside an ancestor
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.counts[2 * i] else 2 * i + 1
        self._add(i - self.leaves, -1)
        return i - self.leaves, self.open[i - self.leaves].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; no piece is longer than the capacity."""
    rooms, places, opened = Rooms(capacity), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            found, opened = (capacity, opened), opened + 1
        room, sequence = found
        places[i] = sequence, capacity - room
        if room > lengths[i]:
            rooms.put(room - lengths[i], sequence)
    return places


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset."""
    pieces = cut(pieces)
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(pieces.columns[0], "piece", "ids_crc32"), F.lit(groups)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", pdf.columns[0], "piece"], ascending=[False, True, True])
        places = best_fit_decreasing(pdf["length"].tolist(), length)
        at = int(pdf["group"].iloc[0]) << 32
        return pdf.drop(columns="group").assign(sequence_id=[at + s for s, _ in places], offset=[o for _, o in places])

    return dealt.groupBy("group").applyInPandas(fill, schema)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, tokenizer: str | None = None, group: int = GROUP) -> DataFrame:
    return pack(pieces(df, key, text, length, end, tokenizer), length, group)
