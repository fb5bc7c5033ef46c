"""BPE encoding and decoding through a distinct-word table.

Texts are split into words as the tokenizer splits them, a chunk of documents at a time; a chunk
keeps its distinct words once and each document as positions into them. Each distinct word of the
corpus is encoded once. Ids come back by the word's number in each chunk, and ids turn into pieces
by a join with the vocabulary, which is a table of fixed size.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchlens.llm.common import new_folder, stored

#: Characters of text in a chunk of documents; a longer document is a chunk of its own.
CHUNK_CHARS = 16_000_000
#: Words, or tokens, whose numbers, ids and texts are laid out at a time: places take eight bytes a character.
SPELT_WORDS = 1 << 15
#: The split of the word tokenizer, a fixed value of its file, as a Python pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same, with the ends of lines as marks between tokens.
SPLIT = regex.compile(r"\n|" + WORDS.pattern)
#: Marks a token that is one word; no other token holds this character.
SINGLE = "\x1c"
#: Texts of these characters alone lower and normalise alike everywhere; others go through the library.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x7e\xa1-\xac\xae-ȳ]*\Z")

class Splitter:
    """The tokenizer's own words of a text, special tokens included, in order."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.added)))

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not any(t in text for t in self.added):
            return self._plain(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append("\0" + found[0])  # a zero marks them: no word of the pattern holds a zero and letters
            at = found.end()
        return out + self._plain(text[at:])

    def tokens(self, text: str | None) -> list[str]:
        """Tokens whose words (`words_of`), one token after the other, are the text's: what blanks part, or single words marked by SINGLE."""
        if not text:
            return []
        if PLAIN.match(text) and not any(t in text for t in self.added):
            return text.lower().split()
        return [SINGLE + w for w in self(text)]

    def _plain(self, text: str) -> list[str]:
        if PLAIN.match(text):
            return WORDS.findall(text.lower())
        text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def words_of(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(start, length) of every token in a list of word numbers, the distinct words, and that list."""
    lines = [t for t in tokens if not t.startswith(SINGLE)]
    found = [*SPLIT.findall("\n".join([*lines, ""])), *(t[1:] for t in tokens if t.startswith(SINGLE))]
    known = {w: i for i, w in enumerate(dict.fromkeys(["\n", *found]))}
    numbers = np.fromiter(map(known.__getitem__, found), np.uint32, len(found))
    ends = np.flatnonzero(numbers == 0)[: len(lines)]
    first = np.concatenate([[0], ends + 1]).astype(np.int64)
    single = np.array([t.startswith(SINGLE) for t in tokens], bool)
    starts, lengths = np.empty(len(tokens), np.int64), np.ones(len(tokens), np.int64)
    starts[~single], lengths[~single] = first[:-1], ends - first[:-1]
    starts[single] = first[-1] + np.arange(single.sum())
    return starts, lengths, list(known)[1:], numbers - 1  # the marks between lines are never used


class WordEncoder:
    """Ids of one word of a `Splitter`."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        self.special = {"\0" + t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def __call__(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.model.tokenize(byte_letters(word))]


def _letters() -> dict[int, str]:
    """One printable letter for each byte: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _letters()


def byte_letters(word: str) -> str:
    return "".join(map(LETTERS.__getitem__, word.encode()))


def _pack(numbers: np.ndarray, n_words: int) -> bytes:
    """Word numbers as compressed bytes, low bytes first: frequent words have low numbers."""
    width = 2 if n_words <= 65536 else 4
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(packed: bytes, n_words: int) -> np.ndarray:
    width = 2 if n_words <= 65536 else 4
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def chunks(docs: DataFrame, path: str, id_col: str, text: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Documents split into words; a row per chunk: its distinct words, and its documents by word number.

    Chunk numbers are unique within one run of the plan, so the result is to be stored before it is used.
    """
    fields = [
        ("chunk", "long", pa.int64()), ("words", "array<string>", pa.list_(pa.string())), ("ids", "array<long>", pa.list_(pa.int64())),
        ("lengths", "array<int>", pa.list_(pa.int32())), ("numbers", "binary", pa.binary()),
    ]

    def row(chunk: int, ids: list, ends: list, tokens: dict[str, int], refs: array) -> pa.RecordBatch:
        starts, lengths, words, numbers = words_of(list(tokens))
        used = np.frombuffer(refs, np.uint32)
        until = np.zeros(len(used) + 1, np.int64)
        np.cumsum(lengths.astype(np.int32)[used], out=until[1:])
        until = until[ends]
        parts = np.array_split(used, len(used) // SPELT_WORDS + 1)
        numbers = np.concatenate([numbers[_ranges(starts[part], lengths[part])] for part in parts])
        names = np.array(words, object)
        counts = sum(np.bincount(part, minlength=len(names)) for part in np.array_split(numbers, len(numbers) // SPELT_WORDS + 1))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        values = chunk, names[order].tolist(), ids, np.diff(until, prepend=0), _pack(rank[numbers], len(names))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, _, t) in zip(values, fields, strict=True)], [f[0] for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chunk = Splitter(path), TaskContext.get().partitionId() << 32
        ids, ends, tokens, refs, held = [], [], {}, array("I"), 0
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if held and held + len(value or "") > chunk_chars:
                        yield row(chunk, ids, ends, tokens, refs)
                        chunk += 1
                        ids, ends, tokens, refs, held = [], [], {}, array("I"), 0
                    found = split.tokens(value)
                    for token in set(found).difference(tokens):
                        tokens[token] = len(tokens)
                    refs.extend(map(tokens.__getitem__, found))
                    ids.append(doc)
                    ends.append(len(refs))
                    held += len(value or "") + 1
        if ids:
            yield row(chunk, ids, ends, tokens, refs)

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return base.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind, _ in fields))


def stored_by_chunk(split: DataFrame) -> DataFrame:
    """`chunks` as a table bucketed by chunk in the shared folder: its word numbers are not shuffled later."""
    spark = split.sparkSession
    folder = new_folder(spark, "chunks")
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split.write.bucketBy(buckets, "chunk").option("path", folder).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def encode_words(places: DataFrame, path: str) -> DataFrame:
    """(chunk, no, ids) for (chunk, no, word): rows meet by word, and each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, ids = WordEncoder(path), None, None
        for batch in batches:
            out = []
            for word in batch.column(2).to_pylist():
                if word != last:
                    last, ids = word, encode(word)
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["chunk", "no", "ids"])

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.select("chunk", "no", "word").repartition(n, "word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, "chunk long, no int, ids array<int>")


def pieces_of(ids: DataFrame, vocabulary: DataFrame) -> dict[int, str]:
    """The pieces of the distinct ids in a column `id`, by a join with the vocabulary (id, piece).

    The result has at most as many rows as the vocabulary, a file of fixed size. Ids without a piece have none.
    """
    return {r.id: r.piece for r in ids.distinct().join(vocabulary, "id").collect()}


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the whole vocabulary, added tokens included: as many rows as the file has."""
    pieces = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, p) for p, i in pieces.items()], "id int, piece string")


class Spelling:
    """The texts of ids, each with a blank in front, as one pool of bytes."""

    def __init__(self, texts: dict[int, bytes], n: int):
        spelt = [b" " + texts[i] if i in texts else b"" for i in range(n)]
        self.lengths = np.array([len(t) for t in spelt], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(spelt), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The texts of `ids` in a row, and where each begins, with the end of the last."""
        lengths = self.lengths[ids]
        return self.pool[_ranges(self.starts[ids], lengths)].tobytes(), np.concatenate([[0], np.cumsum(lengths)])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _per_document(docs: DataFrame, path: str, id_col: str, text: str, chunk_chars: int, columns: list[tuple], make: Callable) -> DataFrame:
    """A row per document: its id and what ``make()`` has gathered, fed with (ids, their decimal text, their pieces) part by part."""
    spark = docs.sparkSession
    split = stored_by_chunk(chunks(docs, path, id_col, text, chunk_chars))
    coded = stored(encode_words(split.select("chunk", F.posexplode("words").alias("no", "word")), path), "codes")
    pieces = spark.sparkContext.broadcast(pieces_of(coded.select(F.explode("ids").alias("id")), vocabulary(spark, path)))
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [(id_col, "long"), *columns]
    spellings: list[Spelling] = []

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not spellings:  # once in a task
            n = max(pieces.value, default=0) + 1
            spellings.extend([Spelling({i: str(i).encode() for i in range(n)}, n), Spelling({i: p.encode() for i, p in pieces.value.items()}, n)])
        coded_ids = right.column("ids").combine_chunks()
        flat, bounds = coded_ids.values.to_numpy(), coded_ids.offsets.to_numpy()
        order = np.argsort(right.column("no").to_numpy())
        starts, lengths = bounds[:-1][order].astype(np.int64), np.diff(bounds)[order].astype(np.int64)
        parts = []
        for i in range(left.num_rows):
            chunk = left.slice(i, 1)
            numbers = _unpack(chunk.column("numbers")[0].as_py(), len(order))
            ends = np.cumsum(chunk.column("lengths")[0].values.to_numpy(), dtype=np.int64)
            parts += documents(chunk.column("ids")[0].as_py(), ends, numbers, flat, starts, lengths)
        return pa.concat_tables(parts) if parts else rows_table([])

    def documents(names, ends, numbers, flat, starts, lengths) -> list[pa.Table]:
        """Rows of a chunk's documents, whose words end at `ends`; a few hundred thousand words are spelt at a time."""
        parts, rows, doc, gathered, at = [], [], 0, make(), 0
        for start in range(0, max(1, len(numbers)), SPELT_WORDS):
            stop = min(len(numbers), start + SPELT_WORDS)
            own = numbers[start:stop]
            ids = flat[_ranges(starts[own], lengths[own])]
            first = np.concatenate([[0], np.cumsum(lengths[own])])
            spelt = [s(ids) for s in spellings]
            while doc < len(names):
                to = min(int(ends[doc]), stop)
                a, b = first[at - start], first[to - start]
                gathered.add(ids[a:b], *(whole[where[a] : where[b]] for whole, where in spelt))
                at = to
                if ends[doc] > stop:
                    break
                rows.append((names[doc], *gathered.done()))
                doc, gathered = doc + 1, make()
                if len(rows) == 1024:
                    parts.append(rows_table(rows))
                    rows = []
        return [*parts, rows_table(rows)]

    def rows_table(rows: list[tuple]) -> pa.Table:
        columns_ = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
        return pa.table([pa.array(c, types[kind]) for c, (_, kind) in zip(columns_, fields, strict=True)], names=[f[0] for f in fields])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields)
    whole = split.select("chunk", "ids", "lengths", "numbers")
    return whole.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(run, schema)


class _Whole:
    """Ids and decoded text of one document."""

    def __init__(self):
        self.ids, self.text = [], []

    def add(self, ids: np.ndarray, written: bytes, spoken: bytes) -> None:
        self.ids.append(ids)
        self.text.append(spoken)

    def done(self) -> tuple:
        ids = np.concatenate(self.ids)
        return len(ids), ids, b"".join(self.text)[1:].decode()


class _Digest:
    """Number of ids, and hashes of their decimal text and of their pieces, of one document."""

    def __init__(self):
        self.n, self.sides = 0, [[hashlib.sha256(), 1], [hashlib.sha256(), 1]]  # the first blank of a text is left out

    def add(self, ids: np.ndarray, written: bytes, spoken: bytes) -> None:
        self.n += len(ids)
        for side, part in zip(self.sides, (written, spoken), strict=True):
            if part:
                side[0].update(part[side[1] :])
                side[1] = 0

    def done(self) -> tuple:
        return self.n, *(side[0].hexdigest() for side in self.sides)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id, n_tokens, ids, decoded) for every row of `docs`, special tokens in a text included.

    Equal to the tokenizer's encoding without added special tokens, and its decoding of the ids
    with them kept. Null and empty texts have no tokens and decode to an empty text. Ids may be
    null or repeated: each row of `docs` gives one row. Other columns and their names play no part.
    An empty table gives an empty one.
    """
    columns = [("n_tokens", "long"), ("ids", "array<int>"), ("decoded", "string")]
    return _per_document(docs, path, id_col, text, chunk_chars, columns, _Whole)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what `encode` returns, without its long columns."""
    columns = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return _per_document(docs, path, id_col, text, chunk_chars, columns, _Digest)
