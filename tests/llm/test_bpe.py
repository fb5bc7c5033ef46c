from __future__ import annotations

import hashlib
import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchlens.llm import bpe
from matchlens.llm.bpe import Splitter, WordEncoder, digests, encode, words_of
from matchlens.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_and_ids_as_the_library_has_them(library):
    split, ids = Splitter(PATH), WordEncoder(PATH)
    rng = random.Random(3)
    pool = "aA'sS İıſKǺ̇Σσςßẞ12½²٣ \t\x1c\x85\xa0　!\0\xad日한한\U0001f600ǅ"
    texts = ["", "x<|startoftext|>y \0! <|end", "\0<|endoftext|>", "don't I'LL 'S ''s 's's"]
    texts += ["".join(rng.choice([*pool, "<|endoftext|>"]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text in texts:
        assert [i for w in split(text) for i in ids(w)] == library.encode(text, add_special_tokens=False).ids


def test_tokens_hold_the_words():
    split = Splitter(PATH)
    rng = random.Random(4)
    pool = [*"aA'sS ²½İéß-,. \t\n\x0b\0l1\x1c日", "<|endoftext|>", " "]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        tokens = split.tokens(text)
        starts, lengths, words, numbers = words_of(list(dict.fromkeys(tokens)))
        place = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        got = [words[n] for t in tokens for n in numbers[starts[place[t]] : starts[place[t]] + lengths[place[t]]]]
        assert got == split(text)


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_whole_table_round_trip(spark, small_docs, library):
    texts = {r.doc_id: r.text for r in small_docs.select("doc_id", "text").collect()}
    got = digests(small_docs, PATH, chunk_chars=60_000).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, text = wanted(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        )


def test_nulls_repeats_long_texts_and_clashing_columns(spark, docs_of, library, monkeypatch):
    monkeypatch.setattr(bpe, "SPELT_WORDS", 1000)
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, " \n"), (4, "Hello <|endoftext|> world"), (5, long)]
    docs = docs_of(rows).withColumn("ids", F.lit(1)).withColumn("chunk", F.lit(2)).withColumn("words", F.lit("w"))
    for size in (1, 10_000_000):
        got = sorted(((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in encode(docs, PATH, chunk_chars=size).collect()), key=str)
        want = sorted(((d, len(wanted(library, t)[0]), tuple(wanted(library, t)[0]), wanted(library, t)[1]) for d, t in rows), key=str)
        assert got == want
    assert encode(docs.limit(0), PATH).count() == 0


def test_a_long_chunk_is_laid_out_in_parts(spark, monkeypatch):
    """Eight bytes for every word number at once would be several times what a chunk keeps."""

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    run = bpe.chunks(Docs(), tokenizer_path(), "doc_id", "text")
    n, length = 300, 10_000
    texts = [" ".join(f"w{(i * length + j) % 977}" for j in range(length)) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    try:
        rows = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    numbers = [bpe._unpack(r["numbers"], len(r["words"])) for r in rows]
    assert sum(len(x) for x in numbers) == sum(sum(r["lengths"]) for r in rows)
    first = bpe.Splitter(tokenizer_path())(texts[0])
    assert [rows[0]["words"][i] for i in numbers[0][: rows[0]["lengths"][0]]] == first
    # per word number: eight bytes of running lengths, four each of tokens, lengths, numbers, their parts and ranks, and the split text of a batch
    assert peak < 70 * n * length
