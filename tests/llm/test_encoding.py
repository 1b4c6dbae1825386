"""Token counts, byte-level BPE and id files against the public libraries."""

import base64
import hashlib
import random
import re
import zlib
from functools import lru_cache
from io import BytesIO

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from glossmill.llm import bitplanes, bpe, common, pretokens, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "",
    " ",
    "  two  blanks   and\n\n \t lines \n",
    "it's we'll THEY'RE 'twas don't",
    "a \t b c  d\x1ce\x85f \x1c g",
    "x" * 5000,
    "\U0001f600́ é ﬁ ２３ Ⅷ ½ ٣ ​.",
    "<|endoftext|> in <|endoftext|><|endoftext|> text <|endoftext",
    "tail blank ",
    "a\n b",
    " \n b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def made(n=200):
    rng, out = random.Random(7), []
    parts = ["the", "Word", "é", "ß", "12", " ", "  ", "\n", ", ", "...", "'s", "\t", "中文", " "]
    for _ in range(n):
        out.append("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(40))))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    texts = ODD + made(60)
    data = [(i, x, "clash", 1) for i, x in enumerate(texts)] + [(500, None, "c", 2), (None, "no key", "c", 2)]
    data += [(3, ODD[3], "again", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, token string, row int").repartition(3)
    return df, [(i, x or "") for i, x, _, _ in data]


def test_units_give_the_pretokens_of_the_text():
    find = pretokens.pattern().findall
    for text in ODD + made():
        assert [t for u in pretokens.units(text) for t in find(u)] == find(text)


def test_codec_agrees_with_the_library(encoding):
    own = bpe.codec(RANKS)
    for text in ODD + made():
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == encoding.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_codec_handles_very_long_pretokens(encoding):
    rng = random.Random(3)
    word = "".join(rng.choice("etaoinshr") for _ in range(40_000))
    ids = np.frombuffer(bpe.codec(RANKS).encode(word), "<u4").tolist()
    assert ids == encoding.encode_ordinary(word)


def test_rank_queue_pops_by_rank_then_position():
    queue, rng = bpe.RankQueue(50_256), random.Random(1)
    held = [(rng.randrange(50_256), rng.randrange(100)) for _ in range(2000)]
    for entry in held:
        queue.push(*entry)
    assert [queue.pop() for _ in held] == sorted(held)
    assert queue.pop() is None


def test_round_trip(rows, encoding):
    df, texts = rows
    got = sorted(map(tuple, bpe.round_trip(df, RANKS).collect()), key=str)
    want = []
    for key, text in texts:
        ids = encoding.encode_ordinary(text)
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((key, len(ids), sha, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("frequent", [0, 5, 250_000])
def test_token_counts(rows, library, frequent):
    df, texts = rows
    got = token_counts.count_tokens(df, JSON, frequent=frequent).collect()
    want = [
        (k, len(x.encode()), len(library.encode(x, add_special_tokens=False).ids)) for k, x in texts
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_token_counts_of_an_empty_table(rows):
    assert token_counts.count_tokens(rows[0].limit(0), JSON).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_are_inverted(kind):
    ids = np.array([0, 1, 50_256, 2**32 - 1, 77], "<u4")
    assert bitplanes.from_planes(bitplanes.to_planes(ids, kind), 5, kind).tolist() == ids.tolist()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_blocks_span_documents(kind):
    rng, sink = random.Random(2), BytesIO()
    docs = [(k, [rng.randrange(60_000) for _ in range(rng.choice([1, 3, 50]))]) for k in range(40)]
    docs.append((None, [5]))
    writer = bitplanes.Writer(sink, kind, block=16)
    for key, ids in docs:
        writer.add(key, np.array(ids, "<u4").tobytes())
    writer.close()
    reader = bitplanes.Reader(pa.BufferReader(sink.getvalue()))
    start = 0
    for (key, ids), (got_key, got_start, got) in zip(docs, reader.documents(), strict=True):
        assert (got_key, got_start, got.tolist()) == (key, start, ids)
        start += len(ids)


def test_ids_are_written_in_key_order(rows, library):
    df, texts = rows
    manifest = bitplanes.write_ids(df, JSON, block=64)
    got = sorted(map(tuple, bitplanes.read_ids(manifest).collect()), key=lambda r: r[1])
    start, want = 0, []
    for key, text in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert bitplanes.read_ids(bitplanes.write_ids(df.limit(0), JSON)).count() == 0


def ids_of(codec, texts, kind=None):
    found = codec.encode(pa.array(texts, kind or pa.string()))
    return [np.frombuffer(x, "<u4").tolist() for x in found]


def test_arrow_finds_the_blank_runs_of_the_pattern():
    texts = [f"a{chr(c)} b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    want = [re.search(r"\s ", x) is not None for x in texts]
    assert pretokens.blank_runs(pa.array(texts)).tolist() == want


@pytest.mark.parametrize("known", [1, 300, 10**6])
@pytest.mark.parametrize("direct", [True, False])
def test_library_codec_agrees_with_the_library(library, known, direct):
    texts = ODD + made(400) + ["Word's", "it'", "words...", " 's", "ßé,\u0250x;", "a\x00b \xff", "ǅ ×÷"]
    codec = bitplanes.LibraryCodec(JSON)
    codec.KNOWN, codec.IDS, codec.direct = known, 10 * known, direct
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    for kind in (pa.string(), pa.large_string()):
        assert ids_of(codec, texts, kind) == want
    got = [x for k in range(0, len(texts), 7) for x in ids_of(codec, texts[k : k + 7])]
    assert got == want
    assert [ids_of(codec, [x]) for x in texts] == [[x] for x in want]
    assert codec.encode(pa.array([], pa.string())) == []


def test_units_of_most_batches_stay_when_the_table_is_full():
    codec, asked = bitplanes.LibraryCodec(JSON), []
    model = codec._model
    codec._model = lambda tokens: asked.extend(tokens) or model(tokens)
    codec.KNOWN = 300
    for k in range(100):
        often = "all of these words are in most of the batches" if k % 2 else "none"
        codec.encode(pa.array([often, " ".join(f"{k}x{n}" for n in range(20))]))
        assert len(codec.known) <= codec.KNOWN + 80  # with what a batch adds
    # learned once, though half of the batches are without them
    assert asked.count(" batches") == 1


def test_slices_hold_few_bytes_of_text():
    texts = ["ab", "", "c" * 50, "é" * 5, "d", "e" * 10, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    got = [x.column(1).to_pylist() for x in bitplanes.light_slices(batch, 11)]
    assert got == [texts[:2], texts[2:3], texts[3:5], texts[5:]]
    assert list(bitplanes.light_slices(batch.slice(0, 0), 11)) == []


def test_a_worker_holds_the_tables_of_one_operator_at_a_time():
    @lru_cache(maxsize=1)
    def own(path):
        return [path]

    common.hold(own)
    kept = own("a")
    common.hold(own)
    assert own("a") is kept  # the next task of the same operator finds them
    common.hold()
    assert own.cache_info().currsize == 0
    common.hold()
