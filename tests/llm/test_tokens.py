import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import packing, shared
from marlstone.llm.packing import pack, plan_best_fit
from marlstone.llm.tokenfile import EliasFano, ShardReader, ShardWriter, read_token_files, write_token_files
from marlstone.llm.tokens import _LETTERS, _WHOLE, WordEncoder, _has_runs

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def ids_of(encoder, texts):
    return [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_words_give_the_same_ids(path):
    random.seed(5)
    parts = ["a", "B", " ", "\n", "'s", "é", "1", "<", "́", "\t", "ß", ".", ",", "\x00", "<|endoftext|>", "word", "  ", " ", "<|", "|>", "endoftext"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(1500)]
    enc, want = WordEncoder(path, max_words=50), plain(path)
    assert ids_of(enc, texts[:700]) + ids_of(enc, texts[700:]) == [want(t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_special_strings_are_their_tokens_whatever_stands_beside(path):
    want = plain(path)
    texts = ["a <|endoftext|> b", "<|startoftext|>", "a <|startoftext|> b<|endoftext|>", "plain words", "<|ENDOFTEXT|>", "<|endoftext", "|> x <|"]
    for group in ([t] for t in texts):
        assert ids_of(WordEncoder(path), group) == [want(group[0])]
    assert ids_of(WordEncoder(path), texts) == [want(t) for t in texts]
    assert want("<|endoftext|>") == [50256 if path == BYTE else 49407]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_of_letters_give_the_same_ids(path):
    """Every letter that the model is handed directly, alone, in words, at a text's start and behind others."""
    rng, want = random.Random(8), plain(path)
    letters = [chr(c) for c in range(0x24F) if _LETTERS.fullmatch(chr(c))]
    assert len(letters) > 200 and "\u0130" not in letters
    texts = [*letters, *(f"x {c}y" for c in letters), *(" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(8)) for _ in range(800))]
    texts += ["The THE the don't", "\u0130stanbul \u0130", "ſ ŉ", "e\u0301 é"]
    assert ids_of(WordEncoder(path), texts) == [want(t) for t in texts]


def test_other_layouts_are_encoded_whole(tmp_path):
    """A file that splits elsewhere, or strips around a token, falls back to whole texts."""
    import json

    texts = ["One two, three.", " lead", "a\nb <|endoftext|> c", "", "x  y"]
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "Lowercase"}}, {"added_tokens": []}):
        told = json.load(open(BYTE)) | change
        path = tmp_path / "other.json"
        path.write_text(json.dumps(told))
        enc = WordEncoder(str(path))
        assert enc.kind is None and ids_of(enc, texts) == [plain(str(path))(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_seats_every_piece_once(histogram):
    capacity, fill, seen = 32, Counter(), Counter()
    for length, a, b, first, offset in plan_best_fit(histogram, capacity):
        for k in range(a, b):
            seen[length, k] += 1
            fill[first + k - a] += length
            assert 0 <= offset <= capacity - length
    assert seen == Counter((n, k) for n, c in histogram.items() for k in range(c))
    assert all(v <= capacity for v in fill.values())
    total = sum(n * c for n, c in histogram.items())
    assert len(fill) <= max(1, 2 * -(-total // capacity))


def test_plan_does_not_grow_with_the_documents():
    one = plan_best_fit({n: 10 for n in range(1, 1025)}, 1024)
    many = plan_best_fit({n: 10**9 for n in range(1, 1025)}, 1024)
    assert len(many) < 4 * len(one) + 10000


def test_pack_odd(odd, empty):
    rows = pack(odd, BYTE, capacity=64).collect()
    want = plain(BYTE)
    docs = sorted(((r["doc_id"], (*want(r["text"]), 2)) for r in odd.collect()), key=repr)
    by_place = {(r["sequence_id"], r["offset"]): r for r in rows}
    assert len(by_place) == len(rows)
    for sequence in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == sequence), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    crc = Counter()
    for doc_id, ids in docs:
        first = len(ids) % 64 or min(64, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            crc[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == crc
    assert pack(empty, BYTE).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    coded = EliasFano.encode(np.array(values, np.uint64))
    again = EliasFano.read(coded.head(), b"".join(coded.parts()))
    assert again.decode().tolist() == values
    assert [again.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_each_piece_meets_its_slot_once(spark):
    """The plan is looked up by rank: rows out of the join are the pieces, whatever the slots."""
    from collections import defaultdict

    rng = random.Random(3)
    docs = [(i, "word " * rng.randint(0, 90)) for i in range(700)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), BYTE, capacity=64).collect()
    want = Counter()
    for _, t in docs:
        n = len(plain(BYTE)(t)) + 1
        want[n % 64 or 64] += 1
        want[64] += (n - 1) // 64 if n % 64 else n // 64 - 1
    assert Counter(r["length"] for r in rows) == +want
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for of in fill.values():
        of.sort()
        assert [o for o, _ in of] == [sum(n for _, n in of[:k]) for k in range(len(of))] and sum(n for _, n in of) <= 64
    slots = plan_best_fit(dict(want), 64)
    assert len(fill) == len({first + k for _, a, b, first, _ in slots for k in range(b - a)})


def test_the_plan_starts_no_python_workers_of_its_own(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (3, None)], "doc_id long, text string")
    assert "ExistingRDD" not in pack(docs, BYTE)._jdf.queryExecution().executedPlan().toString()


def test_workers_give_memory_back_after_packing(monkeypatch):
    trimmed = []
    monkeypatch.setattr(shared, "trim", lambda: trimmed.append(1))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two"]})
    assert [b.num_rows for b in packing._pieces(BYTE, 2, 1024)([batch])] == [1] and trimmed


def test_other_operators_drop_the_words_that_packing_keeps(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    shared.worker_cache()["encoder"] = "kept"
    list(packing._pieces(BYTE, 2, 1024)([]))
    assert shared.worker_cache()["encoder"] == "kept"
    list(shared.tidy(iter)([]))
    assert not shared.worker_cache()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 3000, 20000)).astype(np.uint64)
    size = sum(map(len, EliasFano.encode(values).parts()))
    assert size * 8 / len(values) < 2 + np.log2(1500) + 1.5


def test_shard(tmp_path):
    import pyarrow.fs as pafs

    fs = pafs.LocalFileSystem()
    out = ShardWriter(fs.open_output_stream(str(tmp_path / "s")), 2)
    docs = [(None, [1, 2]), (-5, []), (3, [7] * 1000), (3, [9])]
    for d, ids in docs:
        out.add(d, np.array(ids, "<u4"))
    out.close()
    reader = ShardReader(fs.open_input_file(str(tmp_path / "s")))
    assert len(reader) == 4 and reader.doc_ids() == [None, -5, 3, 3]
    assert [reader.document(i).tolist() for i in range(4)] == [ids for _, ids in docs]
    (tmp_path / "cut").write_bytes((tmp_path / "s").read_bytes()[:-3])
    with pytest.raises(ValueError):
        ShardReader(fs.open_input_file(str(tmp_path / "cut")))


def test_token_files_odd(spark, odd, empty, tmp_path):
    where = f"file://{tmp_path}/files"
    write_token_files(odd, where, WORD, shards=3)
    rows = read_token_files(spark, where).collect()
    want = plain(WORD)
    ids = Counter((r["doc_id"], len(want(r["text"])) + 1, zlib.crc32(np.array([*want(r["text"]), 2], "<u4").tobytes())) for r in odd.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == ids
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    write_token_files(empty, f"file://{tmp_path}/none", WORD, shards=2)
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_runs_of_white_space_are_found():
    rng = random.Random(4)
    signs = ["a", "é", " ", "\n", "\t", "\x00", "\x1c", "\u00a0", "\u2028", "\u3000", "\u200b", "\u00ad", "\U0001f600"]
    for size in range(12):
        for _ in range(500):
            text = "".join(rng.choices(signs, weights=[9, 3, 6, 3, *[1] * 9], k=size))
            assert _has_runs(text) == bool(_WHOLE.search(text)), repr(text)


def test_full_word_cache_gives_the_same_ids():
    small, large = WordEncoder(BYTE, max_words=5), WordEncoder(BYTE)
    for k in range(30):
        texts = [f"the word number{k} and {k * 7} of\nmany, more.", "the rest of it"]
        assert small.encode(texts) == large.encode(texts)
        assert len(small.words) <= 6


def test_query_finds_boundaries_by_select(spark, tmp_path, monkeypatch):
    from marlstone.llm import tokenfile

    rng = np.random.default_rng(7)
    values = np.cumsum(rng.integers(0, 900, 1500))
    for values in (values, np.zeros(600, int), np.arange(257) * 10**9, values[:1], values[:0]):
        coded = EliasFano.encode(values)
        for a, b in ((0, len(values)), (len(values) // 3, len(values)), (255, 258), (0, 1)):
            b = min(b, len(values))
            assert coded.selected(a, b).tolist() == values[a:b].tolist()
    rows = [(None if i < 5 else i, "word " * (i % 7)) for i in range(700)]
    where = f"file://{tmp_path}/files"
    manifest = tokenfile.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), where, WORD, shards=1)
    monkeypatch.setattr(EliasFano, "decode", lambda self: 1 / 0)
    keys = [pa.RecordBatch.from_pydict({"id": [0]})]
    got = [tuple(r.values()) for b in tokenfile._reader(where, manifest, documents=300)(keys) for r in b.to_pylist()]
    encode = plain(WORD)
    ids = [[*encode(t), 2] for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    assert [g[0] for g in got] == [None] * 5 + list(range(5, 700))
    assert [g[2] for g in got][5:] == [len(x) for x in ids][5:] and got[-1][1] + got[-1][2] == starts[-1]
