"""Token files, packing and SentencePiece against the libraries themselves."""

import bisect
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from folioscan.llm import binary_packing, pieces, queries, token_files
from folioscan.llm.chunks import ByteLevel
from folioscan.llm.elias_fano import EliasFano

SF = "/root/testdata/sf0.001"
HARD = ["", " ", "  ", "a  b", "a   b", "a\n  b", "a   b", " a", "a ", "a  ", "don't I'll x's.", "x\n\n y", "\n", "\na",
        "a\n", "a.\n\nB c.", "a.\nb c,", "Straße Ünïcode — “q” 中文 字 é́", "<|endoftext|> hi", "a <|endoftext|> b", "x<|startoftext|>\ny<|endoftext|>", "<|endoftext", "a\t b", "AİB ΣΣ", "  b",
        "x" * 5000, "a \n b", "it's. don't! 's. l'été, A.B.C. x;", "▁a ▁ b", "a▁ b", "<s> </s>", "  x", "word " * 3000]
ROWS = "doc_id long, text string, n_chars long, ids string, start string"


def encoder(name, spaced):
    return ByteLevel(public_tokenizers.path(name), spaced, keep=20)


def untouched(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_library_s_ids(name, spaced):
    coder, library = encoder(name, spaced), untouched(name)
    for texts in (HARD, HARD[::-1], HARD[:1], []):
        ids, sizes = coder.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        for t, a, b in zip(texts, ends - sizes, ends):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


@given(st.lists(st.text(alphabet=" \n\t ab.,'é中▁1", max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_chunks_on_random_white_space(texts):
    coder = _byte()
    ids, sizes = coder.encode(pa.array(texts, pa.string()))
    want = [coder.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))
    model = _piece()
    ids, sizes = model.encode(pa.array(texts, pa.string()))
    want = [model.model.encode(t) for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))


_made = {}


def _byte():
    return _made.setdefault("byte", encoder("byte_bpe_50k.json", True))


def _piece():
    return _made.setdefault("piece", pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), keep=10))


@given(st.lists(st.integers(0, 2 ** 40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values.sort()
    code = EliasFano.from_bytes(EliasFano.build(values).to_bytes())
    n = len(values)
    assert [code.select(i) for i in range(n)] == values
    for i, j in ((0, n), (n // 3, n // 2), (n // 2, n), (1, 1), (0, min(1, n))):
        assert code.stretch(i, j).tolist() == values[i:j]
    for value in (-1, 0, *values[::50], 2 ** 41):
        assert code.reach(value, n // 4, n) == max(n // 4, bisect.bisect_right(values, value)) if n else True


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(EliasFano.build(ends).to_bytes()) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 1


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_token_file_by_select():
    sizes = np.array([3, 1, 1, 700, 2])
    ids = np.arange(sizes.sum()).astype(np.uint16)
    data = token_files.pack_file(np.array([-5, 7, 7, 9]), 1, ids, sizes, wide=False)
    file = token_files.TokenFile(Source(data))
    ends = np.cumsum(sizes)
    assert [file.doc_id(i) for i in range(5)] == [None, -5, 7, 7, 9]
    for i in (4, 0, 3, 1, 2):
        assert file.document(i).tolist() == ids[ends[i] - sizes[i]: ends[i]].tolist()
    for broken in (data[:-1], b"x" + data[1:], data[:20]):
        with pytest.raises(ValueError):
            token_files.TokenFile(Source(broken))


def rows(spark, texts):
    made = [(i, t, None, "x", "y") for i, t in enumerate(texts)] + [
        (3, "again", 1, None, None), (3, "again", 1, None, None), (None, "lost", 1, None, None), (-1, None, 1, None, None)]
    return spark.createDataFrame(made, ROWS).repartition(3)


def test_token_files_hold_every_row(spark):
    docs = rows(spark, HARD)
    manifest = token_files.write(docs, queries.byte_bpe, 0, 50_257, ids_per_file=50)
    got = token_files.read(manifest).collect()
    assert manifest.count() > 3 and len(got) == docs.count()
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    keys = [r.doc_id for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    library = untouched("byte_bpe_50k.json")
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in [library.encode(t, add_special_tokens=False).ids + [0] for t in texts[r.doc_id]]
    empty = token_files.write(docs.limit(0), queries.byte_bpe, 0, 50_257)
    assert token_files.read(empty).count() == 0


def test_op1_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op1(spark, SF).collect()}
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    for d in docs:
        ids = np.array(_byte().whole.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_cut():
    owner, lengths = binary_packing.cut(np.array([1, 4096, 9000, 6]), 4096)
    assert list(zip(owner.tolist(), lengths.tolist())) == [
        (0, 1), (1, 4096), (2, 4096), (2, 4096), (2, 512), (2, 256), (2, 32), (2, 8), (3, 4), (3, 2)]
    assert binary_packing.cut(np.zeros(0, np.int64))[0].tolist() == []


def test_packing_cuts_without_loss(spark):
    docs = rows(spark, HARD)
    got = binary_packing.pack(docs, queries.word_bpe, 2, longest=64).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 for r in got)
    library = untouched("word_bpe_49k.json")
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids + [2])
    found = {}
    for r in sorted(got, key=lambda r: r.sequence_id):
        found.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length and 2 ** r.bucket == r.length
    for k, mine in found.items():
        ids = np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist()
        assert sorted(ids) == sorted(i for w in want[k] for i in w)
        if len(want[k]) == 1:
            assert ids == want[k][0] and [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
    assert found.keys() == want.keys()
    assert binary_packing.pack(docs.limit(0), queries.word_bpe, 2).count() == 0
    with pytest.raises(ValueError):
        binary_packing.pack(docs, queries.word_bpe, 2, longest=100)


def test_buckets(spark, tmp_path):
    binary_packing.write_buckets(binary_packing.pack(rows(spark, HARD), queries.word_bpe, 2), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.filter("length <> pow(2, bucket)").isEmpty() and back.count() > len(HARD)


def test_pieces_as_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = rows(spark, HARD)
    model = _piece().model
    got = pieces.encode(docs, path, decode=True).collect()
    assert len(got) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in got:
        assert (r.ids, r.decoded) in [
            (model.encode(t, add_eos=True), model.decode(model.encode(t, add_eos=True))) for t in texts[r.doc_id]]
    assert pieces.encode(docs.limit(0), path).count() == 0


def test_op4_and_op7_equal_brute_force(spark):
    import hashlib
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = _piece().model
    for r in queries.op4(spark, SF).collect():
        ids = model.encode(docs[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    library = untouched("word_bpe_49k.json")
    held = {}
    for r in queries.op7(spark, SF).collect():
        ids = held.setdefault(r.doc_id, library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids + [2])
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start: r.start + r.length], "<u4").tobytes())
    assert held.keys() == docs.keys()
