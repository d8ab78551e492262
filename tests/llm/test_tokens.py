import uuid
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mvspark.llm import token_counts, token_store
from tokenizers import Tokenizer
from tests.llm.helpers import awkward, frame

_ENCODER = []
#: A fresh tokenizer, which no code of the library has touched.
LIBRARY = Tokenizer.from_file(token_store.tokenizer_path())


def encoder():
    if not _ENCODER:
        _ENCODER.append(token_store.Encoder(token_store.tokenizer_path(), most=50))
    return _ENCODER[0]


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab éß,.!'s1\n \t\r\x0b\xa0 日😀_-\x1c")), max_size=25), max_size=8))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_as_whole_texts_do(texts):
    whole = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder().encode(texts)] == whole


@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "ab", "é", "\n", ".", "\xa0", "日"]), max_size=9).map("".join), max_size=6))
@settings(max_examples=300, deadline=None)
def test_added_tokens_are_what_the_library_takes_them_for(texts):
    texts += ["ab <|endoftext|> cd", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "x  <|endoftext|>", "a<|endoftext|>\nb"]
    whole = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder().encode(texts)] == whole
    assert 50256 in whole[-1]


@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=2000), st.integers(0, 70_000))
@settings(max_examples=40, deadline=None)
def test_wavelet_matrix(ids, other):
    a = np.array(ids, dtype=np.uint32)
    m = token_store.WaveletMatrix(len(a), *token_store.WaveletMatrix.build(a))
    assert m.decode().tolist() == ids
    for i in {0, len(ids) // 2, len(ids) - 1}:
        assert m.access(i) == ids[i]
        assert m.rank(ids[i], i) == ids[:i].count(ids[i])
        assert m.select(ids[i], ids[:i].count(ids[i])) == i
    assert m.rank(other, len(ids)) == ids.count(other)
    assert m.select(other, ids.count(other)) == -1


def plain(rows, end=2):
    t = LIBRARY
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_over_many_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    token_store.write_shards(docs, path, shard_tokens=5000)
    got = [tuple(r)[:4] for r in token_store.read_documents(spark, path).orderBy("start").collect()]
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert spark.read.parquet(path).count() > 10
    ids = {r["doc_id"]: r["ids"] for r in token_store.read_tokens(spark, path).collect()}
    first = docs.orderBy("doc_id").first()
    assert ids[first["doc_id"]] == [*LIBRARY.encode(first["text"], add_special_tokens=False).ids, 2]
    token = ids[first["doc_id"]][0]
    assert sum(r["occurrences"] for r in token_store.count_token(spark, path, token).collect()) == sum(v.count(token) for v in ids.values())


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark, [(30, "ends<|endoftext|> here"), (31, "<|endoftext|>")])
    token_store.write_shards(docs, f"{tmp_path}/a")
    got = sorted((tuple(r)[:4] for r in token_store.read_documents(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    token_store.write_shards(frame(spark, []), f"{tmp_path}/b")
    assert token_store.read_documents(spark, f"{tmp_path}/b").count() == 0
    assert token_store.read_tokens(spark, f"{tmp_path}/b").count() == 0
    named = spark.createDataFrame([("b", "two words"), ("a", None), (None, "x")], "doc_id string, text string")
    token_store.write_shards(named, f"{tmp_path}/c")
    got = sorted((tuple(r)[:4] for r in token_store.read_documents(spark, f"{tmp_path}/c").collect()), key=lambda r: r[1])
    assert got == [(doc, start, n, crc) for doc, start, n, crc in plain([(None, "x")])] + [("a", 2, 1, zlib.crc32(np.array([2], dtype="<u4").tobytes())), ("b", 3, *plain([(1, "two words")])[0][2:])]


def plain_sections(text):
    e = LIBRARY.encode(text, add_special_tokens=False)
    sizes = token_store.token_sizes(LIBRARY)
    data, spans, at = text.encode(), [], 0
    for line in data.split(b"\n"):
        spans.append((at, at + len(line)))
        at += len(line) + 1
    counts, at = [0] * len(spans), 0
    for k in e.ids:
        stop = at + int(sizes[k])
        held = [max(0, min(b, stop) - max(a, at)) for a, b in spans]
        if max(held):
            best = held.index(max(held))
        else:
            best = max([k for k, (_, b) in enumerate(spans) if b <= at], default=0)
        counts[best] += 1
        at = stop
    return [(a, b, n) for (a, b), n in zip(spans, counts)]


def test_counts_by_line(spark):
    texts = ["one line", "a\nb\n\nc  d\n", "\n\n", "", "é日本\n語x\r\ny", "x\n" * 300, "end\n\n\n   \n  tail", "a<|endoftext|>\n<|endoftext|>b"]
    got = token_counts.count_sections(frame(spark, list(enumerate(texts)))).collect()
    for k, text in enumerate(texts):
        mine = sorted((r["section"], r["start"], r["end"], r["n_tokens"]) for r in got if r["doc_id"] == k)
        assert [m[1:] for m in mine] == plain_sections(text), text


def test_a_crossing_token_goes_to_the_larger_share_then_to_the_first():
    a = lambda *x: np.array(x)
    assert token_counts.attribute(a(3, 7, 9), a(0, 3, 7), a(0, 4, 8), a(4, 8, 9)).tolist() == [0, 1, 1]
    assert token_counts.attribute(a(2, 4), a(0, 2), a(0, 3), a(3, 4)).tolist() == [0, 0]


def test_sections_of_awkward_rows(spark):
    docs = awkward(spark)
    got = token_counts.count_sections(docs).collect()
    assert sum(1 for r in got if r["doc_id"] == 5) == 2 and [r["n_tokens"] for r in got if r["doc_id"] == 1] == [0]
    assert token_counts.count_sections(frame(spark, [])).count() == 0
