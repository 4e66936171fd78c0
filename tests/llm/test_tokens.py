"""Operators 2, 7 and 9 against the public libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanlens.llm import bpe, decontaminate, elias_fano, frames, langid, library, line_dedup, token_counts, token_files

SF = "/root/testdata/sf0.001"
ODD = ["", None, "a", "it's 'tis we're they'll I'd x'sabc ''s 's", "  two  spaces\n\n x", " \n", "\n a\tb", "x" * 300, "日本語 テスト 123abc ½ é", "a'", "'re'r", "  ", " x 　y", "🙂🙂 !! ?", "ab" * 3000, "'ll", "x<|endoftext|>y", "a\x1cb \x85c", "same", "same", "long " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, "no id", "x", None), (3, ODD[3], "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, content string, n_tokens int")


def tiktoken_encoding():
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library_ids(texts):
    tok = Tokenizer.from_file(token_counts.TOKENIZER)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tsrelvdmtab1²é漢 　\x1c!\"."), st.characters(blacklist_categories=["Cs", "Cn"])), max_size=40), max_size=6))
def test_matches_and_merges_are_those_of_the_library(texts):
    enc = tiktoken_encoding()
    ids, counts = bpe.coder(bpe.RANKS).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == [enc.encode_ordinary(t) for t in texts] or not texts


def test_long_and_short_trees_agree():
    coder = bpe.coder(bpe.RANKS)
    words = [b"thtionther", "ationnement".encode(), b"aaaaaaaaaaaaaaaaaaaaaaaa", "éèêçà".encode()]
    for w in words:
        size = 1 << (len(w) - 1).bit_length()
        assert coder.merge_short([w], size)[0].tolist() == coder.merge_long(w)


def test_op9(spark, docs):
    enc = tiktoken_encoding()
    for df in (docs, frames.table(spark, SF, "documents")):
        texts = {(r.doc_id, r.text or "") for r in df.collect()}
        want = {(i, len(ids := enc.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts}
        got = bpe.round_trip(df).collect()
        assert {tuple(r) for r in got} == want and len(got) == df.count()
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_encode_and_decode_keep_other_columns(docs):
    out = bpe.decode(bpe.encode(docs)).collect()
    assert [bytes(r.decoded).decode() for r in out] == [r.text or "" for r in out]
    assert out[0].content == "clash" and len(out) == docs.count()


def test_op2_and_its_cache(spark, docs):
    path = frames.new_folder(spark, "cache")
    first = token_counts.count_tokens(docs.limit(10), path).collect()
    entries = spark.read.parquet(path).count()
    assert entries == len({t or "" for t in ODD[:10]}) and len(first) == 10
    got = token_counts.count_tokens(docs, path)
    assert got.columns == ["doc_id", "content", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((r.doc_id is None, r.doc_id, len((r.text or "").encode()), n := len(library_ids([r.text])[0]), n > 512) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    after = spark.read.parquet(path)
    assert after.count() == len({r.text or "" for r in docs.collect()})  # only misses were appended
    token_counts.count_tokens(docs, path).collect()
    assert spark.read.parquet(path).count() == after.count()
    assert token_counts.count_tokens(docs.limit(0), frames.new_folder(spark, "cache")).count() == 0


def test_op2_believes_the_cache(spark, docs):
    path = frames.new_folder(spark, "cache")
    planted = [(hashlib.sha256(b"same").hexdigest(), library.file_digest(token_counts.TOKENIZER), 777), (hashlib.sha256(b"a").hexdigest(), "other version", 888)]
    spark.createDataFrame(planted, token_counts.CACHE).write.parquet(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert got[18] == got[19] == 777 and got[2] == 1


def test_op2_on_documents(spark):
    got = {r.doc_id: r.n_tokens for r in token_counts.op2_token_counts(spark, SF).collect()}
    rows = frames.table(spark, SF, "documents").collect()
    assert got == {r.doc_id: len(i) for r, i in zip(rows, library_ids([r.text for r in rows]), strict=True)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=300))
def test_elias_fano(values):
    values = np.cumsum(np.array(values, np.int64))
    ef = elias_fano.EliasFano(elias_fano.pack(values))
    assert ef.all().tolist() == values.tolist() == [ef.select(i) for i in range(len(values))]


def test_elias_fano_is_small():
    ends = np.cumsum(np.full(10_000, 700))
    assert len(elias_fano.pack(ends)) * 8 < 10_000 * 13


@pytest.mark.parametrize("segment_ids", [1, 500, 1 << 20])
def test_op7(spark, docs, segment_ids):
    path = frames.new_folder(spark, "files")
    token_files.write(docs, path, segment_ids=segment_ids)
    got = token_files.read(spark, path).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, x in zip(got, rows, strict=True):
        ids = library_ids([x.text])[0] + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (x.doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    for row in spark.read.parquet(path).collect():
        segment = token_files.Segment(row)
        assert sum(len(segment.document(i)) for i in range(segment.n_docs)) == row.n_ids
        assert [segment.key(i) for i in range(segment.n_docs)] == sorted((segment.key(i) for i in range(segment.n_docs)), key=lambda k: (k is not None, k or 0))


def test_op7_lookup_and_extreme_ids(spark):
    keys = [-(1 << 63), -(1 << 63), -5, 0, 3, 3, (1 << 62) + 1, (1 << 63) - 1, None]
    rows = [(k, f"text {i}") for i, k in enumerate(keys)]
    path = frames.new_folder(spark, "files")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = {(r.doc_id, r.start, tuple(r.ids)) for r in got}
    some = token_files.lookup(spark, path, [3, -(1 << 63), (1 << 63) - 1, 4]).collect()
    assert {(r.doc_id, r.start, tuple(r.ids)) for r in some} == {w for w in want if w[0] in (3, -(1 << 63), (1 << 63) - 1)} and len(some) == 5


def test_names_that_clash(spark):
    """Columns with dots, and with names that operators use themselves."""
    df = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4), (2, None, 1, 2, 3, 4)], "doc_id long, text string, `a.b` int, body int, c0 int, content int")
    assert bpe.encode(df).columns == [*df.columns, "ids"] and [len(r.ids) for r in bpe.encode(df).orderBy("doc_id").collect()] == [3, 0]
    assert [r["a.b"] for r in bpe.decode(bpe.encode(df)).collect()] == [1, 1]
    out = token_counts.count_tokens(df, frames.new_folder(spark, "cache"))
    assert out.columns == ["doc_id", "a.b", "body", "c0", "content", "n_bytes", "n_tokens", "over_limit"] and out.count() == 2
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    marked = decontaminate.contamination(df, items, item_bytes=1)
    assert marked.columns[:6] == df.columns and sorted((r.doc_id, r.n_hit, r["a.b"]) for r in marked.collect()) == [(1, 3, 1), (2, 0, 1)]
    assert decontaminate.decontaminate(df, items).columns == df.columns
    model = langid.fit(df.withColumn("lang", F.lit("x")), F.lit(True))
    assert langid.detect(df, model).columns == [*df.columns, "lang_pred", "score"] and langid.detect(df, model).count() == 2
    assert line_dedup.dedup_lines(df).columns == [*df.columns, "n_lines", "n_kept"] and line_dedup.dedup_lines(df).count() == 2


def test_op7_of_nothing(spark, docs):
    path = frames.new_folder(spark, "files")
    token_files.write(docs.where(F.lit(False)), path)
    assert token_files.read(spark, path).count() == 0

def test_op2_two_first_runs_at_once(spark, docs, monkeypatch):
    """Both see no cache and append all: rows don't double."""
    path = frames.new_folder(spark, "cache")
    want = sorted(map(tuple, token_counts.count_tokens(docs, frames.new_folder(spark, "cache")).collect()), key=str)
    missing = token_counts.missing
    other = missing(docs.select(F.sha2(token_counts.whole(F.col("text")).cast("binary"), 256).alias("content"), token_counts.whole(F.col("text")).alias("body")), path, "")

    def late(texts, cache_path, version):
        out = missing(texts, cache_path, version)
        counted = spark.createDataFrame([(r.content, version, len(library_ids([r.body])[0])) for r in other.collect()], token_counts.CACHE)
        counted.write.mode("append").parquet(cache_path)  # the other run ends first
        return out

    monkeypatch.setattr(token_counts, "missing", late)
    assert sorted(map(tuple, token_counts.count_tokens(docs, path).collect()), key=str) == want


def test_op2_query_meets_hits_and_misses(spark, monkeypatch):
    seen = []
    missing = token_counts.missing

    def watched(*args):
        out = missing(*args)
        seen.append("LeftAnti" in out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(token_counts, "missing", watched)
    got = {r.doc_id: r.n_tokens for r in token_counts.op2_token_counts(spark, SF).collect()}
    rows = frames.table(spark, SF, "documents").collect()
    assert seen == [False, True] and got == dict(zip([r.doc_id for r in rows], map(len, library_ids([r.text for r in rows])), strict=True))
