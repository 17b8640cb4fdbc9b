"""Operators 1, 2 and 5: against the tokenizer libraries, on whole texts and odd ones."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracefold.llm import pieces as P
from tracefold.llm import sentencepiece_codec, token_counts, token_store
from tracefold.llm.bpe_units import WordTokenizer, fine_units, is_word, load_tokenizer, units

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"

ODD = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n\n b", "a\t \nb", "x y z", "x 　y", "tail  ", "\r\n\r\n", "don't  we'll",
       "one<|endoftext|>two <|endoftext|> three", "a\0 b\0c", "\x1c a\x1d!", "!\x1c?", "\x85 a\x85b", "é" * 50, "日本語 テキスト 👩‍👩‍👧 ok", "a▁b ▁c", "word " * 4000,
       "x" * 30_000, "tab\tsep\tvalues", "ends\n", "\nstarts", "1234 5.6e7 --- ###"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def odd_docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(3, "again", "y", 1), (3, "again", "y", 1), (None, "no id", "z", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row long")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '1!é  \u0085\x1c\t\n\r \0▁<|>endoftx")), max_size=40))
def test_units_encode_as_the_whole(text):
    t = _tokenizer()
    assert "".join(units(text)) == text
    assert [i for u in units(text) for i in t.encode(u, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


_cached = []


def _tokenizer():
    if not _cached:
        _cached.append(Tokenizer.from_file(BPE))
    return _cached[0]


def expected_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("head", [0, 3, 100_000])
def test_counts_of_odd_texts(spark, library, head):
    docs = odd_docs(spark)
    rows = docs.collect()
    got = sorted(tuple(r) for r in token_counts.token_counts(docs, BPE, limit=5, head_units=head).na.fill(-1, ["doc_id"]).collect())
    n = expected_counts(library, [r["text"] for r in rows])
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()), k, k > 5) for r, k in zip(rows, n, strict=True))
    assert got == want


def test_counts_of_a_table(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BPE, head_units=500).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], expected_counts(library, [r["text"] for r in rows]), strict=True))


def test_empty_tables(spark):
    empty = odd_docs(spark).limit(0)
    assert token_counts.token_counts(empty, BPE).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.token_counts(empty, BPE).count() == 0
    assert token_store.token_store(empty, BPE).count() == 0
    assert sentencepiece_codec.encode(empty, MODEL).count() == 0


def test_store_gives_back_all_ids_in_order(spark, library):
    docs = odd_docs(spark)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32((r["text"] or "").encode())))
    got = token_store.token_store(docs, BPE, files=3).orderBy("start").collect()
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_store_files_hold_bloom_filter_and_order(spark, scratch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    token_store.write_token_store(docs, f"{scratch}/ids", BPE, files=4)
    store = token_store.read_token_store(spark, f"{scratch}/ids")
    spans = store.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("part").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:], strict=False)) and len(spans) > 1
    assert store.filter("doc_id = 17").count() == 1
    # a worker that forgets its units gives the same ids
    token_store._encoders.clear()
    a = token_store.encode_texts(BPE, ["a b c d", "e f  g"])
    old, token_store.CACHE_UNITS = token_store.CACHE_UNITS, 2
    try:
        token_store._encoders.clear()
        assert token_store.encode_texts(BPE, ["a b c d", "e f  g"]) == a
    finally:
        token_store.CACHE_UNITS = old
        token_store._encoders.clear()


CUTS = [*ODD, "one\ntwo. three,four\n\nfive!\n six", "Ära: été;ñu?\nª.µ,º! ×.÷", "a.b,c  d.e\x85.f", "\0x.y\nz", "it's. we'll, 'tis", "a <|endoftext|>. b<|endoftext|>,c.", "\n.a\n,b", " .a ,b ..c"]


def library_ids(library, texts):
    return [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_fine_units_join_to_the_text(kind):
    array = pa.array(["before", *CUTS], kind).slice(1)
    values, first, n = fine_units(array)
    got = [values.slice(a, k).to_pylist() for a, k in zip(first, n, strict=True)]
    assert ["".join(us) for us in got] == [t or "" for t in CUTS]
    assert [u for u in got[CUTS.index("one\ntwo. three,four\n\nfive!\n six")] if u] == ["one", "\n", "two", ".", " three", ",four", "\n\nfive", "!", "\n six"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abé '1!.,  \u0085\x1c\xa0\u3000\t\n\n\r\0▁<|>endoftx")), max_size=40), min_size=1, max_size=4))
def test_stored_ids_are_the_librarys(library, texts):
    assert token_store.encode_texts(BPE, texts) == library_ids(library, texts)


def test_stored_ids_of_odd_texts(library):
    assert token_store.encode_texts(BPE, CUTS) == library_ids(library, CUTS)
    for t in CUTS:
        assert token_store.encode_texts(BPE, [t]) == library_ids(library, [t])
    assert token_store.encode_texts(BPE, []) == []


def test_words_go_to_the_model_without_the_pre_tokenizer(library):
    """New words skip the pre-tokenizer, which took more time than their merges; other units still go through it."""
    rng = random.Random(5)
    letters = [c for c in map(chr, range(0x250)) if is_word(f" {c}")]
    words = list({" " + "".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(3000)})
    ids, at = WordTokenizer(load_tokenizer(BPE)).encode(words)
    assert [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] == library_ids(library, words)
    encoder = token_store.Encoder(BPE)
    asked = []
    encoder.tokenizer = type("Counting", (), {"encode": lambda _, some, **k: asked.extend(some) or library.encode(some, **k)})()
    text = "".join(w + "." for w in words)
    ids, at = encoder.encode(pa.array([text]))
    assert ids.tobytes() == library_ids(library, [text])[0] and set(asked) == {"."}


def test_special_strings_that_a_cut_would_part(scratch):
    odd = Tokenizer.from_file(BPE)
    odd.add_special_tokens(["stop.now"])
    with pytest.raises(ValueError, match="special string"):
        WordTokenizer(odd)
    odd = Tokenizer.from_file(BPE)
    odd.add_special_tokens(["stop"])
    odd.save(f"{scratch}/odd.json")
    assert not WordTokenizer(odd).usable
    texts = ["it will stop. nonstop stops"]
    assert token_store.encode_texts(f"{scratch}/odd.json", texts) == library_ids(odd, texts)


def test_slices_hold_few_bytes(monkeypatch):
    monkeypatch.setattr(token_store, "SLICE_BYTES", 10)
    texts = ["12345", "12345", None, "1", "x" * 30, "", "123456789", "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [b.column("text").to_pylist() for b in token_store.byte_slices([batch.slice(1), batch.slice(0, 0)], "text")]
    assert got == [["12345", None, "1"], ["x" * 30], ["", "123456789"], ["é"]]


# SentencePiece

@pytest.fixture(scope="module")
def vocabulary():
    return P.load_vocabulary(MODEL)


def unigram_library(v):
    """The library's own unigram model over the same pieces and scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for i, p in enumerate(m.pieces):
        p.score = v.scores[i]
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def path_score(v, ids):
    return sum(v.scores[i] for i in ids)


def test_viterbi_is_best_of_all_segmentations(vocabulary):
    v = vocabulary
    ids = {p: i for i, p in enumerate(v.pieces) if v.normal[i]}

    def all_best(s):
        best = [0.0] + [-1e300] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(e):
                if s[b:e] in ids:
                    best[e] = max(best[e], best[b] + v.scores[ids[s[b:e]]])
            if s[e - 1] not in ids:
                best[e] = max(best[e], best[e - 1] + v.unk_score)
        return best[-1]

    rng = random.Random(3)
    for _ in range(300):
        s = P.SPACE + "".join(rng.choice("etaoinshr▁éñ") for _ in range(rng.randrange(1, 14)))
        got = P.best_path(v, s)
        assert abs(path_score(v, got) - all_best(s)) < 1e-9
        assert "".join(v.pieces[i] for i in got) == s


def test_same_scores_as_the_library(vocabulary, spark):
    pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    try:
        sp = unigram_library(vocabulary)
    except ImportError:
        pytest.skip("no protobuf")
    texts = [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60).collect()]
    for t, ours in zip(texts, sentencepiece_codec.encode_texts(MODEL, texts), strict=True):
        theirs = sp.encode(t)
        assert abs(path_score(vocabulary, ours) - path_score(vocabulary, theirs)) < 1e-3 * max(1, len(theirs))
        assert sp.decode(ours.tolist()) == t


def test_round_trip_of_odd_texts(spark):
    docs = odd_docs(spark).withColumn("ids", F.lit("clash"))
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, MODEL), MODEL).collect()
    assert len(back) == docs.count()
    for r in back:
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
        assert r["n_tokens"] in ("x", "y", "z")
        assert (r["ids"] == []) == (not r["text"])


def test_cuts_do_not_change_the_best_path(vocabulary):
    v = vocabulary
    for t in ["a b c", "the of\nand  more", "x▁y z", "\n\n a\n", "é ñandu"]:
        whole = P.best_path(v, P.SPACE + t.replace(" ", P.SPACE))
        cut = [i for part in P.cut(v, t) for i in (P.best_path(v, part) if part else [])]
        assert whole == cut


def test_decoding_whole_lists_is_decoding_piece_by_piece():
    from tracefold.llm.pieces import join_pieces, load_vocabulary
    v = load_vocabulary(MODEL)
    texts = ["", " lead", "a\nb\n", "é ☃ \U0001F600 x", "▁x", "plain words here", "\x00\x7f"]
    ids = [x.tolist() for x in sentencepiece_codec.encode_texts(MODEL, texts)]
    ids += [None, [], [v.byte_ids[0xE2], v.byte_ids[0x98]], [v.byte_ids[0xE2], v.byte_ids[0x98], ids[5][0]], [v.byte_ids[0xFF]] * 3, [v.byte_ids[0x20], ids[5][0]]]
    lists = pa.array(ids, pa.list_(pa.int32()))
    want = [join_pieces(v, x or []) for x in ids]
    assert sentencepiece_codec.decode_lists(v, lists) == want and sentencepiece_codec.decode_lists(v, lists.slice(3, 5)) == want[3:8]
    assert sentencepiece_codec.decode_lists(v, lists.slice(0, 0)) == []


def test_decode_of_an_empty_table_and_a_clashing_column(spark):
    rows = spark.createDataFrame([(1, "some words", 5), (2, None, 6)], "doc_id long, text string, decoded int")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(rows, MODEL), MODEL)
    assert back.columns == ["doc_id", "text", "ids", "decoded"] and sorted(r["decoded"] for r in back.collect()) == ["", "some words"]
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(rows.limit(0), MODEL), MODEL).collect() == []
