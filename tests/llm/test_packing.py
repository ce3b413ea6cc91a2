import zlib

import numpy as np
import pytest
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st

from murmur.llm import packing as p


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t   'sï1,.<|endoftext|>", max_size=40), max_size=8))
def test_cached_ids_equal_the_tokenizers(reference, batch):
    got = p._tokenizer(None, None).encode(batch) if batch else []
    want = [np.array(e.ids, "<u4").tobytes() for e in reference.encode_batch(batch, add_special_tokens=False)]
    assert got == want


def test_added_tokens_have_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer
    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    batch = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b c", "<|endoftext|", "", "plain text",
             " <|endoftext|>\n x <|endoftext|> "]
    got = [np.frombuffer(x, "<u4").tolist() for x in p._tokenizer(None, None).encode(batch)]
    assert got == [e.ids for e in default.encode_batch(batch, add_special_tokens=False)]
    assert got[0] == [31373, 220, 50256, 995]


def test_small_tables_run_the_programme():
    hist = np.zeros(101, dtype=int)
    hist[[26, 32, 42]] = 40       # 26 + 32 + 42 = 100: 40 full sequences
    assert sum(c for _, c in p.pack_histogram(hist, 100)) <= 41 < sum(c for _, c in p._rounded(hist, 100, []))
    assert p.solve_configurations(hist, 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_every_piece_has_its_own_place(lengths):
    hist = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, dtype=int)
    packed = p.pack_histogram(hist, 64)
    placed = np.zeros(65, dtype=int)
    for own, count in packed:
        assert sum(own) <= 64 and count > 0
        for k in own:
            placed[k] += count
    assert (placed == hist).all()


def test_programme_is_near_the_lower_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(5, 1.2, 60_000).astype(int), 1, 2048)
    hist = np.bincount(lengths, minlength=2049)
    used = sum(c for _, c in p.pack_histogram(hist))
    assert used <= 1.01 * np.ceil(lengths.sum() / 2048)
    assert p.solve_configurations(hist, 2048)


def brute(reference, docs, seq_len):
    out = []
    for i, t in docs:
        ids = np.array(reference.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        n = len(ids)
        first = n if n <= seq_len else (n % seq_len or seq_len)
        at = 0
        k = 0
        while at < n:
            m = first if at == 0 else seq_len
            out.append((i, k, at, m, zlib.crc32(ids[at:at + m].tobytes())))
            at += m
            k += 1
    return sorted(out, key=str)


def check_places(rows, seq_len):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_seq.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= seq_len
    return len(by_seq)


def test_edge_rows(spark, reference):
    docs = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "word " * 300), (5, "tail  \n \n x")]
    df = spark.createDataFrame([(i, t, 9, "q") for i, t in docs], "doc_id long, text string, piece int, part string")
    rows = p.best_fit_pack(df, seq_len=64).collect()
    got = sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=str)
    assert got == brute(reference, docs, 64)
    check_places(rows, 64)
    assert p.best_fit_pack(df.limit(0), seq_len=64).count() == 0


def test_whole_table_and_written_ids(spark, reference):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    plan = p.best_fit_pack(df)
    rows = plan.collect()
    got = sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=str)
    assert got == brute(reference, docs, p.SEQ_LEN)
    used = check_places(rows, p.SEQ_LEN)
    assert used <= 1.05 * sum(r["length"] for r in rows) / p.SEQ_LEN + 1
    ids = p.packed_ids(df, plan).collect()
    want = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in rows}
    assert {(r["sequence_id"], r["offset"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in ids} == want


def test_workers_get_few_texts_at_a_time(spark):
    """Long texts reach a worker in small batches; the user's setting stays."""
    import pyarrow as pa

    from murmur.llm.packing import BATCH_ROWS
    from murmur.session import arrow_batches
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    with arrow_batches(spark, BATCH_ROWS):
        got = [r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").collect()]
    assert max(got) <= BATCH_ROWS and sum(got) == 3000 and spark.conf.get(key) == before
