import hashlib

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from turfline.llm import bpe_codec, common
from turfline.llm.queries import MULTI_RANKS


def test_stage_returns_the_tokens(spark):
    texts = {1: "one two  three\n", 2: "Grüße, 世界 🙂", 3: "", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    path, pattern = public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN
    found = corpus_pipeline.encode(spark, docs, "")
    rows = {r.doc_id: r for r in found.collect()}
    want = {r.doc_id: r for r in bpe_codec.encode(docs, path, pattern).collect()}
    back = {r.doc_id: bytes(r.data) for r in bpe_codec.decode(found, path, pattern).collect()}
    for i, text in texts.items():
        assert (rows[i].ids, rows[i].ends) == (want[i].ids, want[i].ends)
        assert back[i] == (text or "").encode() and rows[i].n_tokens == len(rows[i].ids)
        assert hashlib.sha256(",".join(map(str, rows[i].ids)).encode()).hexdigest() == rows[i].ids_sha256
        assert hashlib.sha256(back[i]).hexdigest() == rows[i].decoded_sha256


def test_workers_hold_little(monkeypatch):
    """The memo shares its numbers, ids become numbers a text at a time, free memory goes back while a task runs."""
    codec = bpe_codec.codec(public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN)
    words = [f" zq{x}xj" for x in "abcdefgh"]
    seen: dict[int, int] = {}
    assert all(seen.setdefault(i, id(i)) == id(i) for w in words for i in codec.memo[w])
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    monkeypatch.setattr(common, "RETURN_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"x": list(range(100))})

    class Frame:
        sparkSession = None
        mapInArrow = staticmethod(lambda run, schema: run)

    class Session:
        class conf:
            get = staticmethod(lambda key, default: "1")

    Frame.sparkSession = Session
    run = common.map_batches(Frame, lambda batches: batches, "x long")
    assert len(list(run(iter([batch] * 10)))) == 10 and len(given) == 6
