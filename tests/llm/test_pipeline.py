"""The pipeline against its stages by brute force."""

import base64
import hashlib
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from harrow.llm import common, decontaminate, queries, toxicity
from tests.llm.test_corpus import brute_components
from tests.llm.test_text_scans import brute_hits

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = queries.documents(spark, SF)
    model = toxicity.train(docs, queries.table(spark, SF, "labels"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if model.severity(r.text) < toxicity.CUT)
    assert 100 < len(rows) < docs.count()
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    rows = sorted(first.values())
    kept = {i for i, _, _, k in brute_components(rows) if k}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary()[0], "rb"))}
    tik = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hits = {i: (n, hit) for i, n, hit, *_ in brute_hits(rows, items)}
    scanner = decontaminate.Scanner([(str(i), t) for i, t in items])
    want = {}
    for i, t in rows:
        n, hit = hits[i]
        if hit > decontaminate.MOST_COVERAGE * n:
            continue
        spans = scanner.scan(decontaminate._words(t))[0]
        assert sum(b - a for a, b in spans) == hit
        want[i] = decontaminate.without(t, spans) if hit else t
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == {i: tik.encode_ordinary(t) for i, t in want.items()}
    assert all(r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() for r in got)
    assert any(h for _, h in hits.values()) and Counter(len(r.ids) == r.n_tokens for r in got) == {True: len(got)}


def test_stages(spark):
    docs = queries.documents(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_written_tables_are_deleted(spark):
    """By the operators, what they need no longer; by ``sweep``, what is left."""
    path = spark._jvm.org.apache.hadoop.fs.Path(common._own_folder(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    one = common.written(spark.range(5))
    two = common.written(one.filter("id > 1"))
    common.drop_written(one)
    assert two.count() == 3 and len(one.inputFiles()) > 0 and fs.exists(path)
    assert not any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f)) for f in one.inputFiles())
    common.sweep(spark)
    assert not fs.exists(path)
