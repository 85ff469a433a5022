"""The corpus pipeline against the operators run one by one on plain rows."""

import random
import zlib

import pytest

import corpus_pipeline
from daybook.llm import secret_scan, simhash, toxicity

from .helpers import crowded, empty, hard_rows, put, table

LABELS = "doc_id bigint, quality int, toxic int"


def corpus():
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(240):
        words = [rng.choice(["ka", "lo", "mi"]) + rng.choice(["ten", "sur", "ba", "rin"]) * rng.randint(1, 2) for _ in range(rng.randint(30, 90))]
        if k % 5 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = "zoggling"
        rows.append((k, " ".join(words), "en", f"s{k % 3}", 1))
        labels.append((k, 1, int(k % 5 == 0)))
    rows += [(1000 + k, rows[1][1], "en", "s0", 1) for k in range(20)]
    rows.append((2000, 'the token = "6b526d9e98196c4dff5a73e8083186bb0ce9e5bd" was shown here to everyone', "en", "s1", 1))
    return rows, labels


def test_run_against_plain_stages(spark, tmp_path):
    rows, labels = corpus()
    put(table(spark, rows), tmp_path)
    put(spark.createDataFrame(labels, LABELS), tmp_path, "labels")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    net = toxicity.fit(toxicity.training_sample(table(spark, rows).select("doc_id", "text"), spark.createDataFrame(labels, LABELS)))
    kept = [r for r, s in zip(rows, toxicity.score([r[1] for r in rows], net), strict=True) if s < toxicity.REJECT]
    prints = {r[0]: simhash.fingerprint(r[1]) for r in kept}
    assert len({r.doc_id for r in got}) == len(got)
    want = []
    for r in sorted(kept):
        if not any((prints[r[0]] ^ prints[w[0]]).bit_count() <= 4 for w in want):
            want.append(r)
    assert {r.doc_id for r in got} == {w[0] for w in want}
    assert not {k for k in range(1000, 1020)} & {r.doc_id for r in got}
    import hashlib

    texts = {w[0]: secret_scan.redact(w[1]) for w in want}
    assert "[SECRET]" in texts[2000]
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    toxic = [k for k in range(0, 240, 5)]
    assert len(set(toxic) & {r.doc_id for r in got}) <= 2 and sum(r.doc_id < 240 for r in got) >= 180
    assert all(zlib.crc32(b"%d" % k) >= 0 for k in toxic)


@pytest.mark.parametrize("rows", [None, []])
def test_stages_take_hard_and_empty_tables(spark, tmp_path, rows):
    path = put(table(spark, rows), tmp_path)
    put(spark.createDataFrame([(3, 1, 0), (4, 1, 1)], LABELS), tmp_path, "labels")
    docs = crowded(spark) if rows is None else empty(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    assert docs.count() == 0 if rows == [] else docs.count() > 0


def test_mixing_and_secrets_keep_every_row(spark, tmp_path):
    docs = crowded(spark)
    for stage in (corpus_pipeline.replace_secrets, corpus_pipeline.mix_sources, corpus_pipeline.encode_bytes):
        assert stage(spark, docs, str(tmp_path)).count() == len(hard_rows())


def test_the_schedule_survives_storage(spark, tmp_path):
    from daybook.llm import mixing

    rows = [(k, f"text {k} " + "x" * (k * 7 % 400), "en", "hot" if k % 3 else f"s{k % 7}", 1) for k in range(2000)]
    want = {r.doc_id: (r.slot, r.place) for r in mixing.positions(table(spark, rows)).collect()}
    mixed = corpus_pipeline.mix_sources(spark, table(spark, rows), "")
    mixed.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.encode_bytes(spark, spark.read.parquet(f"{tmp_path}/mixed"), "")
    got = [(r.slot, r.place) for r in out.collect()]
    assert got == sorted(got) == sorted(want.values())
    out.repartition(8).write.parquet(f"{tmp_path}/out")
    assert {r.doc_id: (r.slot, r.place) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_run_returns_the_schedules_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(40)), "en", "hot" if k % 3 else f"s{k % 7}", 1) for k in range(600)]
    put(table(spark, rows).repartition(8), tmp_path)
    put(spark.createDataFrame([], LABELS), tmp_path, "labels")
    got = [(r.slot, r.place) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(got) == 600 and got == sorted(set(got))
