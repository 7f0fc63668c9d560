"""The stages, each against a plain statement of what it has to do with its own input, and odd documents through all of them."""

import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from cataloom.llm import _bytes, bpe, decontam, simhash

AT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (rows before, rows after), by doc_id, of the driver's table."""
    docs, out = spark.read.parquet(f"{AT}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, AT).cache()
        out[name] = ({r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()})
        docs = after
    return out


def test_order_and_columns(spark, stages):
    assert list(stages) == ["quality", "near_dedup", "decontamination", "secrets", "tokens"]
    for name, (before, after) in stages.items():
        assert 0 < len(after) <= len(before) and set(after) <= set(before)
        if name != "tokens":
            assert all(list(r.asDict()) == ["doc_id", "text", "lang", "source", "n_chars"] for r in after.values())


def test_quality_keeps_good_and_drops_poor(spark, stages):
    before, after = stages["quality"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{AT}/labels.parquet").collect() if r["doc_id"] in before}
    good, poor = ([k for k, q in labels.items() if (q == 0) == bad] for bad in (False, True))
    assert sum(k in after for k in good) >= 0.99 * len(good) and sum(k in after for k in poor) <= 0.05 * len(poor)
    assert all(after[k] == before[k] for k in after)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    ids = sorted(before)
    longs, has = simhash.signatures_of(pa.array([before[k]["text"] for k in ids]))
    root = list(range(len(ids)))

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for i in np.flatnonzero(has):
        near = np.bitwise_count((longs[i + 1 :] ^ longs[i]).view(np.uint64)).sum(-1) <= simhash.MOST_BITS
        for j in np.flatnonzero(near & has[i + 1 :]) + i + 1:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    expected = {ids[k] for k in range(len(ids)) if top(k) == k}
    assert expected <= set(after) and len(set(after) - expected) <= 0.02 * (len(ids) - len(expected))


def test_leaking_rows_go_and_no_others(spark, stages):
    before, after = stages["decontamination"]
    items = []
    for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect():
        words = _bytes.words_of(r["text"])
        items.append((len(words), {tuple(words[k : k + 5]) for k in range(len(words) - 4)}))
    for k, row in before.items():
        words = _bytes.words_of(row["text"])
        grams = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        leak = False
        for n, wanted in items:
            if wanted.intersection(grams):
                leak |= any(2 * len(wanted.intersection(grams[j : j + n - 4])) >= len(wanted) for j in range(len(grams)))
        assert (k in after) != leak


def test_secrets_are_masked_and_the_rest_stays(stages):
    before, after = stages["secrets"]
    assert set(before) == set(after)
    assert not any(re.search(r"(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])", r["text"]) for r in after.values())
    for k, r in after.items():
        if "<SECRET>" not in r["text"]:
            assert r == before[k]
        else:
            assert r["n_chars"] == len(r["text"])
            parts = [re.escape(x) for x in r["text"].split("<SECRET>")]
            assert re.fullmatch("[A-Za-z0-9+/_=-]+".join(parts), before[k]["text"], re.DOTALL)


def test_tokens_give_the_texts_back(stages):
    before, after = stages["tokens"]
    codec = bpe.Vocabulary.read().codec()
    assert set(before) == set(after)
    for r in after.values():
        assert r["exact"] and r["n_tokens"] == len(r["tokens"]) and codec.encoding.decode_bytes(r["tokens"]) == r["text"].encode()


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, AT)
    assert {r["doc_id"]: r for r in out.collect()} == stages["tokens"][1]
    assert decontam.leaks(out, spark.read.parquet(f"{AT}/benchmark.parquet")).isEmpty()


def test_odd_documents(spark, tmp_path):
    draw = random.Random(1)
    known = spark.read.parquet(f"{AT}/documents.parquet").limit(120)
    say = lambda: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(60)) + "."
    odd = [(None, say(), "en", None, None), (1_000_001, None, None, "s", 0), (1_000_002, "", "en", "s", 0), (1_000_003, say(), "en", "s", 1), (1_000_003, say(), "en", "s", 1), (1_000_004, (say() + "\n") * 3000, None, None, None)]
    odd.append(odd[3])
    docs = known.unionAll(spark.createDataFrame(odd, known.schema)).withColumns({k: known["source"] for k in ("key", "sid", "dk", "content_share", "redacted_text")})
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{AT}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, rows, str(tmp_path)).cache()
            assert after.columns[: len(docs.columns)] == docs.columns, name
            n = after.count()
            rows = after
        assert n == 0 or 100 < n <= 127
